"""Problem 3: a reproducible sample that stays as data grows (frozen batch bottom-k).

Every item belongs to the batch in which it first arrived. When a batch closes, exactly ceil(rate * size) items with the
smallest salted hashes are chosen, and a ledger keeps the decision: the chosen items and, per batch, its size and the hash
of its last chosen item. What the ledger holds is never decided again: the sample only ever grows, also when items turn up
late in a closed batch or a log corrects a batch number. Such a late item, known by a hash below the closed batch's threshold
without having been chosen, takes part in the batch that is open then; one above the threshold was passed over and stays so.

The k smallest of a batch are found without sorting a batch in one task: items are counted by (batch, leading bits of the
hash); running counts over at most 2**bits rows per batch give the cell in which the k-th item lies; cells below it are taken
whole, and only the items of that one cell are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.session import cut, path_exists, small, table

SALT = "peakloom-sample-1:"
RATE = (5, 100)
#: Hexadecimal digits of the hash that make a cell: 16**4 cells a batch.
CELL_DIGITS = 4


class Ledger:
    """The decisions on closed batches, as Parquet in a folder that all executors share: ``chosen`` and ``closed``, by epoch.

    An epoch is written chosen first and counts once its closed part is there, so that a crash in between leaves the ledger as
    it was; the next call then writes the same epoch anew.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def epochs(self) -> int:
        n = 0
        while path_exists(self.spark, f"{self.path}/closed/epoch={n}/_SUCCESS"):
            n += 1
        return n

    def _read(self, name: str) -> DataFrame | None:
        parts = [f"{self.path}/{name}/epoch={n}" for n in range(self.epochs())]
        return self.spark.read.parquet(*parts) if parts else None

    def chosen(self) -> DataFrame | None:
        """(item, text, batch), None before the first batch closed."""
        return self._read("chosen")

    def closed(self) -> DataFrame | None:
        """(batch, size, last STRUCT<hash, text>)."""
        return self._read("closed")

    def append(self, chosen: DataFrame, closed: DataFrame) -> None:
        n = self.epochs()
        chosen.write.mode("overwrite").parquet(f"{self.path}/chosen/epoch={n}")
        closed.write.mode("overwrite").parquet(f"{self.path}/closed/epoch={n}")


def _first_arrivals(items: DataFrame, item: str, batch: str, salt: str, cell_digits: int) -> DataFrame:
    """(item, text, batch, hash, cell) of every item with its smallest batch."""
    return (
        items.select(F.col(f"`{item}`").cast("string").alias("text"), F.col(f"`{item}`").alias("item"), F.col(f"`{batch}`").alias("batch"))
        .where("item IS NOT NULL AND batch IS NOT NULL")
        .groupBy("text", "item")
        .agg(F.min("batch").alias("batch"))
        .withColumn("hash", F.md5(F.concat(F.lit(salt), F.col("text")).cast("binary")))
        .withColumn("cell", F.substring("hash", 1, cell_digits))
    )


def _bottom_k(first: DataFrame, rate: tuple[int, int]) -> DataFrame:
    """(item, text, batch, hash, size) of the chosen items of every batch in first."""
    num, den = rate
    of_batch = Window.partitionBy("batch")
    running = of_batch.orderBy("cell").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = (
        first.groupBy("batch", "cell").agg(F.count("*").alias("n"))
        .withColumn("upto", F.sum("n").over(running))
        .withColumn("size", F.sum("n").over(of_batch))
        .withColumn("need", F.floor((F.col("size") * num + (den - 1)) / F.lit(den)).cast("bigint") - (F.col("upto") - F.col("n")))
        .where("need > 0 AND need <= n")
        .select("batch", F.col("cell").alias("edge"), "need", "size")
    )
    # One row per batch.
    candidates = first.join(small(edge), "batch").where("cell <= edge")
    rank = Window.partitionBy("batch").orderBy("hash", "text")
    whole = candidates.where("cell < edge")
    last = candidates.where("cell = edge").withColumn("rank", F.row_number().over(rank)).where("rank <= need").drop("rank")
    return whole.unionByName(last).select("item", "text", "batch", "hash", "size")


def frozen_bottom_k(
    items: DataFrame, item: str, batch: str, rate: tuple[int, int] = RATE, *, salt: str = SALT, cell_digits: int = CELL_DIGITS, ledger: Ledger | None = None,
) -> DataFrame:
    """(item, batch) of the sampled items.

    items has one or several rows per item, repeated rows included; an item's batch is the smallest it
    comes with. Rows with a null item or a null batch don't take part: what hasn't arrived in a batch
    yet can't be chosen for good. rate is an exact fraction (numerator, denominator); every non-empty
    batch keeps at least one item if the rate is above 0. Equal hashes are ordered by the item itself.
    The order of hashes is that of md5(salt || item) as hexadecimal text.

    Without a ledger all batches are decided from items alone. With one, batches that it holds stay as they are, late items
    join the greatest batch of items that it doesn't hold (or wait if there is none), all other batches are decided, and the
    decisions are added to the ledger before they are returned. The batch of an item is then that of the decision.
    """
    num, den = rate
    if not 0 <= num <= den:
        raise ValueError("rate must lie between 0 and 1")
    first = cut(_first_arrivals(items, item, batch, salt, cell_digits))
    before = ledger.chosen() if ledger else None
    if before is not None:
        closed = ledger.closed().select("batch", "last").cache()
        new = first.select("batch").distinct().join(F.broadcast(closed), "batch", "left_anti").agg(F.max("batch")).first()[0]
        fresh = first.join(before.select("text"), "text", "left_anti").join(small(closed), "batch", "left")
        own = F.struct("hash", "text")
        into = F.when(F.col("last").isNull(), F.col("batch")).when(own <= F.col("last"), F.lit(new))
        kind = first.schema["batch"].dataType
        first = cut(fresh.withColumn("batch", into.cast(kind)).where("batch IS NOT NULL").select(*first.columns))
    chosen = _bottom_k(first, rate)
    if ledger is not None:
        chosen = cut(chosen)
        sizes = first.groupBy("batch").agg(F.count("*").alias("size"))
        last = chosen.groupBy("batch").agg(F.max(F.struct("hash", "text")).alias("last"))
        if not first.isEmpty() or ledger.epochs() == 0:
            ledger.append(chosen.select("item", "text", "batch"), sizes.join(last, "batch", "left"))
        chosen = ledger.chosen()
    return chosen.select(F.col("item").alias(item), F.col("batch").alias(batch))


def sample_rows(
    df: DataFrame, arrivals: DataFrame, *, item: str = "parent_spec", row: str = "spectrum_uid", batch: str = "batch_no", rate: tuple[int,
        int] = RATE, ledger: Ledger | None = None,
) -> DataFrame:
    """(item, row, batch) of all distinct rows of the sampled items of df.

    The batch of an item is the smallest of its rows in arrivals, which may repeat. Items of df that
    arrivals lacks aren't eligible yet. Batches and sizes count items that df has, so an item known
    only to arrivals takes no place; if its rows come after its batch was closed in the ledger, it is a late item.
    """
    # Both sides of the last join: read from the table once.
    have = cut(df.select(item, row).where(F.col(item).isNotNull()).distinct())
    arrived = arrivals.groupBy(item).agg(F.min(batch).alias(batch))
    known = have.select(item).distinct().join(arrived, item)
    return have.join(frozen_bottom_k(known, item, batch, rate, ledger=ledger), item).select(item, row, batch)


def p3_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """About 5 % of the parents with all their spectra."""
    return sample_rows(table(spark, sf_dir, "spectra_v2"), table(spark, sf_dir, "ingest_log"))
