"""Budgeted batches: rows of similar cost packed under three budgets, split over ranks, resumable."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from peakloom.operators.quantiles import aggregate, percentiles

BUCKET = 4096


def plan_batches(
    costs: DataFrame, key: str = "spectrum_uid", *, max_rows: int = 64, max_tokens: int = 16_384, max_candidates: int = 8_192, seed: int = 0, epoch: int = 0,
    bucket_rows: int = BUCKET,
) -> DataFrame:
    """(key, batch_id, singleton): every row in exactly one batch that exceeds no budget, unless it is one row alone.

    costs: (key, tokens, candidates, element_steps). Rows are range-partitioned by cost, so that a bucket of rows of
    similar cost lies in one task; inside a bucket they are shuffled by a hash of seed, epoch and key and packed
    greedily, closing a batch before a budget would be exceeded. Batches don't cross buckets. A batch id is
    (partition, number); plans of one seed and epoch are equal for one partitioning.
    """
    kind = costs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, batch_id STRING, singleton BOOLEAN"

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, name = 0, None
        rows = tokens = candidates = 0
        bucket = None
        for batch in batches:
            keys, ids, alone = [], [], []
            for part, b, k, t, c in zip(*(batch.column(x).to_pylist() for x in ("part", "bucket", "key", "tokens", "candidates"))):
                t, c = t or 0, c or 0
                single = t > max_tokens or c > max_candidates
                full = rows + 1 > max_rows or tokens + t > max_tokens or candidates + c > max_candidates
                if name is None or (part, b) != bucket or single or full or rows < 0:
                    number, rows, tokens, candidates = number + 1, 0, 0, 0
                    name = f"{part}-{number}"
                bucket = (part, b)
                rows, tokens, candidates = (-1, 0, 0) if single else (rows + 1, tokens + t, candidates + c)
                keys.append(k)
                ids.append(name)
                alone.append(single)
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(ids, pa.string()), pa.array(alone,
                pa.bool_())], names=[key, "batch_id", "singleton"])

    spread = costs.select(F.col(key).alias("key"), "tokens", "candidates", "element_steps").repartitionByRange("element_steps", "tokens", "key")
    numbered = spread.sortWithinPartitions("element_steps", "tokens", "key").withColumn("id", F.monotonically_increasing_id())
    part, row = F.shiftright("id", 33), F.col("id").bitwiseAND(F.lit((1 << 33) - 1))
    placed = numbered.select("key", "tokens", "candidates", part.alias("part"), F.floor(row / bucket_rows).alias("bucket"),
        F.xxhash64(F.lit(seed), F.lit(epoch), "key").alias("order"))
    return placed.sortWithinPartitions("part", "bucket", "order", "key").mapInArrow(pack, schema)


def split_ranks(batches: DataFrame, world: int, accumulation: int = 1, seed: int = 0, epoch: int = 0) -> DataFrame:
    """(batch_id, position, step, rank, dropped): batches in a hashed order, dealt round robin; the tail that fills no round is dropped.

    position is dense over all batches: per-partition counts give the offsets, no global sort in one task.
    """
    order = F.xxhash64(F.lit(seed), F.lit(epoch), "batch_id")
    distinct = batches.select("batch_id").distinct().withColumn("o", order)
    ranged = distinct.repartitionByRange("o", "batch_id").withColumn("p", F.spark_partition_id())
    local = ranged.withColumn("r", F.row_number().over(Window.partitionBy("p").orderBy("o", "batch_id")))
    # One row per partition: bounded, so it may be broadcast and summed in one task.
    counts = local.groupBy("p").agg(F.count("*").alias("n"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = counts.agg(F.sum("n")).first()[0] or 0
    used = total // (world * accumulation) * (world * accumulation)
    placed = local.join(F.broadcast(offsets), "p").withColumn("position", (F.col("before") + F.col("r") - 1).cast("bigint"))
    return placed.select(
        "batch_id", "position", F.floor(F.col("position") / (world * accumulation)).alias("step"), F.pmod("position", F.lit(world)).cast("int").alias("rank"),
        (F.col("position") >= used).alias("dropped"),
    )


def remaining(plan: DataFrame, consumed: int, rank: int, world: int) -> DataFrame:
    """What a rank has still to do after ``consumed`` of its batches: the plan is replayed, not stored."""
    return plan.where(~F.col("dropped") & (F.col("rank") == rank) & (F.floor(F.col("position") / world) >= consumed))


def workload(batches: DataFrame, costs: DataFrame, key: str = "spectrum_uid") -> DataFrame:
    """(measure, mean, least, p50, p90, greatest) of the batches' totals."""
    per = batches.join(costs, key).groupBy("batch_id").agg(F.count("*").cast("double").alias("rows"),
        *[F.sum(c).cast("double").alias(c) for c in ("tokens", "candidates", "element_steps")])
    long = per.select(F.explode(F.array(*[F.struct(F.lit(c).alias("measure"), F.col(c).alias("v")) for c in ("rows", "tokens", "candidates",
        "element_steps")])).alias("m")).select("m.*")
    return aggregate(long, ("measure",), [F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest")], percentiles("v", (0.5, 0.9), "v"))


def shares(df: DataFrame, step: str = "step", size: str = "n") -> DataFrame:
    """df with weight: the row's part of its step's total."""
    return df.withColumn("weight", F.col(size) / F.sum(size).over(Window.partitionBy(step)))


def ranks_overlap(df: DataFrame, key: str = "spectrum_uid", rank: str = "rank") -> DataFrame:
    """Keys that more than one rank holds."""
    return df.groupBy(key).agg(F.count_distinct(rank).alias("ranks")).where("ranks > 1")


def not_finite(log: DataFrame, column: str = "loss") -> DataFrame:
    """Steps whose loss is null, NaN or infinite."""
    x = F.col(column)
    return log.where(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))


def epoch_summary(log: DataFrame, by: str = "epoch") -> DataFrame:
    return log.groupBy(by).agg(F.count("*").alias("steps"), F.avg("loss").alias("loss_mean"), F.sum("n").alias("rows"), F.max("loss").alias("loss_max"))


def best_so_far(log: DataFrame, scores: tuple[str, ...], step: str = "epoch") -> DataFrame:
    """The first row with the lexicographically greatest scores."""
    return log.agg(F.max_by(F.struct(*log.columns), F.struct(*scores, -F.col(step))).alias("best")).select("best.*")
