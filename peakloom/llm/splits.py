"""Problem 4: train, validation and test splits that keep related records together.

Records that share a parent or an InChIKey, also through further parents, form a component. Components
are balanced by largest differencing: repeatedly the two partial partitions whose extreme weights
differ most are combined, the heavy bins of one with the light bins of the other, until many nearly
equal bins are left, and whole bins are allocated to the splits by their target shares.

At scale the components are dealt by hash into blocks of a bounded number, and each block is differenced in one task into as
many bins. The blocks' bins are partial partitions themselves, so differencing goes on with them, heavy bins of one
with light bins of the other, ``FAN_IN`` blocks to a task and level by level, until one partition of the whole is left;
only its bins are allocated. A component of any weight is an item like the others: one that outweighs a bin makes its bin as
much heavier, and allocation, which takes the heaviest bins first, makes up for it.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.components import SALTS, components
from peakloom.session import cut, shuffle_width, small, table

SHARES = (("train", 0.8), ("valid", 0.1), ("test", 0.1))
BINS = 100
BLOCK_ITEMS = 20_000
#: Partial partitions that one task combines.
FAN_IN = 2_000
#: Sorts after every real parent: nodes of rows that have no parent.
_NO_PARENT = "\U0010ffff"


def inchikey(field: Column) -> Column:
    """The 27-character key in the field, in capitals; null if there is none."""
    found = F.regexp_extract(field, r"(?<![A-Za-z])([A-Za-z]{14}-[A-Za-z]{10}-[A-Za-z])(?![A-Za-z])", 1)
    return F.when(found != "", F.upper(found))


def fold_name(fold: Column) -> Column:
    """Lower case without outer blanks; val is valid, blank is null."""
    name = F.lower(F.trim(fold))
    return F.when(name == "val", "valid").when(name != "", name)


def combine(parts: np.ndarray) -> np.ndarray:
    """Largest differencing of partial partitions: parts[i, j] is the weight of bin j of part i; the result, of the same shape,
    tells which bin of the whole it falls into (-1 where the weight is 0).

    The heap holds partitions by spread (largest less smallest sum); the two of largest spread are combined, the heaviest bin
    of one with the lightest of the other, and so on. Ties go to the one that came first. The bins of the whole are in
    order of weight.
    """
    count, bins = parts.shape
    out = np.full(count * bins, -1, np.int64)
    if not count:
        return out.reshape(parts.shape)
    # Bins of parts that fall together form a linked chain: head and tail per bin, next per bin of a part.
    follows = np.full(count * bins, -1, np.int64)
    heap: list = []
    for i in range(count):
        order = np.argsort(parts[i], kind="stable")
        sums = parts[i][order]
        head = np.where(sums > 0, i * bins + order, -1)
        heap.append((-float(sums[-1] - sums[0]), i, sums, head, head))
    heapq.heapify(heap)
    serial = count
    while len(heap) > 1:
        _, _, a, a_head, a_tail = heapq.heappop(heap)
        _, _, b, b_head, b_tail = heapq.heappop(heap)
        b, b_head, b_tail = b[::-1], b_head[::-1], b_tail[::-1]
        sums = a + b
        joined = np.flatnonzero((a_tail >= 0) & (b_head >= 0))
        follows[a_tail[joined]] = b_head[joined]
        head = np.where(a_head >= 0, a_head, b_head)
        tail = np.where(b_tail >= 0, b_tail, a_tail)
        order = np.argsort(sums, kind="stable")
        sums, head, tail = sums[order], head[order], tail[order]
        heapq.heappush(heap, (-float(sums[-1] - sums[0]), serial, sums, head, tail))
        serial += 1
    for b, i in enumerate(heap[0][3]):
        while i >= 0:
            out[i] = b
            i = follows[i]
    return out.reshape(parts.shape)


def difference(weights: np.ndarray, bins: int) -> np.ndarray:
    """Bin number of each weight (above 0) by largest differencing into ``bins`` bins: every item is a partition of its own."""
    order = np.argsort(-weights, kind="stable")
    parts = np.zeros((len(weights), bins))
    parts[:, -1] = weights[order]
    out = np.empty(len(weights), np.int64)
    out[order] = combine(parts)[:, -1]
    return out


def allocate(sums: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Split number of each bin: the heaviest first, each to the split that lacks most of its target."""
    target = shares / max(shares.sum(), 1e-300) * sums.sum()
    have, out = np.zeros(len(shares)), np.zeros(len(sums), np.int64)
    for b in np.argsort(-sums, kind="stable"):
        out[b] = int(np.argmax(target - have))
        have[out[b]] += sums[b]
    return out


def grouped_splits(weights: DataFrame, shares: tuple = SHARES, *, bins: int = BINS, block_items: int = BLOCK_ITEMS, fan_in: int = FAN_IN) -> DataFrame:
    """(root, split) of every row of weights: (root STRING, distinct and not null; weight BIGINT, at least 1).

    The result depends on the rows only, not on their order or partitioning. An empty table gives an
    empty result. Shares need not add up to 1.
    """
    names = [n for n, _ in shares]
    want = np.array([s for _, s in shares], float) / sum(s for _, s in shares)
    spark = weights.sparkSession
    items = weights.count()
    blocks = max(1, -(-items // block_items))

    def split_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, whole in by_block(batches, "block"):
            w = whole.column("weight").to_numpy().astype(float)
            bin_of = difference(w, bins)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(w), block), pa.int64()), pa.array(bin_of, pa.int32()), whole.column("root"), whole.column("weight")],
                    names=["block", "bin", "root", "weight"]
            )

    dealt = weights.select("root", "weight", F.pmod(F.xxhash64("root"), F.lit(blocks)).alias("block"))
    dealt = dealt.repartition(min(blocks, shuffle_width(spark)), "block").sortWithinPartitions("block", F.col("weight").desc(), "root")
    placed = cut(dealt.mapInArrow(split_block, "block BIGINT, bin INT, root STRING, weight BIGINT"))
    sums = placed.groupBy("block", "bin").agg(F.sum("weight").alias("weight"))
    while blocks > 1:
        blocks = -(-blocks // fan_in)
        merged = cut(combine_blocks(sums, bins, fan_in, min(blocks, shuffle_width(spark))))
        moved = merged.select("block", "bin", "to_block", "to_bin")
        placed = placed.join(small(moved), ["block", "bin"]).select(F.col("to_block").alias("block"), F.col("to_bin").alias("bin"), "root", "weight")
        sums = merged.groupBy(F.col("to_block").alias("block"), F.col("to_bin").alias("bin")).agg(F.sum("weight").alias("weight"))
    # One partition is left: as many rows as there are bins.
    final = sorted((r["bin"], r["weight"]) for r in sums.collect())
    of_bin = allocate(np.array([w for _, w in final], float), want)
    table_of = spark.createDataFrame([(b, names[s]) for (b, _), s in zip(final, of_bin)], "bin INT, split STRING")
    return placed.join(F.broadcast(table_of), "bin").select("root", "split")


def by_block(batches: Iterator[pa.RecordBatch], name: str) -> Iterator[tuple[int, pa.RecordBatch]]:
    """(number, rows) of each run of equal numbers in rows that lie sorted by it."""
    held: list[pa.RecordBatch] = []
    current = None
    for batch in batches:
        codes = batch.column(name).to_numpy()
        at = 0
        while at < len(codes):
            if codes[at] != current:
                if held:
                    yield current, pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, current = [], int(codes[at])
            end = int(np.searchsorted(codes[at:], current, side="right")) + at
            held.append(batch.slice(at, end - at))
            at = end
    if held:
        yield current, pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def combine_blocks(sums: DataFrame, bins: int, fan_in: int, partitions: int) -> DataFrame:
    """(block, bin, weight, to_block, to_bin): the bins of fan_in neighbouring blocks combined by one task."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for to_block, whole in by_block(batches, "to_block"):
            block, own, weight = (whole.column(c).to_numpy() for c in ("block", "bin", "weight"))
            _, part = np.unique(block, return_inverse=True)
            parts = np.zeros((int(part.max()) + 1, bins))
            parts[part, own] = weight
            to_bin = combine(parts)[part, own]
            yield pa.RecordBatch.from_arrays(
                [whole.column("block"), whole.column("bin"), whole.column("weight"), pa.array(np.full(len(own), to_block), pa.int64()),
                    pa.array(to_bin, pa.int32())],
                names=["block", "bin", "weight", "to_block", "to_bin"],
            )

    grouped = sums.withColumn("to_block", F.floor(F.col("block") / fan_in)).repartition(partitions, "to_block").sortWithinPartitions("to_block", "block", "bin")
    return grouped.select("block", "bin", "weight", "to_block").mapInArrow(merge, "block BIGINT, bin INT, weight BIGINT, to_block BIGINT, to_bin INT")


def related(df: DataFrame, *, parent: str = "parent_spec", key: str = "inchikey", fold: str = "fold", row: str = "spectrum_uid",
    salts: int = SALTS) -> DataFrame:
    """(node, root, low, high, weight) of every parent: its group, its least and greatest recorded fold, its rows.

    A row without a parent counts as a parent of its own: one per InChIKey if it holds one, else one per
    row key. Such nodes start with a character that sorts after every real parent, so that a group's root
    is its smallest real parent if it has one. Rows are combined by (parent, key) before any shuffle.
    """
    made = df.select(node_of(parent, key, row).alias("node"), inchikey(F.col(key)).alias("key"), fold_name(F.col(fold)).alias("fold"))
    pairs = cut(made.groupBy("node", "key").agg(F.min("fold").alias("low"), F.max("fold").alias("high"), F.count("*").alias("weight")))
    nodes = pairs.groupBy("node").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("weight").alias("weight"))
    roots = components(pairs.where("key IS NOT NULL").select("node", "key"), nodes.select("node"), salts)
    return nodes.join(roots, "node").select("node", "root", "low", "high", "weight")


def node_of(parent: str, key: str, row: str) -> Column:
    alone = F.concat(F.lit(_NO_PARENT), F.coalesce(inchikey(F.col(key)), F.col(row).cast("string"), F.lit("")))
    return F.coalesce(F.col(parent).cast("string"), alone)


def conflicts(groups: DataFrame) -> DataFrame:
    """(parent_spec, group_key) of the parents in groups with more than one recorded fold."""
    of_group = groups.groupBy("root").agg(F.min("low").alias("low"), F.max("high").alias("high")).where("low < high").select("root")
    found = groups.join(of_group, "root").where(~F.col("node").startswith(_NO_PARENT))
    return found.select(F.col("node").alias("parent_spec"), F.col("root").alias("group_key"))


def split_rows(df: DataFrame, shares: tuple = SHARES, *, parent: str = "parent_spec", key: str = "inchikey", fold: str = "fold",
    row: str = "spectrum_uid") -> DataFrame:
    """df with split and broken: every row, repeated ones too, in the split of its group.

    broken tells that the group's recorded folds differ. Columns of df with these names are replaced.
    """
    groups = cut(related(df, parent=parent, key=key, fold=fold, row=row))
    by_root = groups.groupBy("root").agg(F.sum("weight").alias("weight"), F.min("low").alias("low"), F.max("high").alias("high"))
    splits = grouped_splits(by_root.select("root", "weight"), shares)
    of_root = by_root.join(splits, "root").select("root", "split", F.coalesce(F.col("low") < F.col("high"), F.lit(False)).alias("broken"))
    of_node = groups.select("node", "root").join(of_root, "root").select(F.col("node").alias("__node"), "split", "broken")
    out = df.drop("split", "broken").withColumn("__node", node_of(parent, key, row))
    return out.join(of_node, "__node", "left").drop("__node")


def p4_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of spectra_v2 with its split."""
    df = table(spark, sf_dir, "spectra_v2").select("spectrum_uid", "parent_spec", "inchikey", "fold")
    return split_rows(df).select("spectrum_uid", "parent_spec", "fold", "split", "broken")


def p4_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(check_name, n): rows, parents and InChIKeys in more than one split, splits off their share, rows of groups with contradicting folds."""
    df = table(spark, sf_dir, "spectra_v2").select("spectrum_uid", "parent_spec", "inchikey", "fold")
    out = cut(split_rows(df).select("parent_spec", inchikey(F.col("inchikey")).alias("key"), "split", "broken"))
    row = lambda df, name, n: df.agg(F.lit(name).alias("check_name"), n.cast("bigint").alias("n"))
    apart = lambda c: out.where(F.col(c).isNotNull()).groupBy(c).agg(F.min("split").alias("a"), F.max("split").alias("b")).where("a <> b")
    per = out.groupBy("split").agg(F.count("*").alias("rows"))
    targets = spark.createDataFrame(SHARES, "split STRING, share DOUBLE")
    whole = out.agg(F.count("*").alias("whole"))
    off = targets.join(per, "split", "left").crossJoin(F.broadcast(whole)).where(F.abs(F.coalesce("rows", F.lit(0)) / F.col("whole") - F.col("share")) > 0.02)
    checks = row(out, "rows", F.count("*")).unionByName(row(apart("parent_spec"), "parents_apart",
        F.count("*"))).unionByName(row(apart("key"), "keys_apart", F.count("*")))
    return checks.unionByName(row(off, "shares_off", F.count("*"))).unionByName(row(out, "rows_of_broken_groups", F.count_if("broken")))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parents whose group's recorded folds contradict one another."""
    return conflicts(related(table(spark, sf_dir, "spectra_v2")))
