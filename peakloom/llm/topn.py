"""Problem 5: the top N items of every group by a secondary sort.

Rows are hash-partitioned by group, sorted inside the partitions by group, score and identifier, and
streamed as Arrow batches; only the first N rows of each group pass. No group is ever buffered: the
stream remembers the last group and how many rows of it have passed. Before the shuffle the same
stream runs over the partitions as they lie, so that a group of a third of all rows sends at most
N rows per map task.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import shuffle_width, table

PLACE = "__place"


def first_of_groups(keys: pa.Array, before: tuple | None, n: int) -> tuple[np.ndarray, np.ndarray, tuple | None]:
    """(indices kept, their places from 1, state) of one batch whose rows lie sorted by group.

    keys: the group of each row as one comparable array. before: (last group, rows of it so far).
    """
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), before
    codes = np.asarray(keys.dictionary_encode(null_encoding="encode").indices)
    starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    sizes = np.diff(np.r_[starts, len(codes)])
    place = np.arange(len(codes)) - np.repeat(starts, sizes) + 1
    if before is not None and keys[0].as_py() == before[0]:
        place[: sizes[0]] += before[1]
    kept = np.flatnonzero(place <= n)
    return kept, place[kept], (keys[-1].as_py(), int(place[-1]))


def stream_top_n(df: DataFrame, group: str, n: int) -> DataFrame:
    """The first n distinct rows of each run of ``group``, with their places; df lies sorted inside its partitions."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + f", {PLACE} INT"

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, last = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = ~repeats(batch, last)
            last = batch.slice(batch.num_rows - 1)
            if not fresh.all():
                batch = batch.filter(pa.array(fresh))
            kept, place, state = first_of_groups(batch.column(group), state, n)
            if len(kept):
                out = batch.take(pa.array(kept))
                yield pa.RecordBatch.from_arrays([*out.columns, pa.array(place, pa.int32())], names=[*out.schema.names, PLACE])

    return df.mapInArrow(stream, schema)


def repeats(batch: pa.RecordBatch, last: pa.RecordBatch | None) -> np.ndarray:
    """Whether each row equals the row before it; last: the row before the batch."""
    same = np.ones(batch.num_rows, bool)
    for i, column in enumerate(batch.columns):
        same[1:] &= _equal(column[1:], column[:-1])
        same[0] &= last is not None and bool(_equal(column[:1], last.column(i))[0])
    return same


def _equal(a: pa.Array, b: pa.Array) -> np.ndarray:
    """Row by row, null equal to null and NaN to NaN."""
    if pa.types.is_nested(a.type):
        return np.array([x == y for x, y in zip(a.to_pylist(), b.to_pylist())], bool)
    same = pc.fill_null(pc.equal(a, b), False).to_numpy(zero_copy_only=False).copy()
    if a.null_count or b.null_count or pa.types.is_floating(a.type):
        same |= pc.and_(pc.is_null(a, nan_is_null=True), pc.is_null(b, nan_is_null=True)).to_numpy(zero_copy_only=False)
    return same


def top_n(df: DataFrame, group: str, order: Sequence[Column], n: int, *, partitions: int | None = None, combine: bool = True) -> DataFrame:
    """The first n distinct rows of every group by ``order``, with ``__place`` from 1.

    Rows that ``order`` leaves tied come in the order of their other columns, so the result is the same
    on every run; columns of a type without an order (maps) take no part in that. Repeated rows count
    once. Rows with a null group are one group. n below 1 gives no row; a group with fewer rows gives all
    of them. A column of that name is replaced. Sorting and streaming need memory for batches only, whatever the group's size.
    combine=False leaves out the pass before the shuffle.
    """
    df = df.drop(PLACE)
    if n < 1:
        return df.withColumn(PLACE, F.lit(None).cast("int")).limit(0)
    width = partitions or shuffle_width(df.sparkSession)
    ties = [F.col(f"`{f.name}`").asc() for f in df.schema if f.name != group and not re.search("map<|variant", f.dataType.simpleString())]
    keys = [F.col(f"`{group}`").asc_nulls_first(), *order, *ties]
    if combine:
        df = stream_top_n(df.sortWithinPartitions(*keys), group, n).drop(PLACE)
    return stream_top_n(df.repartition(width, F.col(f"`{group}`")).sortWithinPartitions(*keys), group, n)


def peaks(df: DataFrame, *, key: str = "spectrum_uid", mzs: str = "mzs", intensities: str = "intensities") -> DataFrame:
    """(key, intensity, mz, peak_index) of every peak: positions with an m/z and an intensity that is no NaN.

    Null or empty lists hold no peak; of lists of unequal length the shorter one ends the spectrum.
    """
    pair = F.arrays_zip(F.col(mzs).alias("mz"), F.col(intensities).alias("intensity"))
    return (
        df.select(F.col(key).alias(key), F.posexplode(pair).alias("peak_index", "peak"))
        .select(key, (F.col("peak.intensity") + F.lit(0.0).cast("float")).alias("intensity"), F.col("peak.mz").alias("mz"), "peak_index")
        .where("mz IS NOT NULL AND intensity IS NOT NULL AND NOT isnan(intensity)")
    )


def top_peaks(df: DataFrame, n: int = 8, *, key: str = "spectrum_uid") -> DataFrame:
    """(key, place, peak_index) of the n most intense peaks: intensity descending, m/z ascending, position ascending."""
    order = [F.col("intensity").desc(), F.col("mz").asc(), F.col("peak_index").asc()]
    return top_n(peaks(df, key=key), key, order, n).select(key, F.col(PLACE).alias("place"), "peak_index")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_peaks(table(spark, sf_dir, "fragment_supervision_v2").select("spectrum_uid", "mzs", "intensities"))
