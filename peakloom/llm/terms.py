"""Problem 1: how often every distinct term or n-gram occurs, and in how many records.

The records are read in blocks of a bounded number of terms. Each block becomes a suffix array over
term codes (prefix doubling); the common-prefix lengths of neighbours cut it into intervals, one per
distinct n-gram, whose size is the number of occurrences. A record that holds an n-gram k times makes
k - 1 adjacencies of its own suffixes inside the interval; subtracting them leaves the number of
records. A record lies wholly in one block, so the counts of blocks add up exactly, and one shuffle of
(n-gram, counts) rows, combined on the map side, gives the totals. A term that a third of all
records hold costs one row per block.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.session import cut, table

#: Terms in a block: bounds the memory of a worker (about 80 bytes a term).
BLOCK_TERMS = 400_000
RARE_BELOW = 3
COMMON_PERCENT = 5


class SuffixArray:
    """Suffixes of all records of a block, sorted by their terms; a suffix ends with its record or before a gap.

    codes: term code of each position, -1 at a gap (null or empty term). left: the number of terms from
    each position to the end of its record or the next gap.
    """

    def __init__(self, codes: np.ndarray, records: np.ndarray, depth: int | None = None):
        self.records = records
        self.left = self._left(codes, records)
        n, longest = len(codes), int(self.left.max(initial=0))
        goal = longest if depth is None else min(depth, longest)
        rank = codes.astype(np.int64)
        self.levels = [rank]  # levels[j]: rank of each suffix by its first 2**j terms
        k = 1
        self.order = np.argsort(rank, kind="stable")
        while k < goal:
            second = np.zeros(n, np.int64)
            more = np.flatnonzero(self.left > k)
            second[more] = rank[more + k] + 1
            key = rank * (int(rank.max(initial=0)) + 2) + second if n else rank
            self.order = np.argsort(key, kind="stable")
            ordered = key[self.order]
            rank = np.empty(n, np.int64)
            rank[self.order] = np.cumsum(np.r_[0, ordered[1:] != ordered[:-1]]) if n else 0
            self.levels.append(rank)
            k *= 2
            if n and int(rank.max()) == n - 1:
                break
        self.order = self.order[self.left[self.order] > 0]
        self.common = self.prefix(self.order[:-1], self.order[1:])
        # Suffixes of one record, in the order of the array: what each has in common with the one before it, for all lengths at once.
        by_record = np.argsort(self.records[self.order], kind="stable")
        p, q = by_record[:-1], by_record[1:]
        same = self.records[self.order[p]] == self.records[self.order[q]]
        p, q = p[same], q[same]
        self.within = np.zeros(len(self.order), np.int64)
        self.within[q] = self.prefix(self.order[p], self.order[q])

    @staticmethod
    def _left(codes: np.ndarray, records: np.ndarray) -> np.ndarray:
        n = len(codes)
        if not n:
            return np.zeros(0, np.int64)
        last = np.r_[records[1:] != records[:-1], True]
        stop = np.where(codes < 0, np.arange(n), np.where(last, np.arange(1, n + 1), n))
        return np.minimum.accumulate(stop[::-1])[::-1] - np.arange(n)

    def prefix(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of suffixes a and b, from the ranks of all levels."""
        length = np.zeros(len(a), np.int64)
        room = np.minimum(self.left[a], self.left[b])
        for j in range(len(self.levels) - 1, -1, -1):
            for _ in range(2 if j == len(self.levels) - 1 else 1):  # at the top level the same step may fit twice
                fits = np.flatnonzero(room - length >= 2**j)
                rank = self.levels[j]
                same = fits[rank[a[fits] + length[fits]] == rank[b[fits] + length[fits]]]
                length[same] += 2**j
        return length

    def intervals(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first suffix, occurrences, records) of every distinct n-gram: the intervals in which neighbours share n terms.

        Suffixes of one record are adjacent inside an interval if one follows the other there; each such adjacency is a repeat.
        """
        order = self.order
        if not len(order):
            return order, order, order
        starts = np.flatnonzero(np.r_[True, self.common < n])
        occurrences = np.diff(np.r_[starts, len(order)])
        repeats = np.add.reduceat((self.within >= n).astype(np.int64), starts)
        kept = self.left[order[starts]] >= n
        return order[starts][kept], occurrences[kept], (occurrences - repeats)[kept]


def block_counts(lists: pa.Array, lengths: Sequence[int], depth: int | None = None) -> Iterator[tuple[list[list[str]], np.ndarray, np.ndarray]]:
    """(n-grams, occurrences, records) of a block for each wanted length; lists: ARRAY<STRING>, one per record."""
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    sizes = np.asarray(lists.value_lengths().fill_null(0))
    flat = lists.flatten().dictionary_encode()
    words = flat.dictionary.to_pylist()
    codes = np.asarray(flat.indices.fill_null(-1)).astype(np.int64)
    if "" in words:
        codes[codes == words.index("")] = -1
    array = SuffixArray(codes, np.repeat(np.arange(len(sizes)), sizes), depth)
    for n in lengths:
        first, occurrences, records = array.intervals(n)
        grams = codes[first[:, None] + np.arange(n)] if len(first) else np.zeros((0, n), np.int64)
        yield [[words[c] for c in gram] for gram in grams.tolist()], occurrences, records


def distinct_records(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """One row per key; where rows of a key differ, the smallest content counts, whatever the row order."""
    cols = [F.col(f"`{f}`") for f in fields]
    return df.groupBy(F.col(f"`{key}`").alias("__key")).agg(F.min(F.struct(*cols)).alias("__content")).select("__key", "__content.*")


def term_frequencies(
    df: DataFrame, key: str, fields: Sequence[str], lengths: Sequence[int] = (1,), *, block_terms: int = BLOCK_TERMS, depth: int | None = None
) -> DataFrame:
    """(field_name, gram ARRAY<STRING>, occurrences, records) of every distinct n-gram of the wanted lengths.

    fields are ARRAY<STRING> columns; rows with the same key are one record (a null key is a key). Null
    lists and empty lists hold nothing; a null or empty term counts nowhere, and no n-gram spans it.
    Terms are compared exactly. depth bounds the suffix array's sorting, None sorts it fully; it must
    reach the longest wanted n-gram. Extra columns don't matter. An empty table gives an empty result.
    """
    return counts_and_total(df, key, fields, lengths, block_terms=block_terms, depth=depth).where("field_name IS NOT NULL")


def counts_and_total(
    df: DataFrame, key: str, fields: Sequence[str], lengths: Sequence[int] = (1,), *, block_terms: int = BLOCK_TERMS, depth: int | None = None
) -> DataFrame:
    """term_frequencies and, in the same pass, a row with a null field_name whose records are those of the table."""
    if any(n < 1 or (depth is not None and n > depth) for n in lengths):
        raise ValueError("lengths must be from 1 to depth")
    schema = "field_name STRING, gram ARRAY<STRING>, occurrences BIGINT, records BIGINT"
    fields = list(fields)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            whole = pa.Table.from_batches(block)
            seen = pa.array([whole.num_rows], pa.int64())
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.string()), pa.nulls(1, pa.list_(pa.string())), seen, seen],
                names=["field_name", "gram", "occurrences", "records"])
            for f in fields:
                for grams, occurrences, records in block_counts(whole.column(f), lengths, depth):
                    for at in range(0, len(grams), 20_000):
                        part = slice(at, at + 20_000)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([f] * len(grams[part]), pa.string()),
                                pa.array(grams[part], pa.list_(pa.string())),
                                pa.array(occurrences[part], pa.int64()),
                                pa.array(records[part], pa.int64()),
                            ],
                            names=["field_name", "gram", "occurrences", "records"],
                        )

        block, held = [], 0
        for batch in batches:
            block.append(batch)
            held += max(len(batch.column(f).flatten()) for f in fields)
            if held >= block_terms:
                yield from flush(block)
                block, held = [], 0
        if block:
            yield from flush(block)

    counted = distinct_records(df, key, fields).select(*fields).mapInArrow(count, schema)
    return counted.groupBy("field_name", "gram").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def mark_terms(terms: DataFrame, total: int, rare_below: int = RARE_BELOW, common_percent: int = COMMON_PERCENT) -> DataFrame:
    """terms with mark: rare, common or null. total: the number of records."""
    rare = F.col("records") < rare_below
    return terms.withColumn("mark", F.when(rare, "rare").when(F.col("records") * 100 > total * common_percent, "common"))


P1_FIELDS = ("candidate_neutral_formula", "candidate_ion_state")


def p1_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct term of both candidate lists with its counts and mark."""
    df = table(spark, sf_dir, "fragment_supervision_v2").select("spectrum_uid", *P1_FIELDS)
    counted = cut(counts_and_total(df, "spectrum_uid", P1_FIELDS, (1,)))
    own = counted.where("field_name IS NULL").first()
    return mark_terms(counted.where("field_name IS NOT NULL"), own["records"] if own else 0).select("field_name",
        F.col("gram")[0].alias("term"), "occurrences", "records", "mark")


def p1_grams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct run of one to three neighbouring terms, joined by blanks for reading."""
    df = table(spark, sf_dir, "fragment_supervision_v2").select("spectrum_uid", *P1_FIELDS)
    terms = term_frequencies(df, "spectrum_uid", P1_FIELDS, (1, 2, 3))
    return terms.select("field_name", F.size("gram").alias("n"), F.array_join("gram", " ").alias("run"), "occurrences", "records")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that are too rare or too common."""
    return p1_terms(spark, sf_dir).where("mark IS NOT NULL").select("field_name", "term", "mark")
