"""Problem 8: texts of varying length combined into containers of fixed capacity (vector best-fit).

An item asks for three resources: its tokens, one document, and its attention cost (the square of its
tokens, as attention stays inside a document). A container has a capacity of each, and each binds: many short texts run
into the number of documents, a long text beside short ones into the attention cost. Items come in
order of falling size; each goes to the open container that fits it under every constraint and is
left with the smallest weighted residual norm, or has the largest weighted dot product of its
residual with the item, and opens a new one if none fits.

Texts longer than a container are cut into full containers and one remainder; nothing else is cut. The
items are dealt by hash into blocks of a bounded number, so that a block is packed by one task; a
block leaves about one container unfilled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.llm.bpe import encode_column
from peakloom.session import cut, shuffle_width, table

CAPACITY = 1024
#: Documents of a container, and its attention cost as a share of that of one document that fills it.
MAX_DOCUMENTS, ATTENTION = 24, 0.9
BLOCK_ITEMS = 4096
#: Of tokens, documents and attention cost in the norm or the dot product.
WEIGHTS = (1.0, 0.01, 0.01)


def best_fit(sizes: np.ndarray, capacity: tuple[float, float, float], weights: tuple = WEIGHTS, rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """(container number of each item from 0, how many open containers refused it); sizes must fall and none may exceed the capacity alone.

    Refusals: a row per item with the number of containers that had the tokens but no place for a document, and of those that had
    both but not the attention cost.
    """
    if rule not in ("norm", "dot"):
        raise ValueError("rule must be norm or dot")
    cap, w = np.asarray(capacity, float), np.asarray(weights, float)
    left = np.empty((64, 3))  # residuals of the open containers
    names = np.empty(64, np.int64)
    used, opened = 0, 0
    out, refused = np.empty(len(sizes), np.int64), np.zeros((len(sizes), 2), np.int64)
    smallest = np.minimum.accumulate(sizes[::-1])[::-1] if len(sizes) else sizes  # the smallest item still to come
    for i, size in enumerate(sizes):
        item = np.array([size, 1.0, float(size) * size])
        after = left[:used] - item
        tokens, documents, cost = (after >= 0).T
        refused[i] = (tokens & ~documents).sum(), (tokens & documents & ~cost).sum()
        fits = np.flatnonzero(tokens & documents & cost)
        if len(fits):
            shares = (after[fits] if rule == "norm" else left[fits] * item / cap) / cap
            score = (shares * shares) @ w if rule == "norm" else -(shares @ w)
            at = int(fits[np.argmin(score)])
        else:
            if used == len(left):
                left, names = np.concatenate([left, np.empty_like(left)]), np.concatenate([names, np.empty_like(names)])
            at, left[used], names[used] = used, cap, opened
            used, opened = used + 1, opened + 1
        left[at] -= item
        out[i] = names[at]
        if left[at, 0] < max(smallest[i], 1):  # no item to come has so few tokens: close it
            used -= 1
            left[at], names[at] = left[used], names[used]
    return out, refused


def free_places(documents: np.ndarray, capacity: int, wanted: int) -> np.ndarray:
    """Container numbers for items without tokens: free places of the containers there are, then of new ones."""
    new = np.full(-(-wanted // capacity), 0)
    free = capacity - np.concatenate([documents, new])
    return np.repeat(np.arange(len(free)), free)[:wanted]


def pack(
    items: DataFrame, key: str = "doc_id", *, capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS, attention: float = ATTENTION,
    block_items: int = BLOCK_ITEMS, rule: str = "norm", count: int | None = None, refusals: bool = False,
) -> DataFrame:
    """(container_id STRING, key, piece, start, n_tokens) of every item of (key, n_tokens INT).

    piece counts the pieces of a text from 0, start is its first token. attention is the capacity of attention cost (the sum of
    squared tokens) as a share of capacity squared; a piece that costs more alone, as a full one does below a share of 1, has a
    container of its own. Items of 0 tokens take a place among the documents of a container, those of own containers included,
    and no tokens; null sizes count as 0. refusals adds refused_documents and refused_attention: how many open
    containers had the tokens for a piece but not the document or the cost. Repeated rows are packed each. count is the number of
    items, which sets the number of blocks; give it where items come from a costly step, else they are computed once more to be
    counted. The result depends on the rows only; an empty table gives an empty one.
    """
    if capacity < 1 or max_documents < 1 or attention <= 0:
        raise ValueError("capacities must be above 0")
    kind = items.schema[key].dataType.simpleString()
    blocks = max(1, -(-(items.count() if count is None else count) // block_items))
    sized = items.select(F.col(f"`{key}`").alias("doc_id"), F.coalesce(F.col("n_tokens"), F.lit(0)).alias("n"))
    full = F.floor(F.col("n") / capacity).cast("int")
    rest = F.col("n") - full * capacity
    pieces = (
        sized.withColumn("full", full)
        .withColumn("rest", rest.cast("int"))
        .withColumn("piece", F.explode(F.when((F.col("full") > 0) & (F.col("rest") == 0), F.sequence(F.lit(0),
            F.col("full") - 1)).otherwise(F.sequence(F.lit(0), F.col("full")))))
        .select(
            F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).alias("block"), "doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"),
            F.when(F.col("piece") < F.col("full"), F.lit(capacity)).otherwise(F.col("rest")).alias("n_tokens"),
        )
    )
    limits = (float(capacity), float(max_documents), attention * capacity * capacity)

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(block: int, part: int, held: list[pa.RecordBatch]) -> pa.RecordBatch:
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            sizes = whole.column("n_tokens").to_numpy().astype(float)
            alone = sizes * sizes > limits[2]  # too costly even alone
            empty = sizes == 0  # ask for a place among the documents only
            some = ~alone & ~empty
            number = np.empty(len(sizes), np.int64)
            number[alone] = np.arange(int(alone.sum()))
            refused = np.zeros((len(sizes), 2), np.int64)
            placed, refused[some] = best_fit(sizes[some], limits, rule=rule)
            number[some] = placed + int(alone.sum())
            number[empty] = free_places(np.bincount(number[~empty]), max_documents, int(empty.sum()))
            names = pa.array([f"{block}-{part}-{n}" for n in number.tolist()], pa.string())
            columns = {"container_id": names, key: whole.column("doc_id"), **{c: whole.column(c) for c in ("piece", "start", "n_tokens")}}
            if refusals:
                columns |= {"refused_documents": pa.array(refused[:, 0], pa.int32()), "refused_attention": pa.array(refused[:, 1], pa.int32())}
            return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

        held: list[pa.RecordBatch] = []
        rows, current, part = 0, None, 0
        for batch in batches:
            codes = batch.column("block").to_numpy()
            at = 0
            while at < len(codes):
                if codes[at] != current:
                    if held:
                        yield flush(current, part, held)
                    held, rows, current, part = [], 0, int(codes[at]), 0
                end = int(np.searchsorted(codes[at:], current, side="right")) + at
                end = min(end, at + 2 * block_items - rows)
                held.append(batch.slice(at, end - at))
                rows, at = rows + end - at, end
                if rows >= 2 * block_items:  # repeated keys may overfill a block: it goes on in another part
                    yield flush(current, part, held)
                    held, rows, part = [], 0, part + 1
        if held:
            yield flush(current, part, held)

    dealt = pieces.repartition(min(blocks, shuffle_width(items.sparkSession)), "block").sortWithinPartitions("block",
        F.col("n_tokens").desc(), "doc_id", "piece")
    return dealt.mapInArrow(fill, f"container_id STRING, `{key}` {kind}, piece INT, start BIGINT, n_tokens INT" + (", refused_documents INT, refused_attention INT" if refusals else ""))


def packed_documents(spark: SparkSession, sf_dir: str, refusals: bool = False) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return pack(encode_column(documents, "doc_id", "text", counts_only=True), count=documents.count(), refusals=refusals)


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every text in its container of 1,024 tokens."""
    return packed_documents(spark, sf_dir)


def loads(packed: DataFrame) -> DataFrame:
    """(container_id, pieces, tokens, cost) of every container."""
    n = F.col("n_tokens").cast("bigint")
    return packed.groupBy("container_id").agg(F.count("*").alias("pieces"), F.sum(n).alias("tokens"), F.sum(n * n).alias("cost"))


def p8_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers beside the fewest possible, tokens, texts that were cut, how often each constraint refused, and the share of unused space."""
    packed = packed_documents(spark, sf_dir, refusals=True)
    own = F.struct(*[F.sum(c).alias(c) for c in ("refused_documents", "refused_attention")])
    per = packed.groupBy("container_id").agg(
        F.sum("n_tokens").alias("tokens"), F.count("*").alias("pieces"), F.sum((F.col("piece") > 0).cast("int")).alias("cuts"), own.alias("r")
    )
    whole = per.agg(
        F.count("*").alias("containers"), F.sum("tokens").alias("tokens"), F.max("tokens").alias("fullest"),
            F.sum("pieces").alias("pieces"), F.sum("cuts").alias("cuts"),
        F.sum("r.refused_documents").alias("refused_documents"), F.sum("r.refused_attention").alias("refused_attention"),
    )
    least = F.greatest(F.ceil(F.col("tokens") / CAPACITY), F.ceil(F.col("pieces") / MAX_DOCUMENTS))
    return whole.withColumn("least", least).withColumn("unused", F.round(1 - F.col("tokens") / (F.col("containers") * CAPACITY), 6))


def violations(packed: DataFrame, sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY, max_documents: int = MAX_DOCUMENTS,
    attention: float = ATTENTION) -> DataFrame:
    """(check_name, violations): what a packing must keep. sizes: (key, n_tokens), a row per item."""
    load = loads(packed)
    many = F.col("pieces") > 1
    full = load.agg(
        F.count_if(F.col("tokens") > capacity).alias("tokens_over"), F.count_if(F.col("pieces") > max_documents).alias("documents_over"),
        F.count_if(many & (F.col("cost") > attention * capacity * capacity) & (F.col("tokens") != F.sqrt("cost"))).alias("attention_over"),
    )
    per = packed.groupBy(key).agg(
        F.sum("n_tokens").alias("got"), F.count("*").alias("pieces"), F.max("piece").alias("last"),
            F.count_if(F.col("start") != F.col("piece") * capacity).alias("shifted")
    )
    joined = sizes.select(key, F.coalesce("n_tokens", F.lit(0)).alias("n")).join(per, key, "full")
    wrong = lambda c: F.count_if(F.coalesce(c, F.lit(True)))
    items = joined.agg(
        wrong(F.col("got") != F.col("n")).alias("tokens_lost"), wrong(F.col("pieces") != F.greatest(F.lit(1),
            F.ceil(F.col("n") / capacity))).alias("cut_without_need"),
        wrong((F.col("last") != F.col("pieces") - 1) | (F.col("shifted") > 0)).alias("pieces_astray"),
    )
    rows = lambda df: df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check_name"),
        F.col(c).alias("violations")) for c in df.columns])).alias("r")).select("r.*")
    return rows(full).unionByName(rows(items))


def p8_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every token of every text once and no capacity exceeded: the number of violations of each rule, and of documents."""
    sizes = cut(encode_column(table(spark, sf_dir, "documents"), "doc_id", "text", counts_only=True))
    packed = cut(pack(sizes, count=sizes.count()))
    documents = packed.agg(F.lit("documents").alias("check_name"), F.count_distinct("doc_id").alias("violations"))
    return violations(packed, sizes).unionByName(documents)
