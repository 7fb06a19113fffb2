from collections import defaultdict

import numpy as np
import pytest

from peakloom.llm import containers


def check(rows, sizes, capacity, documents=256, attention=1.0):  # noqa: C901
    """Every item is there once, in pieces that follow one another, and no container is overfull."""
    load, pieces = defaultdict(list), defaultdict(list)
    for c, doc, piece, start, n in rows:
        load[c].append(n)
        pieces[doc].append((piece, start, n))
    for own in load.values():
        assert sum(own) <= capacity and len(own) <= documents
        assert sum(x > 0 for x in own) <= 1 or sum(x * x for x in own) <= attention * capacity**2
    for doc, size in sizes.items():
        own = sorted(pieces[doc])
        assert [p for p, _, _ in own] == list(range(len(own))) and sum(n for *_, n in own) == (size or 0)
        assert [s for _, s, _ in own] == [p * capacity for p, _, _ in own]
        assert len(own) == max(1, -(-(size or 0) // capacity))
    return load


@pytest.mark.parametrize("rule", ["norm", "dot"])
def test_packing(spark, rule):
    rng = np.random.default_rng(4)
    sizes = {i: int(x) for i, x in enumerate(rng.gamma(1.2, 60, 3000))} | {5000: None, 5001: 0, 5002: 250, 5003: 500, 5004: 251, 5005: 26_000}
    df = spark.createDataFrame(list(sizes.items()), "doc_id BIGINT, n_tokens INT")
    options = {"capacity": 250, "max_documents": 20, "attention": 0.9, "rule": rule, "block_items": 1000}
    packed = containers.pack(df, **options)
    rows = [tuple(r) for r in packed.collect()]
    load = check(rows, sizes, 250, 20, 0.9)
    assert 1 - sum(map(sum, load.values())) / (250 * len(load)) < 0.02
    assert {r.check_name: r.violations for r in containers.violations(packed, df, "doc_id", 250, 20, 0.9).collect()} == dict.fromkeys(
        ("tokens_over", "documents_over", "attention_over", "tokens_lost", "cut_without_need", "pieces_astray"), 0
    )
    again = containers.pack(df.repartition(1), **options)
    assert sorted(rows) == sorted(tuple(r) for r in again.collect())


def test_attention_capacity(spark):
    sizes = {i: 10 + i % 90 for i in range(500)}
    df = spark.createDataFrame(list(sizes.items()), "doc_id BIGINT, n_tokens INT")
    rows = [tuple(r) for r in containers.pack(df, capacity=100, attention=0.3).collect()]
    check(rows, sizes, 100, attention=0.3)


def scalar_best_fit(sizes, capacity):
    """The same order and rule with tokens as the only constraint."""
    left, out = [], []
    for n in sizes:
        fits = [i for i, x in enumerate(left) if x >= n]
        at = min(fits, key=lambda i: left[i]) if fits else len(left)
        if not fits:
            left.append(capacity)
        left[at] -= n
        out.append(at)
    return out


def test_vector_keeps_what_scalar_breaks():
    """Many short items overrun the documents, long ones the attention cost: scalar best-fit breaks both, vector best-fit neither."""
    rng = np.random.default_rng(8)
    sizes = np.sort(np.r_[rng.integers(1, 8, 300), rng.integers(88, 93, 40)])[::-1].astype(float)
    capacity = (100.0, 10.0, 0.85 * 100**2)

    def worst(bins):
        return max(np.bincount(bins)), max(np.bincount(bins, sizes * sizes))

    documents, cost = worst(np.array(scalar_best_fit(sizes, 100.0)))
    assert documents > capacity[1] and cost > capacity[2]
    placed, refused = containers.best_fit(sizes, capacity)
    documents, cost = worst(placed)
    assert documents <= capacity[1] and cost <= capacity[2] and np.bincount(placed, sizes).max() <= 100 and (refused.sum(axis=0) > 0).all()


def test_violations_are_seen(spark):
    sizes = spark.createDataFrame([(1, 30), (2, 250), (3, 5), (4, None)], "doc_id INT, n_tokens INT")
    packed = spark.createDataFrame(
        [("a", 1, 0, 0, 30), ("a", 2, 0, 0, 100), ("b", 2, 1, 100, 100), ("b", 3, 0, 0, 2), ("b", 3, 1, 2, 3)],
            "container_id STRING, doc_id INT, piece INT, start BIGINT, n_tokens INT"
    )
    got = {r.check_name: r.violations for r in containers.violations(packed, sizes, "doc_id", 100, 2, 0.9).collect()}
    assert got == {"tokens_over": 2, "documents_over": 1, "attention_over": 2, "tokens_lost": 2, "cut_without_need": 3, "pieces_astray": 2}


def test_repeated_rows_overfill_no_block(spark):
    df = spark.createDataFrame([(1, 7)] * 700, "doc_id BIGINT, n_tokens INT")
    rows = [tuple(r) for r in containers.pack(df, capacity=70, block_items=100).collect()]
    load = defaultdict(int)
    for c, *_, n in rows:
        load[c] += n
    assert len(rows) == 700 and max(load.values()) <= 70 and len(load) <= 75


def test_best_fit_takes_the_tightest():
    assert containers.best_fit(np.array([60.0, 50, 45, 40]), (100.0, 9.0, 1e4))[0].tolist() == [0, 1, 1, 0]
    assert containers.best_fit(np.array([1.0, 1, 1]), (100.0, 2.0, 1e4))[0].tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        containers.best_fit(np.array([1.0]), (1.0, 1.0, 1.0), rule="other")


def test_items_without_tokens(spark):
    assert containers.free_places(np.array([2, 3, 1]), 3, 5).tolist() == [0, 2, 2, 3, 3]
    assert containers.free_places(np.zeros(0, int), 2, 3).tolist() == [0, 0, 1]
    df = spark.createDataFrame([(i, 0 if i % 2 else 100) for i in range(40)], "doc_id BIGINT, n_tokens INT")
    load = defaultdict(list)
    for r in containers.pack(df, capacity=100, max_documents=2, attention=1.0).collect():
        load[r.container_id].append(r.n_tokens)
    assert sorted(map(sorted, load.values())) == [[0, 100]] * 20


def test_empty(spark):
    assert containers.pack(spark.createDataFrame([], "doc_id BIGINT, n_tokens INT")).count() == 0
