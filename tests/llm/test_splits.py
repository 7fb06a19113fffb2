import random
from collections import defaultdict

import numpy as np
import pytest

from peakloom.llm import components, splits

SCHEMA = "spectrum_uid STRING, parent_spec STRING, inchikey STRING, fold STRING"


def key(n):
    text = "".join(chr(65 + (n // 26**i) % 26) for i in range(14))
    return f"{text}-ABCDEFGHIJ-N"


def roots(edges, nodes):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by_key = defaultdict(list)
    for n, k in edges:
        by_key[k].append(n)
    for own in by_key.values():
        for n in own[1:]:
            a, b = sorted((find(own[0]), find(n)))
            up[b] = a
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("salts", [1, 8])
def test_components_against_union_find(spark, salts):
    rng = random.Random(salts)
    nodes = [f"n{i:04d}" for i in range(300)]
    chain = [(f"n{i:04d}", f"c{j}") for i in range(40) for j in (i, i + 1)]  # a long path
    star = [(n, "hot") for n in nodes[150:]]
    edges = sorted({*chain, *star, *((rng.choice(nodes), f"k{rng.randrange(400)}") for _ in range(120))})
    out = components.components(
        spark.createDataFrame(edges, "node STRING, key STRING"), spark.createDataFrame([(n,) for n in nodes], "node STRING"), salts
    )
    assert {r.node: r.root for r in out.collect()} == roots(edges, nodes)


def test_components_of_nothing(spark):
    nodes = spark.createDataFrame([("a",), ("b",)], "node STRING")
    none = spark.createDataFrame([], "node STRING, key STRING")
    assert {tuple(r) for r in components.components(none, nodes).collect()} == {("a", "a"), ("b", "b")}


def test_difference_balances_and_keeps_all():
    rng = np.random.default_rng(0)
    w = rng.integers(1, 50, 2000).astype(float)
    sums = np.bincount(splits.difference(w, 20), w, 20)
    assert sums.sum() == w.sum() and sums.max() - sums.min() <= 1
    # 8-7, 6-5, 4-1, 3-1: differencing leaves 2, where the optimum is 0.
    few = np.array([8.0, 7, 6, 5, 4])
    assert sorted(np.bincount(splits.difference(few, 2), few)) == [14, 16]
    assert len(splits.difference(np.zeros(0), 5)) == 0


def test_combined_partitions_balance():
    """Bins of blocks, differenced again, are as even as one differencing of all; nothing is lost."""
    rng = np.random.default_rng(3)
    parts = np.zeros((7, 10))
    for i in range(7):
        w = rng.integers(1, 90, 60).astype(float)
        parts[i] = np.bincount(splits.difference(w, 10), w, 10)
    to = splits.combine(parts)
    assert ((to >= 0) == (parts > 0)).all()
    sums = np.bincount(to[parts > 0], parts[parts > 0], 10)
    assert sums.sum() == parts.sum() and sums.max() - sums.min() < 6
    # A component that outweighs a bin is one part among them: allocation makes up for it.
    heavy = np.r_[parts, [[0.0] * 9 + [parts.sum() / 3]]]
    to = splits.combine(heavy)
    sums = np.bincount(to[heavy > 0], heavy[heavy > 0], 10)
    of = splits.allocate(sums, np.array([0.8, 0.1, 0.1]))
    assert sums.sum() == pytest.approx(heavy.sum()) and np.bincount(of, sums) / sums.sum() == pytest.approx([0.8, 0.1, 0.1], abs=0.06)
    assert splits.combine(np.zeros((0, 4))).shape == (0, 4)


@pytest.mark.parametrize("block_items, fan_in", [(20_000, 2_000), (50, 2_000), (20, 3)])
def test_shares_hold_at_every_size_of_block(spark, block_items, fan_in):
    """One block, many blocks and several levels of blocks: shares hold, a component of a quarter of all rows included."""
    rng = np.random.default_rng(11)
    rows = [(f"r{i:04d}", int(w)) for i, w in enumerate(rng.integers(1, 30, 800))]
    rows.append(("heavy", sum(w for _, w in rows) // 3))
    df = spark.createDataFrame(rows, "root STRING, weight BIGINT")
    options = {"block_items": block_items, "fan_in": fan_in}
    got = {r.root: r.split for r in splits.grouped_splits(df, **options).collect()}
    assert set(got) == {r for r, _ in rows}
    total = sum(w for _, w in rows)
    for name, share in splits.SHARES:
        assert abs(sum(w for r, w in rows if got[r] == name) / total - share) < 0.012
    again = {r.root: r.split for r in splits.grouped_splits(df.repartition(5), **options).collect()}
    assert again == got


def data():
    rng = random.Random(5)
    out = []
    for p in range(600):
        for i in range(rng.randrange(1, 6)):
            out.append((f"p{p}:{i}", f"p{p:04d}", key(p // 2 if p % 7 else p) if rng.random() < 0.9 else None, rng.choice(["train", "train",
                "Val", "valid", None, " "])))
    out += [("hot", "p9999", None, "test")] * 900
    out += [("lost", None, key(3).lower(), "train"), ("alone", None, "unknown", None), (None, None, None, None)]
    return out


def test_splits_keep_groups_and_shares(spark):
    rows = data()
    df = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", split STRING").repartition(5)
    got = splits.split_rows(df).collect()
    assert len(got) == len(rows)
    by_parent, by_key, count = defaultdict(set), defaultdict(set), defaultdict(int)
    for r in got:
        count[r.split] += 1
        if r.parent_spec:
            by_parent[r.parent_spec].add(r.split)
        if r.inchikey and "-" in r.inchikey:
            by_key[r.inchikey.upper()].add(r.split)
    assert all(len(s) == 1 for s in [*by_parent.values(), *by_key.values()])
    for name, share in splits.SHARES:
        assert abs(count[name] / len(rows) - share) < 0.01
    again = splits.split_rows(df.repartition(1)).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_many_blocks(spark):
    weights = spark.createDataFrame([(f"r{i}", 1 + i % 9) for i in range(3000)], "root STRING, weight BIGINT")
    got = splits.grouped_splits(weights, block_items=300).join(weights, "root").groupBy("split").sum("weight").collect()
    total = sum(r[1] for r in got)
    for r in got:
        assert abs(r[1] / total - dict(splits.SHARES)[r[0]]) < 0.01


def test_conflicts(spark):
    rows = [
        ("1", "b", "InChIKey=" + key(1), "train"), ("2", "a", key(1).lower(), "VAL"), ("3", "c", key(2), "valid"), ("4", "c", None, "val"),
        ("5", "d", "X" + key(2), None), ("6", "e", None, "train"), ("7", "e", None, "Test"), ("8", None, key(9), "train"), ("9", None, key(9), "test"),
    ]
    got = {tuple(r) for r in splits.conflicts(splits.related(spark.createDataFrame(rows, SCHEMA))).collect()}
    assert got == {("a", "a"), ("b", "a"), ("e", "e")}


def test_empty(spark):
    assert splits.split_rows(spark.createDataFrame([], SCHEMA)).count() == 0
