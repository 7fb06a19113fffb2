import random

from pyspark.sql import functions as F

from peakloom.llm import topn

SCHEMA = "spectrum_uid STRING, mzs ARRAY<DOUBLE>, intensities ARRAY<FLOAT>"
NAN = float("nan")


def brute(data, n):
    out = set()
    for uid in {d[0] for d in data}:
        peaks = set()
        for u, mzs, ys in data:
            if u == uid:
                for i, (m, y) in enumerate(zip(mzs or [], ys or [])):
                    if m is not None and y is not None and y == y:
                        peaks.add((-y, m, i))
        out |= {(uid, place, i) for place, (_, _, i) in enumerate(sorted(peaks)[:n], 1)}
    return out


def test_against_brute_force(spark):
    rng = random.Random(3)
    data = []
    for u in range(40):
        k = rng.choice([0, 1, 7, 8, 9, 50])
        mzs = [rng.choice([None, 1.0, 2.0, 3.5]) for _ in range(k)]
        ys = [rng.choice([None, NAN, 0.0, -0.0, 1.0, 5.0]) for _ in range(k + rng.choice([-1, 0, 2]) if k else 0)]
        data += [(f"u{u}", mzs, ys)] * rng.choice([1, 3])
    data += [("null lists", None, None), (None, [1.0], [2.0])]
    for partitions in (1, 5):
        df = spark.createDataFrame(data, SCHEMA).repartition(partitions)
        assert {tuple(r) for r in topn.top_peaks(df).collect()} == brute(data, 8)


def test_hot_group_and_batches(spark):
    df = spark.range(60_000).select(F.lit("hot").alias("g"), (F.col("id") % 1000).alias("score"), "id")
    for combine in (True, False):
        got = topn.top_n(df, "g", [F.col("score").desc(), F.col("id")], 5, combine=combine).orderBy(topn.PLACE).collect()
        assert [(r.score, r.id, r[topn.PLACE]) for r in got] == [(999, 999 + 1000 * i, i + 1) for i in range(5)]


def test_ties_repeats_and_small_n(spark):
    df = spark.createDataFrame([("g", 1, "b"), ("g", 1, "a"), ("g", 1, "a"), ("h", None, None)], "g STRING, score INT, name STRING")
    got = topn.top_n(df, "g", [F.col("score").desc()], 2).collect()
    assert {(r.g, r.name, r[topn.PLACE]) for r in got} == {("g", "a", 1), ("g", "b", 2), ("h", None, 1)}
    assert topn.top_n(df, "g", [F.col("score")], 0).count() == 0
    assert topn.top_n(df.limit(0), "g", [F.col("score")], 3).count() == 0
