import random

import numpy as np
import pytest

from pyspark.sql import functions as F

from peakloom.operators.quantiles import aggregate, exact_quantiles


@pytest.mark.parametrize("values", [[3.0], [1.0, 2.0], [7.0] * 500 + [1.0, 9.0], [random.Random(2).gauss(0, 1) for _ in range(999)]])
def test_against_numpy(spark, values):
    points = (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)
    df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "x DOUBLE").repartition(5)
    got = {r.point: r.value for r in exact_quantiles(df, "x", points).collect()}
    assert got == pytest.approx({p: float(np.percentile(values, 100 * p)) for p in points})


def test_nothing(spark):
    assert exact_quantiles(spark.createDataFrame([(None,)], "x DOUBLE"), "x", (0.5,)).count() == 0


@pytest.mark.parametrize("accuracy", [20, 10_000])
def test_groups_against_numpy(spark, accuracy):
    """With an accuracy of 20, groups above 80 rows go through brackets; ties, hot values and a null group included."""
    rng = random.Random(4)
    rows = [(g, rng.choice([rng.gauss(0, 1), 0.5, float("nan")]), rng.choice([1, 1, 2, None])) for g, n in (("big", 3000), ("small", 5),
        (None, 200)) for _ in range(n)] + [("none", None, None)]
    df = spark.createDataFrame(rows, "g STRING, x DOUBLE, k INT").repartition(5)
    wanted = [("x", 0.1, "x_p10"), ("x", 0.5, "x_p50"), ("k", 0.9, "k_p90"), ("x", 1.0, "x_p100")]
    got = {r.g: r for r in aggregate(df, ("g",), [F.count("*").alias("n")], wanted, accuracy).collect()}
    for g in ("big", "small", None, "none"):
        assert got[g].n == sum(r[0] == g for r in rows)
        for column, p, name in wanted:
            own = [r[1 if column == "x" else 2] for r in rows if r[0] == g]
            own = [v for v in own if v is not None and v == v]
            assert got[g][name] == (pytest.approx(float(np.percentile(own, 100 * p))) if own else None)
    assert aggregate(df.limit(0), (), [F.count("*").alias("n")], wanted).first().n == 0
