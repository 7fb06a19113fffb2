"""Exact quantiles of columns and groups of any size.

Spark's ``percentile`` keeps every distinct value of a group in one task. Here a mergeable sketch, whose rank error
is bounded, brackets each wanted rank; a second pass counts the values below the bracket and the distinct values inside it,
combined on the map side; and only the values of a bracket, a share of about four times the sketch's error, are ordered
to find the two that a quantile lies between. Nothing but brackets and results is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.session import cut, small

#: Parts of the rows that the sketch may err by: one in so many.
ACCURACY = 10_000

#: (column, point from 0 to 1, name of the result).
Wanted = tuple[str, float, str]


def percentiles(column: str, points: Sequence[float], prefix: str) -> list[Wanted]:
    """The wanted points of a column, named prefix_p50.."""
    return [(column, float(p), f"{prefix}_p{round(p * 100)}") for p in points]


def aggregate(df: DataFrame, by: Sequence[str], aggs: Sequence[Column], wanted: Sequence[Wanted], accuracy: int = ACCURACY, reread: bool = False) -> DataFrame:
    """(by.., aggs.., one DOUBLE per wanted quantile): groupBy(by).agg(aggs) with exact quantiles beside it.

    df is read three times, from the checkpoint folder, unless reread tells that it is cheap to read, as a table is. Nulls in
    ``by`` are a group. A quantile of a group without a value is null.
    """
    rows = df if reread else cut(df)
    plain = rows.groupBy(*by).agg(*aggs) if by else rows.agg(*aggs)
    found = group_quantiles(rows, by, wanted, accuracy)
    return plain.withColumn("__g", _group(by)).join(found, "__g", "left").drop("__g")


def _group(by: Sequence[str]) -> Column:
    """The group as one value that is never null itself, so that joins need no care for nulls inside."""
    return F.struct(*[F.col(b) for b in by]) if by else F.struct(F.lit(0).alias("all"))


def group_quantiles(df: DataFrame, by: Sequence[str], wanted: Sequence[Wanted], accuracy: int = ACCURACY) -> DataFrame:
    """(__g STRUCT of by, one DOUBLE per wanted quantile), linear between the two neighbouring values as ``percentile`` gives them.

    Null and NaN values don't count; a group without values has no row.
    """
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    values = F.array(*[F.struct(F.lit(i).alias("c"), F.col(c).cast("double").alias("v")) for i, c in enumerate(columns)])
    long = df.select(_group(by).alias("__g"), F.explode(values).alias("x")).select("__g", "x.c", "x.v").where("v IS NOT NULL AND NOT isnan(v)")
    margin = 2.0 / accuracy
    points = sorted({p for _, p, _ in wanted})
    cuts = [max(0.0, p - margin) for p in points] + [min(1.0, p + margin) for p in points]
    sketch = long.groupBy("__g", "c").agg(
        F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high"), F.percentile_approx("v",
            F.array(*[F.lit(q) for q in cuts]), F.lit(accuracy)).alias("q")
    )
    # A group of few rows is its own bracket; the sketch's error is below one rank there.
    few = F.col("n") <= 4 * accuracy
    mine = {(columns.index(c), points.index(p)) for c, p, _ in wanted}
    brackets = [
        F.when(
            F.col("c").isin(*[c for c, at in mine if at == i]),
            F.struct(F.lit(i).alias("i"), F.lit(p).alias("p"), F.when(few, F.col("low")).otherwise(F.col("q")[i]).alias("lo"), F.when(few,
                F.col("high")).otherwise(F.col("q")[len(points) + i]).alias("hi")),
        )
        for i, p in enumerate(points)
    ]
    each = sketch.select("__g", "c", "n", F.explode(F.array_compact(F.array(*brackets))).alias("b")).select("__g", "c", "n", "b.*")
    # Few rows, but made from all: written once, then counted and joined.
    inside = long.join(small(cut(each)), ["__g", "c"]).where("v <= hi").withColumn("w", F.when(F.col("v") >= F.col("lo"), F.col("v")))
    counted = inside.groupBy("__g", "c", "i", "p", "n", "w").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("__g", "c", "i").orderBy(F.col("w").asc_nulls_first()))
    at = F.col("p") * (F.col("n") - 1)
    first = F.floor(at)
    ranked = counted.withColumn("upto", upto)
    pair = ranked.where("w IS NOT NULL").groupBy("__g", "c", "i", "p", "n").agg(
        F.min(F.when(F.col("upto") > first, F.col("w"))).alias("lower"), F.min(F.when(F.col("upto") > F.least(first + 1, F.col("n") - 1),
            F.col("w"))).alias("upper")
    )
    value = F.col("lower") + (F.col("upper") - F.col("lower")) * (at - first)
    picked = [F.max(F.when((F.col("c") == columns.index(c)) & (F.col("i") == points.index(p)), F.col("value"))).alias(name) for c, p, name in wanted]
    return pair.withColumn("value", value).groupBy("__g").agg(*picked)


def exact_quantiles(df: DataFrame, column: str, points: Sequence[float], accuracy: int = ACCURACY) -> DataFrame:
    """(point, value) of a whole column; without any value the result is empty."""
    names = [f"q{i}" for i in range(len(points))]
    found = group_quantiles(cut(df.select(column)), (), [(column, float(p), n) for p, n in zip(points, names)], accuracy)
    rows = F.array(*[F.struct(F.lit(float(p)).alias("point"), F.col(n).alias("value")) for p, n in zip(points, names)])
    return found.select(F.explode(rows).alias("r")).select("r.*")
