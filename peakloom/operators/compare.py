"""Reconciliation and reproducibility of two tables by key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def reconcile(source: DataFrame, artifact: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(status, n): rows missing on either side, rows whose columns differ, and equal rows. Keys must be unique."""
    a = source.select(key, F.struct(*columns).alias("a"), F.lit(1).alias("in_a"))
    b = artifact.select(key, F.struct(*columns).alias("b"), F.lit(1).alias("in_b"))
    status = F.when(F.col("in_b").isNull(), "missing").when(F.col("in_a").isNull(), "extra").when(F.col("a").eqNullSafe(F.col("b")),
        "equal").otherwise("different")
    return a.join(b, key, "full_outer").groupBy(status.alias("status")).agg(F.count("*").alias("n"))


def compare_predictions(a: DataFrame, b: DataFrame, key: str = "spectrum_uid", identities: Sequence[str] = ("predicted_formulas",
    "predicted_ion_states"), values: str = "predicted_intensities") -> DataFrame:
    """(shared, identical, max_difference): spectra on both sides, how many have equal identities, and the greatest intensity difference of those."""
    x = a.select(key, F.struct(*identities).alias("ia"), F.col(values).alias("va"))
    y = b.select(key, F.struct(*identities).alias("ib"), F.col(values).alias("vb"))
    joined = x.join(y, key).withColumn("same", F.col("ia").eqNullSafe(F.col("ib")))
    gap = F.array_max(F.transform(F.arrays_zip("va", "vb"), lambda p: F.abs(p["va"] - p["vb"])))
    return joined.agg(F.count("*").alias("shared"), F.count_if("same").alias("identical"), F.max(F.when(F.col("same"), gap)).alias("max_difference"))


def variants(base: DataFrame, others: dict[str, DataFrame], **options: object) -> DataFrame:
    """compare_predictions of base with each variant, tagged."""
    out = None
    for name, df in others.items():
        row = compare_predictions(base, df, **options).withColumn("variant", F.lit(name))
        out = row if out is None else out.unionByName(row)
    return out


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(rows, digest): one number of a table that doesn't depend on row order or partitioning."""
    return df.agg(F.count("*").alias("rows"), F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("digest"))
