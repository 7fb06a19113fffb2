"""The scalar functions as temporary SQL functions, inlined by Catalyst as any expression."""

from __future__ import annotations

from pyspark.sql import SparkSession

from peakloom.functions import scalar

#: name -> (parameters, type, body)
SQL_FUNCTIONS = {
    "shard_of": ("parent STRING", "INT", f"CAST(CAST(conv(substr(sha2(parent, 256), 1, 16), 16, 10) AS DECIMAL(20,0)) % {scalar.SHARDS} AS INT)"),
    "spectrum_uid": ("parent STRING, idx INT", "STRING", "format_string('%s:%02d', parent, idx)"),
    "bin_index": ("mz DOUBLE", "INT", f"try_cast(floor(mz * {(scalar.BINS - 1) / scalar.BIN_RANGE!r}D) + 1 AS INT)"),
    "mass_tolerance": ("mz DOUBLE, dp INT", "DOUBLE", f"""CASE WHEN dp >= {scalar.MIN_DECIMALS} THEN greatest(mz * {scalar.PPM * 1e-6!r}D,
        0.5D * pow(10D, -dp)) ELSE mz * {scalar.PPM * 1e-6!r}D END"""),
    "ppm_error": ("mz DOUBLE, theory DOUBLE", "DOUBLE", "(mz - theory) / theory * 1e6D"),
    "safe_ratio": ("a DOUBLE, b DOUBLE", "DOUBLE", "a / nullif(b, 0D)"),
    "softplus": ("x DOUBLE", "DOUBLE", "greatest(x, 0D) + log1p(exp(-abs(x)))"),
    "sigmoid": ("x DOUBLE", "DOUBLE", "1D / (1D + exp(-x))"),
    "huber": ("d DOUBLE, delta DOUBLE", "DOUBLE", "CASE WHEN abs(d) <= delta THEN d * d / 2D ELSE delta * (abs(d) - delta / 2D) END"),
}


def register_all(spark: SparkSession, prefix: str = "") -> list[str]:
    """Create or replace the functions; their names."""
    for name, (parameters, kind, body) in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {prefix}{name}({parameters}) RETURNS {kind} RETURN {body}")
    return [prefix + name for name in SQL_FUNCTIONS]
