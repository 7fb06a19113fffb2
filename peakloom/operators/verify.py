"""Integrity checks: each is a row (check_name, violations, example); a gate raises if any violation is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import scalar
from peakloom.operators import spectra as long


def rows_fail(df: DataFrame, checks: dict[str, Column], example: str = "spectrum_uid") -> DataFrame:
    """All row-wise checks in one scan; a null condition fails."""
    sums, least = [], []
    for name, bad in checks.items():
        bad = F.coalesce(bad, F.lit(True))
        sums.append(F.count_if(bad).alias(f"n_{name}"))
        least.append(F.min(F.when(bad, F.col(example))).alias(f"e_{name}"))
    wide = df.agg(*sums, *least)
    rows = [F.struct(F.lit(n).alias("check_name"), F.col(f"n_{n}").alias("violations"), F.col(f"e_{n}").cast("string").alias("example")) for n in checks]
    return wide.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def duplicates(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Rows beyond the first of each key."""
    counted = df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.lit(name).alias("check_name"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"),
        F.min(F.concat_ws("|", *[F.col(k).cast("string") for k in keys])).alias("example"))


def spans(df: DataFrame, key: str, group: Column, name: str) -> DataFrame:
    """Keys that occur in more than one group; two extremes tell, so nothing is collected per key."""
    per = df.select(F.col(key).alias("k"), group.alias("g")).where("k IS NOT NULL").groupBy("k").agg(F.min("g").alias("lo"),
        F.max("g").alias("hi")).where("lo < hi")
    return per.agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"), F.min("k").alias("example"))


def unsorted_rows(df: DataFrame, order: Sequence[str], name: str, file: Column | None = None) -> DataFrame:
    """Rows that lie before their predecessor in the physical order of their file."""
    path = F.input_file_name() if file is None else file
    at = df.select(F.struct(*order).alias("o"), path.alias("file"), F.monotonically_increasing_id().alias("id"))
    before = F.lag("o").over(Window.partitionBy("file").orderBy("id"))
    return at.withColumn("p", before).where("p > o").agg(F.lit(name).alias("check_name"), F.count("*").alias("violations"),
        F.min(F.col("o").cast("string")).alias("example"))


def layout_checks(df: DataFrame, shards: int, order: Sequence[str] = ("parent_spec", "collision_index"), file: Column | None = None) -> DataFrame:
    """Whether rows lie where they belong: fold and shard as the folder says, the shard that the parent's hash gives, files in order.

    df is read from fold=../shard=../ folders; file gives a row's path and is the scan's own by default. Columns fold and
    shard may come from the folders or be stored.
    """
    path = F.input_file_name() if file is None else file
    placed = df.withColumn("__fold", F.regexp_extract(path, "/fold=([^/]+)/", 1)).withColumn("__shard", F.regexp_extract(path,
        "/shard=([0-9]+)/", 1).try_cast("int"))
    checks = {
        "fold_is_folder": F.col("fold") != F.col("__fold"), "shard_is_folder": F.col("shard") != F.col("__shard"),
        "shard_of_parent": F.col("shard") != scalar.shard_of("parent_spec", shards), "shard_in_range": ~F.col("shard").between(0, shards - 1),
    }
    return rows_fail(placed, checks, "parent_spec").unionByName(unsorted_rows(df, order, "rows_in_order", file))


def spectra_checks(df: DataFrame) -> DataFrame:
    """Lengths, keys and folds of a spectra table."""
    n = F.size("mzs")
    lengths = (F.size("intensities") != n) | (F.size("mz_decimal_places") != n)
    out = rows_fail(df, {"parallel_lengths": lengths, "fold_domain": ~F.col("fold").isin("train", "valid", "test"),
        "uid_form": F.col("spectrum_uid") != scalar.spectrum_uid("parent_spec", "collision_index")})
    out = out.unionByName(duplicates(df, ["spectrum_uid"], "uid_unique"))
    out = out.unionByName(spans(df, "parent_spec", F.col("fold"), "parent_in_one_fold"))
    return out.unionByName(spans(df, "inchikey", F.col("fold"), "inchikey_in_one_fold"))


def supervision_checks(df: DataFrame, ppm: float = scalar.PPM, slack: float = 1e-6) -> DataFrame:
    """Index ranges, distinct candidates, masks, ranks and tolerances of a supervision table."""
    n, c = F.size("mzs"), F.size("candidate_neutral_formula")
    pair = F.arrays_zip(F.col("candidate_neutral_formula").alias("f"), F.col("candidate_ion_state").alias("i"))
    mask = long.linked_mask(F.col("edge_peak_index"), F.col("mz_decimal_places"), scalar.MIN_DECIMALS)
    edge = F.arrays_zip(F.col("edge_peak_index").alias("p"), F.col("edge_candidate_index").alias("c"))

    def outside(e: Column) -> Column:
        mz, theo = F.get(F.col("mzs"), e["p"]), F.get(F.col("candidate_theoretical_mz"), e["c"])
        tolerance = scalar.mass_tolerance(mz, F.get(F.col("mz_decimal_places"), e["p"]), ppm)
        return F.coalesce(F.abs(mz - theo) > tolerance + slack, F.lit(True))

    checks = {
        "parallel_lengths": (F.size("intensities") != n) | (F.size("mz_decimal_places") != n) | (F.size("supervision_mask") != n) | (F.size("supervision_rank") != n),
        "candidate_lengths": (F.size("candidate_ion_state") != c) | (F.size("candidate_theoretical_mz") != c),
        "edge_lengths": (F.size("edge_candidate_index") != F.size("edge_peak_index")) | (F.size("edge_error_ppm") != F.size("edge_peak_index")),
        "edge_ranges": F.coalesce((F.array_min("edge_peak_index") < 0) | (F.array_max("edge_peak_index") >= n) | (F.array_min("edge_candidate_index") < 0) | (F.array_max("edge_candidate_index") >= c), F.size("edge_peak_index") != 0),
        "candidates_distinct": F.size(F.array_distinct(pair)) != F.size(pair),
        "mask_reproducible": ~F.col("supervision_mask").eqNullSafe(mask),
        "rank_reproducible": ~F.col("supervision_rank").eqNullSafe(long.supervision_rank(F.col("mzs"), F.col("intensities"), F.col("supervision_mask"))),
        "low_precision_supervised": F.exists(F.arrays_zip("mz_decimal_places", "supervision_mask"),
        lambda p: (p["mz_decimal_places"] < scalar.MIN_DECIMALS) & p["supervision_mask"]),
        "edges_within_tolerance": F.exists(edge, outside),
        "no_test_fold": F.lower("fold") == "test",
    }
    return rows_fail(df, checks).unionByName(duplicates(df, ["spectrum_uid"], "uid_unique"))


def manifest_checks(counts: DataFrame, manifest: dict) -> DataFrame:
    """Counts of the table against those a manifest claims: (check_name, violations, example). counts: one row."""
    rows = [F.struct(F.lit(f"manifest_{k}").alias("check_name"), F.abs(F.col(k) - F.lit(int(v))).cast("bigint").alias("violations"),
        F.col(k).cast("string").alias("example")) for k, v in manifest.items()]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def counters(df: DataFrame, by: Sequence[str] = ("fold",), parent: str = "parent_spec") -> DataFrame:
    """Parents, spectra and peaks by every prefix of ``by`` and overall, in one pass."""
    return df.rollup(*by).agg(F.count_distinct(parent).alias("parents"), F.count("*").alias("spectra"), F.sum(F.greatest(F.size("mzs"),
        F.lit(0))).alias("peaks"), F.grouping_id().alias("level"))


def gate(checks: DataFrame, ignore: Sequence[str] = ()) -> None:
    """Raise if a check outside ``ignore`` has violations. The table has a row per check."""
    bad = [r for r in checks.where("violations > 0").collect() if r["check_name"] not in ignore]
    if bad:
        raise ValueError("; ".join(f"{r['check_name']}: {r['violations']} ({r['example']})" for r in bad))
