"""Nested spectra to long relations and back. Long form inside, nested at the edges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def distinct_spectra(df: DataFrame, key: str = "spectrum_uid") -> DataFrame:
    """One row per key; of differing rows the smallest by content, whatever the row order."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min(F.struct(*rest)).alias("row")).select(key, "row.*")


def explode_lists(df: DataFrame, key: str, index: str, lists: dict[str, str], keep: Sequence[str] = (), outer: bool = False) -> DataFrame:
    """Parallel lists as rows: (key, keep.., index from 0, one column per list). lists: column -> output name.

    Shorter lists are filled with nulls. outer keeps a row with a null index for empty and null lists.
    """
    zipped = F.arrays_zip(*[F.coalesce(F.col(c), F.array().cast(df.schema[c].dataType)).alias(n) for c, n in lists.items()])
    generate = F.posexplode_outer if outer else F.posexplode
    return df.select(key, *keep, generate(zipped).alias(index, "item")).select(key, *keep, index, *[F.col("item")[n].alias(n) for n in lists.values()])


#: A position that lacks an m/z or an intensity is no peak.
IS_PEAK = "mz IS NOT NULL AND y IS NOT NULL AND NOT isnan(y)"


def peaks(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(spectrum_uid, keep.., peak_index, mz, y, dp): a position lacking an m/z or an intensity is no peak."""
    lists = {"mzs": "mz", "intensities": "y", "mz_decimal_places": "dp"}
    long = explode_lists(df, "spectrum_uid", "peak_index", lists, keep)
    return long.where(IS_PEAK).withColumn("y", F.col("y").cast("double"))


def candidates(df: DataFrame) -> DataFrame:
    lists = {"candidate_neutral_formula": "formula", "candidate_ion_state": "ion_state", "candidate_theoretical_mz": "theo_mz"}
    return explode_lists(df, "spectrum_uid", "candidate_index", lists)


def edges(df: DataFrame) -> DataFrame:
    lists = {"edge_peak_index": "peak_index", "edge_candidate_index": "candidate_index", "edge_error_ppm": "error_ppm"}
    return explode_lists(df, "spectrum_uid", "edge_index", lists)


def nest(df: DataFrame, key: str, order: Sequence[str], lists: dict[str, str]) -> DataFrame:
    """Rows back to parallel lists in a total order. lists: column -> output name."""
    rows = F.array_sort(F.collect_list(F.struct(*order, *[c for c in lists if c not in order])))
    return df.groupBy(key).agg(rows.alias("rows")).select(key, *[F.col("rows")[c].alias(n) for c, n in lists.items()])


def supervision_mask(edge_count: Column, decimals: Column, least: int = 2) -> Column:
    return (edge_count > 0) & (decimals >= least)


def linked_mask(edge_peaks: Column, decimals: Column, least: int = 2) -> Column:
    """ARRAY<BOOLEAN>, aligned with decimals: whether a peak has an edge and enough decimals.

    Positions are marked by hashed set operations and one sort, not by a search of the list for every peak.
    """
    linked = F.coalesce(edge_peaks, F.array().cast("array<int>"))
    places = F.transform(decimals, lambda _, i: i)
    marked = lambda at, on: F.transform(at, lambda i: F.struct(i.alias("i"), F.lit(on).alias("on")))
    flags = F.array_sort(F.concat(marked(F.array_intersect(places, linked), True), marked(F.array_except(places, linked), False)))
    return F.transform(F.arrays_zip(flags.alias("f"), decimals.alias("dp")), lambda p: p["f"]["on"] & (p["dp"] >= least))


def supervision_rank(mzs: Column, intensities: Column, mask: Column) -> Column:
    """ARRAY<INT>: place of each masked peak by intensity descending, m/z ascending, position; -1 elsewhere.

    Null and NaN intensities come last.
    Two sorts inside the row, so that spectra need no shuffle and long ones stay n log n.
    """
    zipped = F.arrays_zip(mzs.alias("mz"), intensities.alias("y"), mask.alias("on"))
    numbered = F.transform(zipped, lambda p, i: F.struct(F.coalesce(F.nanvl(-p["y"].cast("double"), F.lit(float("inf"))),
        F.lit(float("inf"))).alias("low"), p["mz"].alias("mz"), i.alias("i"), F.coalesce(p["on"], F.lit(False)).alias("on")))
    chosen = F.array_sort(F.filter(numbered, lambda p: p["on"]))
    ranked = F.transform(chosen, lambda p, r: F.struct(p["i"].alias("i"), r.alias("r")))
    others = F.transform(F.filter(numbered, lambda p: ~p["on"]), lambda p: F.struct(p["i"].alias("i"), F.lit(-1).alias("r")))
    return F.transform(F.array_sort(F.concat(ranked, others)), lambda p: p["r"])


def targets(rank: Column, slots: int = 64) -> Column:
    """ARRAY<INT>: the supervised positions whose rank is below slots, in order of rank."""
    pairs = F.transform(rank, lambda r, i: F.struct(r.alias("r"), i.alias("i")))
    return F.transform(F.array_sort(F.filter(pairs, lambda p: (p["r"] >= 0) & (p["r"] < slots))), lambda p: p["i"])


def has_target(rank: Column, slots: int = 64) -> Column:
    return F.coalesce(F.exists(rank, lambda r: (r >= 0) & (r < slots)), F.lit(False))


def linked_edges(df: DataFrame, slots: int = 64) -> DataFrame:
    """Edges whose peak is a target, with the target's index, which is the peak's rank.

    ``df``: nested spectra. In-row lookup: no join.
    """
    rank = F.element_at(F.col("supervision_rank"), F.col("peak_index") + 1)
    lists = {"edge_peak_index": "peak_index", "edge_candidate_index": "candidate_index", "edge_error_ppm": "error_ppm"}
    long = explode_lists(df, "spectrum_uid", "edge_index", lists, keep=("supervision_rank",))
    known = F.size("supervision_rank") > F.col("peak_index")
    return long.withColumn("target", F.when(known, rank)).where(F.col("target").between(0, slots - 1)).drop("supervision_rank")


def bags(df: DataFrame, slots: int = 64) -> DataFrame:
    """(spectrum_uid, target, formula, ion_state) distinct: the identities that may explain each target."""
    return linked_edges(df, slots).join(candidates(df), ["spectrum_uid", "candidate_index"]).select("spectrum_uid", "target", "formula", "ion_state").distinct()
