"""Subformula enumeration and the precision-aware interval join of peaks with candidate masses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from peakloom.functions import chem, scalar
from peakloom.functions.elements import MASSES
from peakloom.operators import spectra as long
from peakloom.session import spread

HEAVY_CAP, PEAK_CAP = 4_000_000, 100_000
BUCKET = 0.05
#: Width of a bucket of masses modulo hydrogen's: about twice a usual tolerance.
RESIDUE = 0.01


def formula_axes(formulas: DataFrame, column: str = "formula") -> DataFrame:
    """(formula, size, max_h, heaviest, axis) of every distinct formula that can be read: its dimension.

    axis: its heavy elements in alphabetical order, each with its count n, mass, the hydrogens an atom adds to what a
    molecule can hold, and its stride: a subformula without hydrogen is one number, its code, in which the element's
    count is the digit code / stride modulo n + 1. size: how many codes there are. heaviest: the mass of all heavy atoms.
    """
    distinct = spread(formulas.select(F.col(column).alias("formula")).distinct(), "formula")
    # Through a generator: a filter on the parsed map would be pushed below the distinct and parse every row.
    parsed = distinct.select("formula", F.explode(F.array_compact(F.array(chem.parse_formula("formula")))).alias("parsed"))
    entries = F.array_sort(F.map_entries(F.map_filter("parsed", lambda s, _: s != "H")))

    def element(e: Column, at: Column) -> Column:
        after = F.aggregate(F.slice("entries", at + 2, F.size("entries")), F.lit(1).cast("bigint"), lambda acc, x: F.when(acc > HEAVY_CAP,
            acc).otherwise(acc * (x["value"] + 1)))
        return F.struct(e["key"].alias("symbol"), e["value"].alias("n"), chem.element_mass(e["key"]).alias("mass"),
            bonds(e["key"]).alias("bonds"), after.alias("stride"))

    sized = parsed.select("formula", chem.heavy_subformulas("parsed").alias("size"), chem.count("parsed", "H").alias("max_h"), entries.alias("entries"))
    axes = sized.withColumn("axis", F.transform("entries", element))
    heaviest = F.aggregate("axis", F.lit(0.0), lambda acc, e: acc + e["n"].cast("double") * e["mass"])
    return axes.select("formula", "size", "max_h", heaviest.alias("heaviest"), "axis")


def heavy_subformulas(formulas: DataFrame, cap: int = HEAVY_CAP, column: str = "formula", excess: str = "raise") -> DataFrame:
    """(formula, max_h, axis, code, heavy_mass, top_h) of every distinct formula that can be read.

    code runs over all subformulas without hydrogen, the empty one (0) included. Hydrogen stays analytic: a
    subformula is (code, h) with h from 0 to max_h, and it is plausible by valence if h is at most top_h. A formula with
    more than cap heavy subformulas is an error, found before anything is enumerated; with excess="skip" it has
    none, and problems() counts it. Enumeration is one generator and arithmetic: no array of a formula's
    subformulas is sorted or kept, whatever their number.
    """
    if excess not in ("raise", "skip"):
        raise ValueError("excess must be raise or skip")
    axes = formula_axes(formulas, column)
    if excess == "raise":
        over = F.raise_error(F.concat(F.lit("too many heavy subformulas: "), "formula"))
        axes = axes.withColumn("size", F.when(F.col("size") > cap, over.cast("bigint")).otherwise(F.col("size")))
    # Few rows that grow a thousandfold.
    each = axes.where((F.col("size") > 0) & (F.col("size") <= cap)).select("formula", "max_h", "axis",
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1)).alias("code"))
    start = F.struct(F.lit(0.0).alias("mass"), F.lit(2).alias("top_h"))

    def add(acc: Column, e: Column) -> Column:
        k = digit("code", e)
        return F.struct((acc["mass"] + k.cast("double") * e["mass"]).alias("mass"), (acc["top_h"] + k * e["bonds"]).alias("top_h"))

    summed = each.withColumn("s", F.aggregate("axis", start, add))
    return summed.select("formula", "max_h", "axis", "code", F.col("s.mass").alias("heavy_mass"), F.col("s.top_h").alias("top_h"))


def digit(code: Column | str, e: Column) -> Column:
    """The count that a code gives an element of the axis."""
    c = F.col(code) if isinstance(code, str) else code
    return F.pmod(F.floor(c / e["stride"]), e["n"] + 1).cast("int")


def rank_by_mass(heavy: DataFrame) -> DataFrame:
    """heavy with heavy_rank: the order of a formula's subformulas by mass, ties by enumeration."""
    order = Window.partitionBy("formula").orderBy("heavy_mass", "code")
    return heavy.withColumn("heavy_rank", F.row_number().over(order) - 1)


def bonds(symbol: Column) -> Column:
    """How many hydrogens an atom adds to what a molecule can hold."""
    return F.when(symbol.isin(*chem.FOUR_BONDS), 2).when(symbol.isin(*chem.THREE_BONDS), 1).when(symbol.isin(*chem.ONE_BOND), -1).otherwise(0)


def subformula(axis: Column | str, code: Column | str, h: Column | str) -> Column:
    """The map of a subformula, elements with a count of 0 left out."""
    axis = F.col(axis) if isinstance(axis, str) else axis
    h = F.col(h) if isinstance(h, str) else h
    heavy = F.transform(axis, lambda e: F.struct(e["symbol"].alias("symbol"), digit(code, e).alias("n")))
    entries = F.array_append(heavy, F.struct(F.lit("H").alias("symbol"), h.cast("int").alias("n")))
    return F.map_from_entries(F.filter(entries, lambda e: e["n"] > 0))


def problems(spectra: DataFrame, cap: int = HEAVY_CAP) -> DataFrame:
    """(reason, spectra, formulas): why spectra can have no candidates, each counted under the first reason that applies.

    ``not_a_formula``, ``count_out_of_range`` and ``too_many_subformulas`` by formula, then ``unsupported_adduct``; a null
    formula is no formula, a null adduct unsupported. Spectra without a problem aren't listed.
    """
    named = spread(spectra.select("formula").distinct(), "formula")
    size = chem.heavy_subformulas(chem.parse_formula("formula"))
    reason = F.coalesce(chem.formula_problem("formula"), F.when(size > cap, "too_many_subformulas"))
    bad = named.select("formula", reason.alias("of_formula")).where("of_formula IS NOT NULL")
    counted = spectra.groupBy("formula", "adduct").agg(F.count("*").alias("n"))
    of_adduct = F.when(chem.ion_channels("adduct").isNull(), "unsupported_adduct")
    joined = counted.join(bad.withColumnRenamed("formula", "f"), F.col("formula").eqNullSafe(F.col("f")), "left").withColumn("reason",
        F.coalesce("of_formula", of_adduct))
    per = joined.where("reason IS NOT NULL").groupBy("reason", "formula").agg(F.sum("n").alias("n"))
    return per.groupBy("reason").agg(F.sum("n").alias("spectra"), F.count("*").alias("formulas"))


def interval_join(probe: DataFrame, build: DataFrame, low: str, high: str, value: str, on: tuple[str, ...] = (), width: float = BUCKET,
    strategy: str = "merge", broadcast_rows: int = 0) -> DataFrame:
    """Pairs with probe.low <= build.value <= probe.high, by an equi join on (on.., bucket of width) and a residual.

    A probe row goes to every bucket its interval meets, a build row to one, so that each pair comes out
    once. The result doesn't depend on width; it should be about the length of an interval.

    strategy is a join hint. The planner sizes an exploded side by what it was before, and would broadcast it
    where it looks small; so the default names a join that spills. A build side of at most broadcast_rows rows,
    which are counted, is broadcast instead.
    """
    w = F.lit(float(width))
    first, last = F.floor(F.col(low) / w), F.floor(F.col(high) / w)
    left = probe.where(F.col(low) <= F.col(high)).withColumn("__bucket", F.explode(F.sequence(first, last)))
    right = build.withColumn("__bucket", F.floor(F.col(value) / w))
    if broadcast_rows and build.limit(broadcast_rows + 1).count() <= broadcast_rows:
        right = F.broadcast(right)
    else:
        left = left.hint(strategy)
    return left.join(right, [*on, "__bucket"]).where(F.col(value).between(F.col(low), F.col(high))).drop("__bucket")


def match_edges(
    spectra: DataFrame, ppm: float = scalar.PPM, peak_cap: int = PEAK_CAP, heavy_cap: int = HEAVY_CAP, width: float = RESIDUE,
        valence: bool = True, excess: str = "raise",
) -> DataFrame:
    """(spectrum_uid, formula, peak_index, mz, channel, h, code, heavy_mass, theo_mz, error_ppm) of all peak-candidate pairs.

    spectra: one row per spectrum_uid with formula, adduct and the peak lists. A candidate is a subformula
    but the empty one under an ion channel of the adduct, within the tolerance of the peak. Rows whose
    formula or adduct can't be read have no edges; problems() counts them by reason. More than peak_cap raw candidates
    of a peak are an error, or with excess="skip" the peak has no edges, as have formulas beyond heavy_cap
    (crowded_peaks and problems count them); the valence filter comes after that check. The rows lie partitioned by spectrum.
    """
    hits = raw_hits(spectra, ppm, heavy_cap, width, excess)
    # One shuffle by spectrum: this window and those of number_candidates then find their rows together.
    raw = F.count("*").over(Window.partitionBy("spectrum_uid", "peak_index"))
    hits = hits.repartition("spectrum_uid").withColumn("raw", raw)
    if excess == "raise":
        hits = hits.where(F.when(F.col("raw") > peak_cap, F.raise_error(F.lit("too many candidates of a peak")).cast("boolean")).otherwise(F.lit(True)))
    else:
        hits = hits.where(F.col("raw") <= peak_cap)
    if valence:
        hits = hits.where("h <= top_h")
    return hits.select(
        "spectrum_uid", "formula", "peak_index", "mz", "channel", "h", "code", "heavy_mass", "theo_mz", scalar.ppm_error("mz",
        "theo_mz").cast("float").alias("error_ppm")
    )


def raw_hits(spectra: DataFrame, ppm: float = scalar.PPM, heavy_cap: int = HEAVY_CAP, width: float = RESIDUE, excess: str = "raise") -> DataFrame:
    """Pairs within tolerance, before any cap or valence filter.

    A peak and a candidate differ by a whole number of hydrogens, so their masses agree modulo the mass of one: peaks and
    heavy masses meet in buckets of that residue, of about ``width``, and the number of hydrogens follows from the difference.
    A peak is thus one or two rows in the join, not one for every number of hydrogens. The result doesn't depend on width.
    """
    hydrogen = MASSES["H"]
    buckets = max(1, round(hydrogen / width))
    of = lambda mass: F.floor(mass / F.lit(hydrogen / buckets))
    axes = formula_axes(spectra.select("formula")).select("formula", "max_h")
    known = spectra.select("spectrum_uid", "formula", "mzs", "mz_decimal_places", F.explode(chem.ion_channels("adduct")).alias("channel")).join(axes, "formula")
    zipped = F.arrays_zip(F.col("mzs").alias("mz"), F.col("mz_decimal_places").alias("dp"))
    reach = F.col("tolerance") + F.lit(1e-7)
    first, last = of(F.col("room") - reach), of(F.col("room") + reach)
    probe = (
        known.select("spectrum_uid", "formula", "channel", "max_h", chem.channel_offset("channel").alias("offset"),
            F.posexplode(zipped).alias("peak_index", "p"))
        .select("spectrum_uid", "formula", "channel", "peak_index", "max_h", "offset", F.col("p.mz").alias("mz"), F.col("p.dp").alias("dp"))
        .where("mz IS NOT NULL AND abs(mz) < 1e9")
        .withColumn("tolerance", scalar.mass_tolerance("mz", "dp", ppm) + F.lit(scalar.EPSILON))
        .withColumn("room", F.col("mz") - F.col("offset"))
        .withColumn("bucket", F.explode(F.sequence(first, F.least(last, first + (buckets - 1)))))
        .select("spectrum_uid", "formula", "channel", "peak_index", "mz", "tolerance", "room", "max_h", "offset", F.pmod("bucket",
            F.lit(buckets)).alias("bucket"))
    )
    heavy = heavy_subformulas(spectra.select("formula"), heavy_cap, excess=excess)
    heavy = heavy.select("formula", "code", "heavy_mass", "top_h", F.pmod(of(F.col("heavy_mass")), F.lit(buckets)).alias("bucket"))
    # The planner sizes an exploded side by what it was before, and would broadcast it; a merge spills.
    pairs = probe.hint("merge").join(heavy, ["formula", "bucket"])
    rest = F.col("room") - F.col("heavy_mass")
    least_h = F.greatest(F.lit(0.0), F.ceil((rest - reach) / F.lit(hydrogen)).cast("double"))
    most_h = F.least(F.col("max_h").cast("double"), F.floor((rest + reach) / F.lit(hydrogen)).cast("double"))
    return (
        pairs.where(least_h <= most_h)
        .withColumn("h", F.explode(F.sequence(least_h.cast("int"), most_h.cast("int"))))
        .withColumn("theo_mz", scalar.theoretical_mz("heavy_mass", "h", hydrogen, F.col("offset")))
        .where(F.abs(F.col("mz") - F.col("theo_mz")) <= F.col("tolerance"))
        .where((F.col("h") > 0) | (F.col("heavy_mass") > 0))
    )


def crowded_peaks(spectra: DataFrame, ppm: float = scalar.PPM, peak_cap: int = PEAK_CAP, heavy_cap: int = HEAVY_CAP) -> DataFrame:
    """(spectrum_uid, peak_index, raw) of the peaks with more than peak_cap raw candidates: counted, partially before the shuffle."""
    hits = raw_hits(spectra, ppm, heavy_cap, excess="skip")
    return hits.groupBy("spectrum_uid", "peak_index").agg(F.count("*").alias("raw")).where(F.col("raw") > peak_cap)


def number_candidates(edges: DataFrame) -> DataFrame:
    """edges with candidate_index (dense, by channel, heavy mass and code, hydrogen) and edge_index (by channel, peak, hydrogen, heavy mass and code)."""
    c = chem.channel_index("channel")
    of = Window.partitionBy("spectrum_uid")
    return edges.withColumn("candidate_index", F.dense_rank().over(of.orderBy(c, "heavy_mass", "code", "h")) - 1).withColumn(
        "edge_index", F.row_number().over(of.orderBy(c, "peak_index", "h", "heavy_mass", "code")) - 1
    )


def count_candidates(edges: DataFrame) -> DataFrame:
    """Counts without identities: (spectrum_uid, edges, candidates, peaks)."""
    return edges.groupBy("spectrum_uid").agg(
        F.count("*").alias("edges"), F.count_distinct("channel", "code", "h").alias("candidates"), F.count_distinct("peak_index").alias("peaks")
    )


def build_supervision(spectra: DataFrame, ppm: float = scalar.PPM, peak_cap: int = PEAK_CAP, heavy_cap: int = HEAVY_CAP, excess: str = "raise") -> DataFrame:
    """spectra (one row per uid) with mask, rank, candidate and edge lists.

    Spectra without any candidate keep empty lists. Codes become formulas once per distinct candidate, by the axis of the
    spectrum's formula; subformulas are enumerated once.
    """
    numbered = number_candidates(match_edges(spectra, ppm, peak_cap, heavy_cap, excess=excess))
    per_edge = F.struct("edge_index", "peak_index", "candidate_index", "error_ppm")
    per_candidate = F.struct("candidate_index", F.col("channel").alias("ion_state"), "theo_mz", "code", "h")
    lists = numbered.groupBy("spectrum_uid").agg(F.array_sort(F.collect_list(per_edge)).alias("__e"), F.array_sort(F.collect_set(per_candidate)).alias("__c"))
    axes = formula_axes(spectra.select("formula")).select("formula", F.col("axis").alias("__axis"))
    joined = spectra.join(lists, "spectrum_uid", "left").join(axes, "formula", "left")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    out = joined.select(
        *[F.col(f"`{c}`") for c in spectra.columns],
        F.coalesce(F.transform("__c", lambda x: chem.hill(subformula("__axis", x["code"], x["h"]))), none("string")).alias("candidate_neutral_formula"),
        F.coalesce("__c.ion_state", none("string")).alias("candidate_ion_state"),
        F.coalesce("__c.theo_mz", none("double")).alias("candidate_theoretical_mz"),
        F.coalesce("__e.peak_index", none("int")).alias("edge_peak_index"),
        F.coalesce("__e.candidate_index", none("int")).alias("edge_candidate_index"),
        F.coalesce("__e.error_ppm", none("float")).alias("edge_error_ppm"),
    )
    mask = long.linked_mask(F.col("edge_peak_index"), F.col("mz_decimal_places"))
    return out.withColumn("supervision_mask", mask).withColumn("supervision_rank", long.supervision_rank(F.col("mzs"), F.col("intensities"),
        F.col("supervision_mask")))


def nearest_value(value: Column, values: Column) -> Column:
    """The smallest distance of a value to a list, null for an empty list."""
    return F.array_min(F.transform(values, lambda v: F.abs(v - value)))


def bucket_width(tolerance: float) -> float:
    """A width at which an interval of that half-length meets at most two buckets."""
    return max(2.0 * tolerance, 1e-6) if math.isfinite(tolerance) else BUCKET
