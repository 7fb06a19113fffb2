"""Binned spectra, cosines at K, comparison spaces, oracles and their summaries.

A binned spectrum is a sparse relation (key.., bin, v); the dense vector is never built. ``keys`` is the
list of columns that tell spectra (and conditions, spaces, oracles) apart, so that one plan scores all
of them at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from peakloom.functions import chem, scalar
from peakloom.operators import quantiles
from peakloom.operators import spectra as long
from peakloom.operators.quantiles import percentiles
from peakloom.session import spread

# Names of the oracles.
ORACLES = ("peak_copy", "support_mask", "formula_rendered", "slot_capacity")


def bin_observation(peaks: DataFrame, keys: Sequence[str], mz: str = "mz", y: str = "y", bins: int = scalar.BINS, span: float = scalar.BIN_RANGE) -> DataFrame:
    """(keys, bin, v): the largest intensity of each bin; peaks outside the range are dropped, not clamped."""
    binned = peaks.withColumn("bin", scalar.bin_index(mz, bins, span)).where(scalar.in_range("bin", bins))
    return binned.groupBy(*keys, "bin").agg(F.max(y).alias("v")).where("v > 0")


def sum_bins(peaks: DataFrame, keys: Sequence[str], mz: str = "mz", y: str = "y", bins: int = scalar.BINS, span: float = scalar.BIN_RANGE) -> DataFrame:
    """(keys, bin, v): the plain sum of each bin."""
    binned = peaks.withColumn("bin", scalar.bin_index(mz, bins, span)).where(scalar.in_range("bin", bins))
    return binned.groupBy(*keys, "bin").agg(F.sum(y).alias("v"))


def bin_prediction(peaks: DataFrame, keys: Sequence[str], mz: str = "mz", y: str = "y", dust: float = scalar.DUST, bins: int = scalar.BINS,
    span: float = scalar.BIN_RANGE) -> DataFrame:
    """(keys, bin, v, place): sums scaled to a largest value of 1, without bins below dust; place from 1 by falling v, then bin.

    One window gives both the largest value and the place: one sort.
    """
    order = Window.partitionBy(*keys).orderBy(F.col("v").desc(), "bin")
    placed = sum_bins(peaks, keys, mz, y, bins, span).withColumn("top", F.first("v").over(order)).withColumn("place", F.row_number().over(order))
    scaled = placed.where("top > 0").withColumn("v", F.col("v") / F.col("top"))
    return scaled.where((F.col("v") >= dust) & (F.col("v") > 0)).drop("top")


def top_bins(binned: DataFrame, keys: Sequence[str], k: int) -> DataFrame:
    """The k greatest bins of each spectrum; ties go to the lower bin."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col("v").desc(), "bin"))
    return binned.withColumn("place", rank).where(F.col("place") <= k).drop("place")


#: Spaces of the plain scores: prediction as it is, observation as the space has it.
PLAIN_SPACES = tuple(s for s in scalar.FOUR_SPACES if s[0] in scalar.SPACES)


def grid_cosines(
    observed: DataFrame, predicted: DataFrame, key: str, lists: Sequence[str], ks: Sequence[int] = scalar.TOP_K, spaces: Sequence[tuple[str,
        float, float]] = PLAIN_SPACES,
    dust: float = scalar.DUST, bins: int = scalar.BINS, span: float = scalar.BIN_RANGE,
) -> DataFrame:
    """(key, list, bins, cos_at_k_space..) of every spectrum and peak list that has a bin left.

    observed: (key, mz, y); predicted: (key, mz, a weight column for each of ``lists``, null where the row is no peak of that
    list), so that lists which share an m/z share a row. A bin of the observation is its largest intensity; a bin of a
    prediction is a sum, scaled to a largest value of 1, without bins below dust, and trimmed to its k greatest, ties to
    the lower bin. spaces: (name, exponent of the observation, exponent of the weights).

    Peaks of both sides are shuffled once, by key. Binning carries one sum per list and exponent as columns; only bins are
    spread into rows by list; the observation rides along in the bin, so that there is no join; places, norms and products are
    windows and sums over the same partitioning. A missing or empty prediction has no row: its cosine is 0.
    """
    powers = sorted({p for _, _, p in spaces})
    weights = [(name, power) for name in lists for power in powers]
    column = lambda i: f"__w{i}"
    powered = [F.when(F.col(n) > 0, F.pow(F.col(n).cast("double"), F.lit(float(p)))).alias(column(i)) for i, (n, p) in enumerate(weights)]
    own = observed.select(key, scalar.bin_index("mz", bins, span).alias("bin"), F.greatest(F.col("y").cast("double"), F.lit(0.0)).alias("o"))
    made = predicted.select(key, scalar.bin_index("mz", bins, span).alias("bin"), F.lit(None).cast("double").alias("o"), *powered)
    rows = own.select(key, "bin", "o", *[F.lit(None).cast("double").alias(column(i)) for i in range(len(weights))]).unionByName(made).where(scalar.in_range("bin", bins))
    grid = rows.repartition(key).groupBy(key, "bin").agg(F.max("o").alias("o"), *[F.sum(column(i)).alias(column(i)) for i in range(len(weights))])
    whole = Window.partitionBy(key)
    o = F.coalesce(F.col("o"), F.lit(0.0))
    norms = {p: f"__n{i}" for i, p in enumerate(sorted({p for _, p, _ in spaces}))}
    grid = grid.withColumn("o", o).select("*", *[F.sqrt(F.sum(F.pow("o", F.lit(2.0 * p))).over(whole)).alias(n) for p, n in norms.items()])
    entries = [F.when(F.col(column(i)) > 0, F.struct(F.lit(n).alias("list"), F.lit(float(p)).alias("power"),
        F.col(column(i)).alias("v"))) for i, (n, p) in enumerate(weights)]
    each = grid.select(key, "bin", "o", *norms.values(), F.explode(F.array_compact(F.array(*entries))).alias("e")).select(key, "bin", "o",
        *norms.values(), "e.*")
    order = Window.partitionBy(key, "list", "power").orderBy(F.col("v").desc(), "bin")
    placed = each.withColumn("top", F.first("v").over(order)).withColumn("place", F.row_number().over(order)).withColumn("v",
        F.col("v") / F.col("top")).where(F.col("v") >= dust)
    sums = [F.count_if(F.col("power") == spaces[0][2]).alias("bins")]
    for name, of_observation, of_weight in spaces:
        for k in ks:
            inside = (F.col("power") == of_weight) & (F.col("place") <= k)
            dot = F.sum(F.when(inside, F.col("v") * F.pow("o", F.lit(of_observation))))
            norm = F.sqrt(F.sum(F.when(inside, F.col("v") * F.col("v"))))
            sums.append(F.coalesce(dot / F.nullif(norm * F.max(norms[of_observation]), F.lit(0.0)), F.lit(0.0)).alias(f"cos_at_{k}_{name}"))
    return placed.groupBy(key, "list").agg(*sums)


def score_predictions(predicted: DataFrame, peaks: DataFrame, spine: DataFrame, key: str = "spectrum_uid", ks: Sequence[int] = scalar.TOP_K) -> DataFrame:
    """One row per key of spine: cos_at_k_space.., predicted_peaks, predicted_bins, collisions, out_of_range, zero_prediction.

    predicted: (key, mz, weight), peaks: (key, mz, y). Spectra without a prediction score 0.
    """
    scored = grid_cosines(peaks, predicted, key, ["weight"], ks)
    inside = scalar.in_range(scalar.bin_index("mz"))
    shape = predicted.groupBy(key).agg(F.count("*").alias("predicted_peaks"), F.count_if(inside).alias("inside"))
    out = spine.select(key).join(scored, key, "left").join(shape, key, "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("bigint"))
    return out.select(
        key,
        *[F.coalesce(f"cos_at_{k}_{s}", F.lit(0.0)).alias(f"cos_at_{k}_{s}") for s in scalar.SPACES for k in ks],
        zero("predicted_peaks").alias("predicted_peaks"),
        zero("bins").alias("predicted_bins"),
        F.greatest(zero("inside") - zero("bins"), F.lit(0)).alias("collisions"),
        (zero("predicted_peaks") - zero("inside")).alias("out_of_range"),
        (zero("bins") == 0).alias("zero_prediction"),
    )


def summarise_scores(scores: DataFrame, ks: Sequence[int] = scalar.TOP_K, by: Sequence[str] = ()) -> DataFrame:
    """Mean, median, 10th and 90th percentile of each cosine, and the predictions' shape."""
    aggs: list[Column] = [F.count("*").alias("spectra")]
    wanted = []
    for s in scalar.SPACES:
        for k in ks:
            c = f"cos_at_{k}_{s}"
            aggs.append(F.avg(c).alias(f"{c}_mean"))
            wanted += percentiles(c, (0.1, 0.5, 0.9), c)
    aggs += [
        F.avg("predicted_peaks").alias("predicted_peaks_mean"), F.max("predicted_peaks").alias("predicted_peaks_max"),
            F.avg("predicted_bins").alias("predicted_bins_mean"),
        F.count_if("zero_prediction").alias("zero_predictions"), F.sum("out_of_range").alias("out_of_range"), F.sum("collisions").alias("collisions"),
        scalar.safe_ratio(F.sum("collisions"), F.sum("predicted_peaks")).alias("collision_rate"),
    ]
    return quantiles.aggregate(scores, by, aggs, wanted)


def root_intensity(y: Column | str) -> Column:
    y = F.col(y) if isinstance(y, str) else y
    return F.sqrt(F.greatest(y.cast("double"), F.lit(0.0)))


def transformed(peaks: DataFrame, key: str = "spectrum_uid", eps: float = 1e-12) -> DataFrame:
    """peaks with t: the root intensity over the norm of the whole spectrum."""
    positive = F.greatest(F.col("y"), F.lit(0.0))
    norm = F.sqrt(F.sum(positive).over(Window.partitionBy(key)))
    return peaks.withColumn("t", F.sqrt(positive) / (norm + F.lit(eps)))


def formula_masses(df: DataFrame, column: str = "formula", name: str = "mass") -> DataFrame:
    """(column, name) of every distinct formula that has a mass: parsed once each, not once per row."""
    return spread(df.select(column).distinct(), column).withColumn(name, chem.mass(chem.parse_formula(column))).where(F.col(name).isNotNull())


def first_candidates(df: DataFrame) -> DataFrame:
    """(spectrum_uid, peak_index, candidate_index) of the first edge of each peak."""
    return long.edges(df).groupBy("spectrum_uid", "peak_index").agg(F.min_by("candidate_index", "edge_index").alias("candidate_index"))


def rendered_peaks(df: DataFrame) -> DataFrame:
    """(spectrum_uid, peak_index, mz, rendered, rank, weight) of every peak.

    rendered is the m/z of its first candidate, null where it has none or the candidate's formula can't be read; weight is the
    root intensity.
    """
    observed = long.peaks(df).withColumn("weight", root_intensity("y"))
    rank = long.explode_lists(df, "spectrum_uid", "peak_index", {"supervision_rank": "rank"})
    named = first_candidates(df).join(long.candidates(df).drop("theo_mz"), ["spectrum_uid", "candidate_index"])
    mass = F.col("mass") + F.coalesce(chem.channel_offset("ion_state"), F.lit(0.0))
    named = named.join(formula_masses(named), "formula").select("spectrum_uid", "peak_index", mass.alias("rendered"))
    full = observed.join(named, ["spectrum_uid", "peak_index"], "left").join(rank, ["spectrum_uid", "peak_index"], "left")
    return full.select("spectrum_uid", "peak_index", "mz", "rendered", "rank", "weight")


def oracle_lists(rendered: DataFrame) -> DataFrame:
    """(spectrum_uid, peak_index, mz, a weight for each of ORACLES): four peak lists that a perfect model could emit.

    peak_copy repeats the observation, support_mask keeps the peaks that have a candidate, formula_rendered puts
    them at the mass of their first candidate, slot_capacity keeps those of rank below 64 of them. Two rows a
    peak: one at the observed m/z, one at the rendered.
    """
    has, slot = F.col("rendered").isNotNull(), F.col("rank").between(0, scalar.SLOTS - 1)
    w = F.col("weight")
    observed = F.struct(F.col("mz").alias("mz"), w.alias(ORACLES[0]), F.when(has, w).alias(ORACLES[1]),
        F.lit(None).cast("double").alias(ORACLES[2]), F.lit(None).cast("double").alias(ORACLES[3]))
    moved = F.struct(F.col("rendered").alias("mz"), F.lit(None).cast("double").alias(ORACLES[0]),
        F.lit(None).cast("double").alias(ORACLES[1]), w.alias(ORACLES[2]), F.when(slot, w).alias(ORACLES[3]))
    return rendered.select("spectrum_uid", "peak_index", F.explode(F.array_compact(F.array(observed, F.when(has,
        moved)))).alias("r")).select("spectrum_uid", "peak_index", "r.*")


def in_four_spaces(peaks: DataFrame, value: str, side: str) -> DataFrame:
    """peaks once per comparison space, value raised to the space's exponent of that side (observation or prediction)."""
    at = 1 if side == "observation" else 2
    spaces = F.array(*[F.struct(F.lit(s[0]).alias("space"), F.lit(s[at]).alias("power")) for s in scalar.FOUR_SPACES])
    powered = F.pow(F.greatest(F.col(value), F.lit(0.0)), F.col("s.power"))
    return peaks.withColumn("s", F.explode(spaces)).withColumn("space", F.col("s.space")).withColumn(value, powered).drop("s")


def oracle_ceilings(df: DataFrame, ks: Sequence[int] = scalar.TOP_K) -> DataFrame:
    """(spectrum_uid, oracle, cos_at_k_space..) of every spectrum's oracles that hold a peak, in all four spaces."""
    scored = grid_cosines(long.peaks(df), oracle_lists(rendered_peaks(df)), "spectrum_uid", ORACLES, ks, scalar.FOUR_SPACES)
    return scored.withColumnRenamed("list", "oracle").drop("bins")


def support_oracle(df: DataFrame) -> DataFrame:
    """(spectrum_uid, support_cosine): root of the energy share of peaks with a candidate, 0 without energy."""
    linked = long.edges(df).select("spectrum_uid", "peak_index").distinct().withColumn("linked", F.lit(True))
    energy = F.col("y") * F.col("y")
    per = long.peaks(df).join(linked, ["spectrum_uid", "peak_index"], "left").groupBy("spectrum_uid")
    return per.agg(F.sqrt(F.coalesce(scalar.safe_ratio(F.sum(F.when(F.col("linked"), energy).otherwise(0.0)), F.sum(energy)),
        F.lit(0.0))).alias("support_cosine"))
