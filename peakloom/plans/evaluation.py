"""Queries of binning, cosines, oracles, audits and diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import scalar
from peakloom.operators import analysis, metrics, verify
from peakloom.operators import spectra as long
from peakloom.plans import views
from peakloom.plans.catalog import query
from peakloom.plans.views import sql
from peakloom.session import table

_BIN = "CAST(floor({}*(14999/1500.0::DOUBLE)) + 1 AS INTEGER)"


def predicted(df: DataFrame) -> DataFrame:
    """Every slot's candidate m/z with its contribution: the peak list of a prediction."""
    mz = long.candidates(df).select(F.col("spectrum_uid").alias("uid"), F.col("candidate_index").alias("slot"), F.col("theo_mz").alias("mz"))
    return views.slots(df).join(mz, ["uid", "slot"]).where("mz IS NOT NULL").select(F.col("uid").alias("spectrum_uid"), "mz",
        F.col("contribution").alias("weight"))


_SCORES = f"""
    WITH pr AS (SELECT sl.uid, ca.theo_mz AS mz, presence * intensity AS w FROM sl JOIN ca ON ca.spectrum_uid = sl.uid
    AND ca.candidate_index = sl.slot WHERE theo_mz IS NOT NULL),
         pb AS (SELECT uid, bin, sum(w) AS v FROM (SELECT uid, w, {_BIN.format("mz")} AS bin FROM pr) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL),
         pn AS (SELECT uid, bin, v / top AS v FROM (SELECT *, max(v) OVER (PARTITION BY uid) AS top FROM pb) WHERE top > 0 AND v / top >= 1e-5),
         pp AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY round(v, 12) DESC, bin) AS place FROM pn),
         ob AS (SELECT spectrum_uid AS uid, bin, max(greatest(y, 0)) AS raw, max(sqrt(greatest(y, 0))) AS root FROM (SELECT *,
         {_BIN.format("mz")} AS bin FROM pk) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL),
         nr AS (SELECT uid, sqrt(sum(raw * raw)) AS raw_n, sqrt(sum(root * root)) AS root_n FROM ob GROUP BY uid),
         cs AS (SELECT pp.uid, {", ".join(f"sum(v * coalesce({o}, 0)) FILTER (place <= {k}) / nullif(sqrt(sum(v * v) FILTER (place <= {k})) * max({o}_n), 0) AS c_{k}_{n}" for o, n in (("root", "canonical_sqrt"), ("raw", "legacy_raw")) for k in (20, 100))},
                count(*) AS bins FROM pp LEFT JOIN ob ON ob.uid = pp.uid AND ob.bin = pp.bin LEFT JOIN nr ON nr.uid = pp.uid GROUP BY pp.uid),
         sh AS (SELECT uid, count(*) AS n, count(*) FILTER ({_BIN.format("mz")} BETWEEN 0 AND 14999) AS inside FROM pr GROUP BY uid),
         res AS (SELECT spectrum_uid, {", ".join(f"coalesce(c_{k}_{n}, 0) AS cos_at_{k}_{n}" for n in ("canonical_sqrt", "legacy_raw") for k in (20, 100))}, coalesce(n, 0) AS predicted_peaks, coalesce(bins, 0) AS predicted_bins,
                 greatest(coalesce(inside, 0) - coalesce(bins, 0), 0) AS collisions, coalesce(n, 0) - coalesce(inside, 0) AS out_of_range,
                 coalesce(bins, 0) = 0 AS zero_prediction
                 FROM s LEFT JOIN cs ON cs.uid = spectrum_uid LEFT JOIN sh ON sh.uid = spectrum_uid)"""
_COS = [f"cos_at_{k}_{n}" for n in scalar.SPACES for k in scalar.TOP_K]


def scored(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.PEAKS, *views.CANDIDATES)
    return metrics.score_predictions(predicted(df), long.peaks(df), df)


@query(sql("s ca sl pk", _SCORES + f""" SELECT spectrum_uid, {', '.join(f'round({c}, 6) AS {c}' for c in _COS)}, predicted_peaks,
    predicted_bins, collisions, out_of_range, zero_prediction FROM res"""))
def score_predictions(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("spectrum_uid", *[F.round(c, 6).alias(c) for c in _COS], "predicted_peaks", "predicted_bins",
        "collisions", "out_of_range", "zero_prediction")


@query(sql("s ca sl pk", _SCORES + """ SELECT spectrum_uid, round(cos_at_20_canonical_sqrt, 6) AS cos_at_20,
    round(cos_at_100_canonical_sqrt, 6) AS cos_at_100 FROM res"""))
def cosine_at_k(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: binned cosine of every spectrum's prediction with its observation."""
    return scored(spark, d).select("spectrum_uid", F.round("cos_at_20_canonical_sqrt", 6).alias("cos_at_20"),
        F.round("cos_at_100_canonical_sqrt", 6).alias("cos_at_100"))


@query(sql("s ca sl pk", _SCORES + f""" SELECT count(*) AS spectra,
    {", ".join(f"round(avg({c}), 6) AS {c}_mean, round(quantile_cont({c}, 0.1), 6) AS {c}_p10, round(quantile_cont({c}, 0.5), 6) AS {c}_p50, round(quantile_cont({c}, 0.9), 6) AS {c}_p90" for c in _COS)},
    round(avg(predicted_peaks), 6) AS predicted_peaks_mean, max(predicted_peaks) AS predicted_peaks_max, round(avg(predicted_bins),
    6) AS predicted_bins_mean, count(*) FILTER (zero_prediction) AS zero_predictions,
    sum(out_of_range)::BIGINT AS out_of_range, sum(collisions)::BIGINT AS collisions, round(sum(collisions) / nullif(sum(predicted_peaks),
    0), 6) AS collision_rate FROM res"""))
def cosine_summary(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.summarise_scores(scored(spark, d))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_SPACES = "(VALUES ('canonical_sqrt', 0.5::DOUBLE, 1.0::DOUBLE), ('legacy_raw', 1.0, 1.0), ('raw_via_squared_prediction', 1.0, 2.0), ('double_sqrt', 0.5, 0.5)) AS v(space, o_pow, p_pow)"


@query(sql("s pk ca ed fm ch", f"""
    WITH fi AS (SELECT spectrum_uid, peak_index, arg_min(candidate_index, edge_index) AS candidate_index FROM ed GROUP BY ALL),
         rn AS (SELECT fi.spectrum_uid, fi.peak_index, mass + coalesce(delta, 0) AS rendered FROM fi JOIN ca USING (spectrum_uid,
         candidate_index) JOIN fm USING (formula) LEFT JOIN ch USING (ion_state)),
         fu AS (SELECT pk.*, rendered, sqrt(greatest(y, 0)) AS w FROM pk LEFT JOIN rn USING (spectrum_uid, peak_index)),
         orc AS (SELECT spectrum_uid, 'peak_copy' AS oracle, mz, w FROM fu UNION ALL SELECT spectrum_uid, 'support_mask', mz, w FROM fu
         WHERE rendered IS NOT NULL
                 UNION ALL SELECT spectrum_uid, 'formula_rendered', rendered, w FROM fu WHERE rendered IS NOT NULL UNION ALL
                 SELECT spectrum_uid, 'slot_capacity', rendered, w FROM fu WHERE rendered IS NOT NULL AND rank BETWEEN 0 AND 63),
         pb AS (SELECT spectrum_uid, oracle, space, bin, sum(w) AS v FROM (SELECT spectrum_uid, oracle, space, pow(w, p_pow) AS w,
         {_BIN.format("mz")} AS bin FROM orc, {_SPACES}) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL),
         pn AS (SELECT * REPLACE (v / top AS v) FROM (SELECT *, max(v) OVER (PARTITION BY spectrum_uid, oracle, space) AS top FROM pb)
         WHERE top > 0 AND v / top >= 1e-5),
         pp AS (SELECT *, row_number() OVER (PARTITION BY spectrum_uid, oracle, space ORDER BY v DESC, bin) AS place FROM pn),
         ob AS (SELECT spectrum_uid, space, bin, max(o) AS o FROM (SELECT spectrum_uid, space, pow(greatest(y, 0), o_pow) AS o,
         {_BIN.format("mz")} AS bin FROM pk, {_SPACES}) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL HAVING max(o) > 0),
         nr AS (SELECT spectrum_uid, space, sqrt(sum(o * o)) AS n FROM ob GROUP BY ALL),
         cs AS (SELECT pp.spectrum_uid, oracle, pp.space, coalesce(sum(v * coalesce(o,
         0)) FILTER (place <= 100) / nullif(sqrt(sum(v * v) FILTER (place <= 100)) * max(n), 0), 0) AS c100
                FROM pp LEFT JOIN ob ON ob.spectrum_uid = pp.spectrum_uid AND ob.space = pp.space AND ob.bin = pp.bin LEFT
                JOIN nr ON nr.spectrum_uid = pp.spectrum_uid AND nr.space = pp.space GROUP BY ALL)
    SELECT oracle, space, count(*) AS spectra, round(avg(c100), 5) AS mean_cos_at_100 FROM cs GROUP BY oracle, space"""))
def oracle_ceilings(spark: SparkSession, d: str) -> DataFrame:
    scored = metrics.oracle_ceilings(views.shared(spark, d, *views.SCORES), (100,))
    means = [F.struct(F.lit(n).alias("space"), F.count("*").alias("spectra"), F.round(F.avg(f"cos_at_100_{n}"),
        5).alias("mean_cos_at_100")) for n, _, _ in scalar.FOUR_SPACES]
    return scored.groupBy("oracle").agg(F.array(*means).alias("m")).select("oracle", F.explode("m").alias("m")).select("oracle", "m.*")


_SUPPORT = """WITH n AS (SELECT spectrum_uid, peak_index, count(*) AS n FROM ed GROUP BY ALL), sp AS (SELECT pk.*, coalesce(n, 0) AS n
    FROM pk LEFT JOIN n USING (spectrum_uid, peak_index))"""


@query(sql("s pk ed", _SUPPORT + """ SELECT spectrum_uid, round(coalesce(sqrt(sum(y * y) FILTER (n > 0) / nullif(sum(y * y), 0)), 0),
    6) AS support_cosine FROM sp GROUP BY 1"""))
def support_oracle_cosine(spark: SparkSession, d: str) -> DataFrame:
    return metrics.support_oracle(views.supervision(spark, d, *views.PEAKS, *views.EDGES)).select("spectrum_uid", F.round("support_cosine",
        6).alias("support_cosine"))


@query(sql("s pk ed", _SUPPORT + """ SELECT dp, count(*) AS peaks, count(*) FILTER (n > 0) AS supported_peaks, round(avg((n > 0)::DOUBLE),
    6) AS supported_fraction, round(sum(CASE WHEN n > 0 THEN y ELSE 0 END) / nullif(sum(y), 0), 6) AS intensity_coverage,
    round(avg((n = 0)::DOUBLE), 6) AS zero_fraction, round(avg((n = 1)::DOUBLE), 6) AS one_fraction, round(avg((n >= 2)::DOUBLE),
    6) AS many_fraction, round(avg(n), 6) AS candidates_mean, quantile_cont(n, 0.5)::DOUBLE AS candidates_p50,
    round(quantile_cont(n, 0.9), 6) AS candidates_p90, round(quantile_cont(n, 0.99), 6) AS candidates_p99, max(n) AS candidates_max FROM sp
    GROUP BY dp"""))
def peak_block(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.peak_block(analysis.peak_support(views.supervision(spark, d, *views.PEAKS, *views.EDGES)).withColumn("dp", F.col("dp").cast("int")), ("dp",))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql("s pk ed", _SUPPORT + """, u AS (SELECT spectrum_uid, coalesce(sqrt(sum(y * y) FILTER (n > 0) / nullif(sum(y * y), 0)), 0) AS c,
    bool_and(n > 0) AS f FROM sp GROUP BY 1),
    r AS (SELECT instrument, adduct, coalesce(len(candidate_neutral_formula), 0) AS k, coalesce(c, 0) AS c, coalesce(f, true) AS f FROM s
    LEFT JOIN u USING (spectrum_uid)),
    g AS (SELECT 'all' AS dimension, 'all' AS label, k, c, f FROM r UNION ALL SELECT 'instrument', coalesce(instrument, '?'), k, c, f FROM r
    UNION ALL SELECT 'adduct', coalesce(adduct, '?'), k, c, f FROM r)
    SELECT dimension, label, count(*) AS spectra, round(avg(c), 6) AS cosine_mean, round(quantile_cont(c, 0.1), 6) AS cosine_p10,
    round(quantile_cont(c, 0.5), 6) AS cosine_p50, round(avg(f::DOUBLE), 6) AS fully_supported_fraction,
      round(quantile_cont(k, 0.5), 6) AS unique_p50, round(quantile_cont(k, 0.9), 6) AS unique_p90, round(quantile_cont(k, 0.99),
      6) AS unique_p99, max(k)::INT AS unique_max,
      """ + ", ".join(f"round(avg((k <= {t})::DOUBLE), 6) AS unique_le_{t}" for t in analysis.THRESHOLDS) + " FROM g GROUP BY ALL"))
def audit_strata(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.strata_by_spectrum(views.shared(spark, d, "instrument", "adduct", "fold", "candidate_neutral_formula", *views.PEAKS, *views.EDGES))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_SLOT_DIAGNOSTICS = _SUPPORT + """, p AS (SELECT spectrum_uid, count(*) AS peaks, count(*) FILTER (supervised) AS supervised,
    count(*) FILTER (n = 1) AS unique_peaks, count(*) FILTER (n >= 2) AS ambiguous_peaks, count(*) FILTER (n = 0) AS unsupported_peaks,
      count(*) FILTER (dp < 2) AS low_precision, sum(y) AS l1, coalesce(sum(y) FILTER (rank BETWEEN 0 AND 63), 0) AS kept_l1,
      sum(y * y) AS energy, coalesce(sum(y * y) FILTER (rank BETWEEN 0 AND 63), 0) AS kept_energy FROM sp GROUP BY 1),
    e AS (SELECT spectrum_uid, sum(n) AS edges, count(*) FILTER (n > 1) AS reused FROM (SELECT spectrum_uid, candidate_index, count(*) AS n
    FROM ed GROUP BY ALL) GROUP BY 1),
    dg AS (SELECT spectrum_uid, coalesce(len(candidate_neutral_formula), 0) AS candidates, coalesce(peaks, 0) AS peaks, coalesce(supervised,
    0) AS supervised, coalesce(unique_peaks, 0) AS unique_peaks, coalesce(ambiguous_peaks, 0) AS ambiguous_peaks,
      coalesce(unsupported_peaks, 0) AS unsupported_peaks, coalesce(low_precision, 0) AS low_precision, coalesce(l1, 0) AS l1,
      coalesce(kept_l1, 0) AS kept_l1, coalesce(energy, 0) AS energy, coalesce(kept_energy, 0) AS kept_energy,
      coalesce(edges, 0)::BIGINT AS edges, coalesce(reused, 0) AS reused FROM s LEFT JOIN p USING (spectrum_uid) LEFT JOIN e USING (spectrum_uid))"""
_DOUBLES = ("l1", "kept_l1", "energy", "kept_energy")


@query(sql("s pk ed", _SLOT_DIAGNOSTICS + " SELECT * REPLACE (" + ", ".join(f"round(ln(1 + {c}), 7) AS {c}" for c in _DOUBLES) + ") FROM dg"))
def slot_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.slot_diagnostics(views.shared(spark, d, "candidate_neutral_formula", "supervision_mask", *views.RANK, *views.PEAKS, *views.EDGES))
    return out.select(*[F.round(F.log1p(c), 7).alias(c) if c in _DOUBLES else F.col(c) for c in out.columns])


@query(sql("s pk ed", _SLOT_DIAGNOSTICS + """, x AS (SELECT *, coalesce(kept_l1 / nullif(l1, 0), 0) AS r,
    coalesce(sqrt(kept_energy / nullif(energy, 0)), 0) AS o FROM dg)
    SELECT count(*) AS spectra, sum(peaks)::BIGINT AS peaks, round(avg(supervised), 6) AS supervised_mean,
    max(supervised) AS supervised_max, round(avg((supervised > 64)::DOUBLE), 6) AS over_slots_fraction, round(avg(r), 6) AS l1_mean,
    round(quantile_cont(r, 0.1), 6) AS l1_p10,
      round(sum(kept_l1) / nullif(sum(l1), 0), 6) AS l1_pooled, round(avg(o), 6) AS oracle_mean, round(quantile_cont(o, 0.1),
      6) AS oracle_p10, round(quantile_cont(o, 0.5), 6) AS oracle_p50, round(sqrt(sum(kept_energy) / nullif(sum(energy), 0)), 6) AS oracle_pooled,
      sum(candidates)::BIGINT AS candidates, sum(edges)::BIGINT AS edges, sum(reused)::BIGINT AS reused,
      round(sum(reused) / nullif(sum(candidates), 0), 6) AS reused_fraction, sum(unique_peaks)::BIGINT AS unique_peaks,
      sum(ambiguous_peaks)::BIGINT AS ambiguous_peaks,
      sum(unsupported_peaks)::BIGINT AS unsupported_peaks, sum(low_precision)::BIGINT AS low_precision,
      count(*) FILTER (energy = 0) AS zero_energy FROM x"""))
def slot_summary(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.summarise_slots(analysis.slot_diagnostics(views.shared(spark, d, "candidate_neutral_formula", "supervision_mask",
        *views.RANK, *views.PEAKS, *views.EDGES)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql("s", """
    SELECT count(*) AS rows, count(*) FILTER (z) AS zero_target_rows, round(avg(z::DOUBLE), 6) AS zero_target_fraction,
    round(coalesce(sum(CASE WHEN z THEN y ELSE 0 END) / nullif(sum(y), 0), 0), 6) AS zero_target_intensity,
      coalesce(sum(n) FILTER (z), 0)::BIGINT AS zero_target_peaks, count(*) FILTER (NOT z) AS rows_left
    FROM (SELECT len(list_filter(supervision_rank, lambda r: r BETWEEN 0 AND 63)) = 0 AS z, len(mzs) AS n,
    coalesce(list_sum(list_filter(intensities::DOUBLE[], lambda y: y IS NOT NULL AND NOT isnan(y))), 0) AS y FROM s)"""))
def zero_targets(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.zero_targets(views.supervision(spark, d, "mzs", "intensities", *views.RANK))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql("s pk tr", "SELECT spectrum_uid, CAST(peak_index AS INTEGER) AS peak_index, round(t, 6) AS t FROM tr"))
def intensity_transform(spark: SparkSession, d: str) -> DataFrame:
    return metrics.transformed(long.peaks(views.supervision(spark, d, *views.PEAKS))).select("spectrum_uid", "peak_index", F.round("t", 6).alias("t"))


@query(sql("s pk", f"SELECT space, count(*) AS n, round(sum(pow(greatest(y, 0), o_pow)), 2) AS total FROM pk, {_SPACES} GROUP BY space"))
def intensity_spaces(spark: SparkSession, d: str) -> DataFrame:
    spread = metrics.in_four_spaces(long.peaks(views.supervision(spark, d, *views.PEAKS)), "y", "observation")
    return spread.groupBy("space").agg(F.count("*").alias("n"), F.round(F.sum("y"), 2).alias("total"))


@query(sql("s pk", f"""SELECT spectrum_uid, bin, round(sum(y), 4) AS total, max(y) AS greatest FROM (SELECT *, {_BIN.format('mz')} AS bin
    FROM pk) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL HAVING max(y) > 0"""))
def peak_bins(spark: SparkSession, d: str) -> DataFrame:
    """Sum-pooled and max-pooled bins of every spectrum."""
    p = long.peaks(views.supervision(spark, d, *views.PEAKS))
    sums = metrics.sum_bins(p, ["spectrum_uid"]).withColumnRenamed("v", "total")
    return metrics.bin_observation(p, ["spectrum_uid"]).withColumnRenamed("v", "greatest").join(sums, ["spectrum_uid",
        "bin"]).select("spectrum_uid", "bin", F.round("total", 4).alias("total"), "greatest")


_BAD = {
    "parallel_lengths": "len(intensities) <> len(mzs) OR len(mz_decimal_places) <> len(mzs) OR len(supervision_mask) <> len(mzs) OR len(supervision_rank) <> len(mzs)",
    "candidate_lengths": "len(candidate_ion_state) <> len(candidate_neutral_formula) OR len(candidate_theoretical_mz) <> len(candidate_neutral_formula)",
    "edge_lengths": "len(edge_candidate_index) <> len(edge_peak_index) OR len(edge_error_ppm) <> len(edge_peak_index)",
    "edge_ranges": """coalesce(list_min(edge_peak_index) < 0 OR list_max(edge_peak_index) >= len(mzs) OR list_min(edge_candidate_index) < 0
        OR list_max(edge_candidate_index) >= len(candidate_neutral_formula), len(edge_peak_index) <> 0)""",
    "candidates_distinct": """CASE WHEN candidate_neutral_formula IS NOT NULL AND candidate_ion_state IS NOT NULL THEN
        len(list_distinct(list_zip(candidate_neutral_formula, candidate_ion_state))) <> greatest(len(candidate_neutral_formula), len(candidate_ion_state)) END""",
    "mask_reproducible": """supervision_mask IS DISTINCT FROM list_transform(mz_decimal_places, lambda dp, i: coalesce(list_contains(edge_peak_index, i - 1), false) AND dp >= 2)""",
    "rank_reproducible": "supervision_rank IS DISTINCT FROM coalesce(own, [])",
    "low_precision_supervised": """CASE WHEN list_contains(low, true) THEN true WHEN len(list_filter(low, lambda x: x IS NULL)) > 0 THEN NULL WHEN low IS NOT NULL THEN false END""",
    "edges_within_tolerance": """len(list_filter(list_zip(edge_peak_index, edge_candidate_index), lambda e: coalesce(abs(mzs[e[1] + 1] - candidate_theoretical_mz[e[2] + 1]) >
        CASE WHEN mz_decimal_places[e[1] + 1] >= 2 THEN greatest(mzs[e[1] + 1] * 1e-5, 0.5 * pow(10, -mz_decimal_places[e[1] + 1])) ELSE mzs[e[1] + 1] * 1e-5 END + 1e-6, true))) > 0""",
    "no_test_fold": "lower(fold) = 'test'",
}
_CHECKS = """WITH rk AS (SELECT spectrum_uid, list(r ORDER BY i) AS own FROM (SELECT spectrum_uid, i, CASE WHEN m THEN CAST(row_number() OVER
           (PARTITION BY spectrum_uid, m ORDER BY CASE WHEN NOT isnan(y) THEN y END DESC NULLS LAST, mz NULLS FIRST, i) - 1 AS INTEGER) ELSE -1 END AS r
           FROM (SELECT spectrum_uid, i, coalesce(supervision_mask[i + 1], false) AS m, mzs[i + 1] AS mz, intensities[i + 1] AS y
                 FROM (SELECT *, unnest(range(greatest(len(mzs), len(intensities), len(supervision_mask)))) AS i FROM s))) GROUP BY 1),
         c AS (SELECT s.*, own, list_transform(list_zip(mz_decimal_places, supervision_mask), lambda z: z[1] < 2 AND z[2]) AS low FROM s LEFT JOIN rk USING (spectrum_uid)) """


@query(sql("s", _CHECKS + " UNION ALL ".join(f"SELECT '{name}' AS check_name, count(*) FILTER (coalesce({bad}, true)) AS violations FROM c" for name, bad in _BAD.items())
           + " UNION ALL SELECT 'uid_unique', count(*) - count(DISTINCT spectrum_uid) FROM s"))
def verify_supervision(spark: SparkSession, d: str) -> DataFrame:
    """All checks of the supervision table without its repeated rows; verify_all has them of both tables as they are."""
    return verify.supervision_checks(views.shared(spark, d)).select("check_name", "violations")


@query("""
    WITH r AS (SELECT parent_spec, coalesce(fold, 'none') AS fold, coalesce(collision_index, 0) AS i, (concat('0x',
    substr(sha256(parent_spec), 1, 16))::UBIGINT % 64)::INT AS own FROM spectra_v2),
         f AS (SELECT *, CASE WHEN i % 5 = 0 THEN (own + 1) % 64 ELSE own END AS shard, CASE WHEN i % 7 = 0 THEN 'train'
         ELSE fold END AS folder, CASE WHEN i % 3 = 0 THEN own ELSE shard END AS place FROM r)
    SELECT 'fold_is_folder' AS check_name, count(*) FILTER (coalesce(fold <> folder, true)) AS violations FROM f UNION ALL
    SELECT 'shard_is_folder', count(*) FILTER (coalesce(shard <> place, true)) FROM f
    UNION ALL SELECT 'shard_of_parent', count(*) FILTER (coalesce(shard <> own, true)) FROM f UNION ALL SELECT 'shard_in_range',
    count(*) FILTER (coalesce(shard NOT BETWEEN 0 AND 63, true)) FROM f""")
def layout_faults(spark: SparkSession, d: str) -> DataFrame:
    """The layout checks on rows with planted faults: every fifth collision in the next shard, every seventh in the folder of train."""
    i, own = F.coalesce("collision_index", F.lit(0)), scalar.shard_of("parent_spec")
    rows = table(spark, d, "spectra_v2").select("parent_spec", "collision_index", F.coalesce("fold", F.lit("none")).alias("fold"),
        F.when(i % 5 == 0, (own + 1) % 64).otherwise(own).alias("shard"))
    at = F.when(i % 3 == 0, own).otherwise(F.col("shard"))
    file = F.concat(F.lit("/fold="), F.when(i % 7 == 0, "train").otherwise(F.col("fold")), F.lit("/shard="), at.cast("string"), F.lit("/part"))
    return verify.layout_checks(rows, 64, file=file).where("check_name <> 'rows_in_order'").select("check_name", "violations")


@query()
def verify_all(spark: SparkSession, d: str) -> DataFrame:
    supervision = verify.supervision_checks(table(spark, d, "fragment_supervision_v2")).withColumn("table_name", F.lit("fragment_supervision_v2"))
    return supervision.unionByName(verify.spectra_checks(table(spark, d, "spectra_v2")).withColumn("table_name", F.lit("spectra_v2")))


@query("""
    WITH a AS (SELECT inchikey AS k, min(fold) AS lo, max(fold) AS hi FROM spectra_v2 WHERE inchikey IS NOT NULL GROUP BY 1),
    b AS (SELECT parent_spec AS k, min(fold) AS lo, max(fold) AS hi FROM spectra_v2 WHERE parent_spec IS NOT NULL GROUP BY 1)
    SELECT 'inchikey_in_one_fold' AS check_name, count(*) AS violations, min(k) AS example FROM a WHERE lo < hi UNION ALL
    SELECT 'parent_in_one_fold', count(*), min(k) FROM b WHERE lo < hi
    UNION ALL SELECT 'uid_unique', coalesce(sum(n - 1), 0)::BIGINT, min(spectrum_uid) FROM (SELECT spectrum_uid, count(*) AS n
    FROM spectra_v2 GROUP BY 1 HAVING count(*) > 1)""")
def cross_group_keys(spark: SparkSession, d: str) -> DataFrame:
    checks = verify.spectra_checks(table(spark, d, "spectra_v2"))
    return checks.where(F.col("check_name").isin("inchikey_in_one_fold", "parent_in_one_fold", "uid_unique"))
