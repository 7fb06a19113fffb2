"""Queries over score tables: bags, costs, losses, assignment, identities, counterfactuals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import chem, scalar
from peakloom.functions.elements import ELEMENTS
from peakloom.operators import analysis, assign, metrics, scores
from peakloom.operators import spectra as long
from peakloom.plans import views
from peakloom.plans.catalog import query
from peakloom.plans.views import sql
from peakloom.session import cut, table

_SC = "s ca sl ed le me sc"
_ASG = "s pk tr tg ca sl ed le me sc asg"
_MB = """mb AS (SELECT asg.uid, asg.slot, asg.target, count(*) AS cardinality, -(ln(sum(exp(log_prob)) + 1e-30)) AS bag_nll,
    max(log_prob) AS best_in_bag, bool_or(sc.candidate_index = asg.slot) AS argmax_in_bag
                FROM asg JOIN me USING (uid, target) JOIN sc ON sc.uid = asg.uid AND sc.slot = asg.slot
                AND sc.candidate_index = me.candidate_index GROUP BY ALL)"""
# The SQL sums exponentials directly: scores lie well inside the range of doubles.


def matched(df: DataFrame) -> DataFrame:
    own = views.slots(df).select("uid", "slot", F.col("slot").alias("candidate_index"))
    return scores.matched_bags(views.scores(df), views.members(df), views.assignment(df), own)


@query("""SELECT user_id, round(max(value) + ln(sum(exp(value - m)) + 1e-30), 6) AS lse FROM (SELECT user_id, value,
    max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""")
def log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    return scores.log_sum_exp(table(spark, d, "events"), ["user_id"], "value").select("user_id", F.round("lse", 6).alias("lse"))


@query("""SELECT user_id, round(max(value) + ln(sum(exp(value - m)) + 1e-30), 6) AS lse FROM (SELECT user_id, value,
    max(value) OVER (PARTITION BY user_id) AS m FROM events) GROUP BY user_id""")
def chunked_log_sum_exp(spark: SparkSession, d: str) -> DataFrame:
    """Chunks by event type, merged exactly."""
    e = table(spark, d, "events")
    chunk = e.groupBy("user_id", "event_type").agg(F.max("value").alias("m"))
    parts = e.join(chunk, ["user_id", "event_type"]).groupBy("user_id", "event_type").agg(F.max("m").alias("m"),
        F.sum(F.exp(F.col("value") - F.col("m"))).alias("s"))
    return scores.merge_log_sum_exp(parts, ["user_id"]).select("user_id", F.round("lse", 6).alias("lse"))


@query(sql(_SC, """SELECT uid, CAST(slot AS INTEGER) AS slot, target, round(ln(sum(exp(log_prob)) + 1e-30), 6) AS bag_log_prob FROM sc
    JOIN me USING (uid, candidate_index) GROUP BY ALL"""))
def bag_log_probability(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.CANDIDATES, *views.EDGES, *views.RANK)
    return scores.bag_log_probability(views.scores(df), views.members(df)).select("uid", "slot", "target", F.round("bag_log_prob", 6).alias("bag_log_prob"))


@query(sql(_ASG, """
    WITH b AS (SELECT uid, slot, target, ln(sum(exp(log_prob)) + 1e-30) AS lp FROM sc JOIN me USING (uid, candidate_index) GROUP BY ALL)
    SELECT uid, CAST(slot AS INTEGER) AS slot, target, round(-lp + 0.25 * CASE WHEN abs(x) <= 1 THEN x * x / 2 ELSE abs(x) - 0.5 END, 8) AS cost
    FROM (SELECT b.*, sl.presence * sl.intensity - tg.t AS x FROM b JOIN sl USING (uid, slot) JOIN tg USING (uid, target))"""))
def matching_costs(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.SCORES)
    costs = scores.matching_costs(views.scores(df), views.members(df), views.slots(df), views.targets(df))
    return costs.withColumn("cost", F.round("cost", 8))


@query()
def hungarian(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.SCORES)
    return assign.assign(scores.matching_costs(views.scores(df), views.members(df), views.slots(df), views.targets(df)))


@query(sql(_ASG, """
    WITH b AS (SELECT DISTINCT sc.uid, sc.slot, me.target FROM sc JOIN me ON me.uid = sc.uid AND me.candidate_index = sc.candidate_index JOIN tg ON tg.uid = sc.uid AND tg.target = me.target)
    SELECT 'targets' AS check_name, sum(n)::BIGINT AS n FROM (SELECT least(count(DISTINCT target), count(DISTINCT slot)) AS n FROM b GROUP BY uid) UNION ALL SELECT 'spectra', count(DISTINCT uid) FROM b UNION ALL SELECT unnest(['slots_twice', 'targets_twice', 'dearer_than_greedy']), 0"""))
def hungarian_checks(spark: SparkSession, d: str) -> DataFrame:
    """The assignment's invariants: every target once (as far as there are slots), no slot twice, and nowhere dearer than taking the cheapest free pair again and again
    could be: each target's own cheapest slot, where those slots differ.
    """
    df = views.shared(spark, d, *views.SCORES)
    costs = cut(scores.matching_costs(views.scores(df), views.members(df), views.slots(df), views.targets(df)))
    pairs = cut(assign.assign(costs))
    row = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    best = costs.groupBy("uid", "target").agg(F.min_by("slot", F.struct("cost", "slot")).alias("slot"), F.min("cost").alias("cost"))
    free = best.groupBy("uid").agg(F.count("*").alias("n"), F.count_distinct("slot").alias("slots"), F.sum("cost").alias("least")).where("n = slots")
    total = pairs.groupBy("uid").agg(F.sum("cost").alias("total"))
    return (
        row(pairs.select("uid", "target").distinct(), "targets").unionByName(row(pairs.select("uid").distinct(), "spectra"))
        .unionByName(row(pairs.groupBy("uid", "slot").count().where("count > 1"), "slots_twice"))
        .unionByName(row(pairs.groupBy("uid", "target").count().where("count > 1"), "targets_twice"))
        .unionByName(row(free.join(total, "uid").where("abs(total - least) > 1e-6"), "dearer_than_greedy"))
    )


def diagnostics(df: DataFrame) -> DataFrame:
    predicted = views.slots(df).where("presence >= 0.5").select("uid", F.col("slot").alias("prediction"), "formula", "ion_state")
    bags = long.bags(df).withColumnRenamed("spectrum_uid", "uid")
    return assign.fragment_diagnostics(predicted, bags, views.targets(df))


@query()
def max_matching(spark: SparkSession, d: str) -> DataFrame:
    return diagnostics(views.shared(spark, d, *views.SCORES))


@query()
def fragment_summary(spark: SparkSession, d: str) -> DataFrame:
    return assign.summarise_fragments(diagnostics(views.shared(spark, d, *views.SCORES)))


@query(sql("s ca ed le", "SELECT DISTINCT le.spectrum_uid, target, formula, ion_state FROM le JOIN ca USING (spectrum_uid, candidate_index)"))
def target_bags(spark: SparkSession, d: str) -> DataFrame:
    return long.bags(views.shared(spark, d, *views.CANDIDATES, *views.EDGES, *views.RANK))


@query(sql(_ASG, f"""WITH {_MB} SELECT uid, CAST(slot AS INTEGER) AS slot, target, cardinality, round(bag_nll, 6) + 0.0 AS bag_nll,
    round(exp(-bag_nll), 6) AS bag_mass, round(best_in_bag, 6) + 0.0 AS best_in_bag, argmax_in_bag FROM mb"""))
def matched_bags(spark: SparkSession, d: str) -> DataFrame:
    out = matched(views.shared(spark, d, *views.SCORES))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql(_ASG, f"""WITH {_MB}, q AS (SELECT unnest(list_filter(['all', CASE WHEN cardinality = 1 THEN 'unique' END, CASE
    WHEN cardinality >= 2 THEN 'ambiguous' END], lambda x: x IS NOT NULL)) AS grp, * FROM mb)
    SELECT grp, count(*) AS pairs, round(avg(argmax_in_bag::DOUBLE), 6) AS argmax_in_bag, round(avg(exp(-bag_nll)), 6) AS bag_mass,
    round(avg(best_in_bag), 6) AS best_in_bag FROM q GROUP BY grp"""))
def identity_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Greedy identities of all, unique and ambiguous bags."""
    out = scores.identity_metrics(matched(views.shared(spark, d, *views.SCORES)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


_STRATA = ["'all' AS stratum FROM q", "'unique_bag' FROM q WHERE cardinality = 1", "'ambiguous_bag' FROM q WHERE cardinality >= 2",
    """'cardinality_1' FROM q WHERE cardinality = 1""", """'cardinality_2_4' FROM q WHERE cardinality BETWEEN 2 AND 4""",
        """'cardinality_5_8' FROM q WHERE cardinality BETWEEN 5 AND 8""", """'cardinality_9_plus' FROM q WHERE cardinality >= 9"""]
_STRATA += [f"'precursor_mz_{lo}_{hi:g}' FROM q WHERE precursor_mz >= {lo} AND precursor_mz < {hi}" for lo, hi in ((0, 200), (200, 300),
    (300, 400), (400, 600), (600, 1e9))]
_STRATA += [f"'targets_{lo}_{hi:g}' FROM q WHERE targets >= {lo} AND targets < {hi}" for lo, hi in ((0, 8), (8, 32), (32, 64), (64, 10**6))]


@query(sql(_ASG, f"""WITH {_MB}, q AS (SELECT mb.*, precursor_mz, n AS targets, exp(-bag_nll) AS bag_mass FROM mb
    JOIN (SELECT spectrum_uid AS uid, precursor_mz FROM s) USING (uid) JOIN (SELECT uid, count(*) AS n FROM tg GROUP BY uid) USING (uid)),
    g AS ({" UNION ALL ".join(f"SELECT bag_nll, bag_mass, {x}" for x in _STRATA)})
    SELECT stratum, count(*) AS pairs, round(avg(bag_nll), 6) AS nll_mean, round(exp(-avg(bag_nll)), 6) AS geometric_mass,
    round(avg(bag_mass), 6) AS arithmetic_mass, round(median(bag_mass), 6) AS median_mass FROM g GROUP BY stratum"""))
def bag_strata(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, "precursor_mz", *views.SCORES)
    counted = views.targets(df).groupBy("uid").agg(F.count("*").alias("targets"))
    pairs = matched(df).join(df.select(F.col("spectrum_uid").alias("uid"), "precursor_mz"), "uid").join(counted, "uid")
    out = analysis.bag_strata(pairs)
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql(_ASG, f"""WITH {_MB}, q AS (SELECT best_in_bag, log_prob AS free FROM mb JOIN sc ON sc.uid = mb.uid AND sc.slot = mb.slot
    AND sc.candidate_index = mb.slot) SELECT count(*) AS pairs, round(avg(best_in_bag - free), 6) AS mean_margin,
    round(avg((free > best_in_bag)::DOUBLE), 6) AS free_beats_bag FROM q"""))
def margins(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.SCORES)
    free = views.scores(df).select("uid", "slot", F.get(F.col("log_probs"), F.col("slot")).alias("free_log_prob"))
    out = analysis.margins(matched(df).join(free, ["uid", "slot"]))
    return out.select("pairs", F.round("mean_margin", 6).alias("mean_margin"), F.round("free_beats_bag", 6).alias("free_beats_bag"))


@query(sql("s pk tr tg ca sl asg", """
    WITH l AS (SELECT presence * 6.0 - 3.0 AS x, asg.slot IS NOT NULL AS p FROM sl LEFT JOIN asg USING (uid, slot)), e AS (SELECT p,
    greatest(x, 0) + ln(1 + exp(-abs(x))) - CASE WHEN p THEN x ELSE 0 END AS v FROM l)
    SELECT round(avg(v) FILTER (p), 6) AS pos, round(avg(v) FILTER (NOT p), 6) AS neg,
    round((avg(v) FILTER (p) + avg(v) FILTER (NOT p)) / 2, 6) AS presence_loss, count(*) AS slots FROM e"""))
def balanced_bce(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.PEAKS, *views.CANDIDATES, *views.RANK)
    on = views.assignment(df).select("uid", "slot", F.lit(True).alias("on"))
    out = scores.balanced_bce(views.slots(df).join(on, ["uid", "slot"], "left"), "presence_logit", F.coalesce(F.col("on"), F.lit(False)))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


@query(sql("s pk tr tg ca sl asg", """
    WITH r AS (SELECT asg.uid, tg.peak_index, presence * intensity AS c, intensity AS i FROM asg JOIN tg USING (uid, target)
    JOIN sl ON sl.uid = asg.uid AND sl.slot = asg.slot),
         j AS (SELECT spectrum_uid AS uid, t, rank BETWEEN 0 AND 63 AS sel, coalesce(c, 0) AS c, coalesce(i, 0) AS i FROM tr LEFT
         JOIN r ON r.uid = tr.spectrum_uid AND r.peak_index = tr.peak_index)
    SELECT uid, round(1 - sum(c * t) / (sqrt(sum(c * c)) * sqrt(sum(t * t)) + 1e-8), 6) AS loss,
    round(coalesce(sqrt(sum(t * t) FILTER (sel)), 0), 6) AS oracle,
      round(coalesce(sum(i * t) / nullif(sqrt(sum(i * i)) * sqrt(sum(t * t)), 0), 0), 6) AS forced,
      round(coalesce(sum(c * t) / nullif(sqrt(sum(c * c)) * sqrt(sum(t * t)), 0), 0), 6) AS gated FROM j GROUP BY uid"""))
def spectrum_cosine_loss(spark: SparkSession, d: str) -> DataFrame:
    """The loss of every spectrum and what limits its cosine."""
    out = scores.matched_cosines(views.matched_peaks(views.supervision(spark, d, *views.PEAKS, *views.CANDIDATES, *views.RANK)))
    return out.select("uid", *[F.round(c, 6).alias(c) for c in ("loss", "oracle", "forced", "gated")])


@query(sql("s ca sl", """SELECT uid, formula, ion_state, round(sum(presence * intensity), 6) AS weight, count(*) AS slots,
    CAST(arg_max(slot, (presence * intensity, -slot)) AS INTEGER) AS slot FROM sl WHERE formula <> '' GROUP BY ALL"""))
def identity_merge(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.merge_identities(views.slots(views.shared(spark, d, *views.CANDIDATES)))
    return out.select("uid", "formula", "ion_state", F.round("weight", 6).alias("weight"), "slots", "slot")


@query(sql("s ca sl fm ch", """
    WITH m AS (SELECT uid, formula, ion_state, sum(presence * intensity) AS weight FROM sl WHERE formula <> '' AND presence >= 0.5 GROUP BY ALL)
    SELECT uid, formula, ion_state, round(weight, 6) AS weight, CAST(row_number() OVER (PARTITION BY uid ORDER BY formula,
    ion_state) - 1 AS INTEGER) AS place FROM m"""))
def render(spark: SparkSession, d: str) -> DataFrame:
    return analysis.render(views.slots(views.shared(spark, d, *views.CANDIDATES))).select("uid", "formula", "ion_state", F.round("weight",
        6).alias("weight"), "place")


def classified(df: DataFrame) -> DataFrame:
    c = long.candidates(df).select(F.col("spectrum_uid").alias("uid"), "candidate_index", "formula", "ion_state")
    return analysis.classify_identities(views.slots(df).select("uid", "slot", "formula", "ion_state"), c)


#: Formulas that parse.
_FORMULA = f"regexp_full_match(formula, '(({'|'.join(ELEMENTS)})(0*[1-9][0-9]*)?)+')"
_COUNTS = """cnt AS (SELECT f AS formula, symbol, sum(CASE WHEN n = '' THEN 1 ELSE n::INT END)::INT AS n FROM (SELECT f,
    unnest(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol, unnest(regexp_extract_all(f, '([A-Z][a-z]?)([0-9]*)', 2)) AS n
               FROM (SELECT formula AS f FROM sl UNION SELECT formula FROM ca WHERE formula <> '')) GROUP BY ALL),
             prs AS (SELECT DISTINCT sl.formula AS p, ca.formula AS c FROM sl JOIN ca ON ca.spectrum_uid = sl.uid WHERE ca.formula <> ''),
             dst AS (SELECT p, c, sum(abs(n))::INT AS l1, coalesce(sum(abs(n)) FILTER (symbol = 'H'), 0)::INT AS h FROM
               (SELECT p, c, symbol, sum(n) AS n FROM (SELECT p, c, symbol, n FROM prs JOIN cnt ON formula = p UNION ALL SELECT p, c,
               symbol, -n FROM prs JOIN cnt ON formula = c) GROUP BY ALL) GROUP BY ALL),
             nea AS (SELECT sl.uid, slot, sl.formula, sl.ion_state, bool_or(coalesce(ca.formula = sl.formula
             AND ca.ion_state = sl.ion_state, false)) AS exact, min((l1, ca.candidate_index, h)) AS near
               FROM sl LEFT JOIN ca ON ca.spectrum_uid = sl.uid AND ca.formula <> '' LEFT JOIN dst ON p = sl.formula AND c = ca.formula GROUP BY ALL),
             cls AS (SELECT *, CASE WHEN exact OR near[1] = 0 THEN 'hit' WHEN near[1] = near[3] AND near[3] <= 2 THEN 'hydrogen_to_2'
             WHEN near[1] = near[3] THEN 'hydrogen_above_2' WHEN near[1] - near[3] = 1 THEN 'one_heavy'
             WHEN near[1] - near[3] = 2 THEN 'two_heavy' ELSE 'far' END AS category FROM nea)"""


@query(sql("s ca sl", f"""WITH {_COUNTS} SELECT category, CASE WHEN precursor_mz < 200 THEN '[0,200)'
    WHEN precursor_mz < 300 THEN '[200,300)' WHEN precursor_mz < 400 THEN '[300,400)' WHEN precursor_mz < 600 THEN '[400,600)'
    WHEN precursor_mz >= 600 THEN '>=600' END AS bucket, count(*) AS n FROM cls JOIN s ON spectrum_uid = uid GROUP BY ALL""").replace("near[1]", "near[1]"))
def identity_errors(spark: SparkSession, d: str) -> DataFrame:
    """Categories of predicted identities by precursor mass."""
    df = views.shared(spark, d, "precursor_mz", *views.CANDIDATES)
    joined = classified(df).join(df.select(F.col("spectrum_uid").alias("uid"), "precursor_mz"), "uid")
    return joined.groupBy("category", scalar.mass_bucket("precursor_mz").alias("bucket")).agg(F.count("*").alias("n"))


@query(sql("s ca sl pk ed", """
    WITH hit AS (SELECT DISTINCT uid, formula, ion_state FROM sl), cov AS (SELECT DISTINCT ed.spectrum_uid, peak_index FROM ed
    JOIN ca USING (spectrum_uid, candidate_index) JOIN hit ON hit.uid = ed.spectrum_uid AND hit.formula = ca.formula AND hit.ion_state = ca.ion_state)
    SELECT round(sum(y) FILTER (cov.peak_index IS NOT NULL) / sum(y), 9) AS share FROM pk LEFT
    JOIN cov ON cov.spectrum_uid = pk.spectrum_uid AND cov.peak_index = pk.peak_index"""))
def covered_union(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, *views.PEAKS, *views.CANDIDATES, *views.EDGES)
    hits = views.slots(df).select(F.col("uid").alias("spectrum_uid"), "formula", "ion_state")
    return analysis.covered_intensity(df, hits).select(F.round("share", 9).alias("share"))


@query(sql("s ca ed", """SELECT formula, count(*) AS n FROM (SELECT DISTINCT spectrum_uid, candidate_index FROM ed)
    JOIN ca USING (spectrum_uid, candidate_index) WHERE formula IS NOT NULL GROUP BY formula"""))
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    return analysis.train_vocabulary(views.shared(spark, d, "formula", *views.CANDIDATES, *views.EDGES))[0]


@query(sql("s ca ed sl", """
    WITH v AS (SELECT formula, count(*) AS n FROM (SELECT DISTINCT spectrum_uid, candidate_index FROM ed) JOIN ca USING (spectrum_uid,
    candidate_index) WHERE formula IS NOT NULL GROUP BY formula)
    SELECT grp, threshold, count(*) AS predictions, round(avg((coalesce(n, 0) >= threshold)::DOUBLE), 6) AS fragment
    FROM (SELECT CASE WHEN EXISTS (SELECT 1 FROM ca WHERE ca.spectrum_uid = sl.uid AND ca.formula = sl.formula
    AND ca.ion_state = sl.ion_state) THEN 'hit' ELSE 'miss' END AS grp, formula FROM sl) LEFT JOIN v USING (formula), (VALUES (1), (5),
    (20), (100)) AS t(threshold) GROUP BY ALL"""))
def vocab_thresholds(spark: SparkSession, d: str) -> DataFrame:
    return seen(spark, d).select("grp", "threshold", "predictions", F.round("fragment", 6).alias("fragment"))


def seen(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, "formula", *views.CANDIDATES, *views.EDGES)
    fragments, losses = analysis.train_vocabulary(df)
    true = long.candidates(df).select(F.col("spectrum_uid").alias("uid"), "formula", "ion_state", F.lit("hit").alias("grp")).distinct()
    p = views.slots(df).join(true, ["uid", "formula", "ion_state"], "left").join(df.select(F.col("spectrum_uid").alias("uid"),
        F.col("formula").alias("precursor")), "uid")
    p = p.withColumn("p_counts", chem.parse_formula("precursor")).withColumn("f_counts", chem.parse_formula("formula"))
    return analysis.seen_rates(p.select(F.coalesce("grp", F.lit("miss")).alias("grp"), "formula", chem.neutral_loss("p_counts",
        "f_counts").alias("loss")), fragments, losses)


_LOSS = """CASE WHEN min(n) < 0 THEN NULL WHEN max(n) = 0 THEN '[M]' ELSE string_agg(symbol || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END,
    '' ORDER BY CASE WHEN c AND symbol = 'C' THEN 0 WHEN c AND symbol = 'H' THEN 1 ELSE 2 END, symbol) FILTER (n > 0) END"""


@query(sql("s ca ed sl", f"""
    WITH fml AS (SELECT DISTINCT formula FROM (SELECT formula FROM s UNION SELECT formula FROM sl UNION SELECT formula FROM ca) WHERE {_FORMULA}),
    cnt AS (SELECT formula, symbol, sum(CASE WHEN n = '' THEN 1 ELSE n::INT END)::INT AS n FROM (SELECT formula,
    unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)',
    2)) AS n FROM fml) GROUP BY ALL),
    pr AS (SELECT s.formula AS p, sl.formula AS f FROM sl JOIN s ON spectrum_uid = uid UNION SELECT s.formula, ca.formula FROM ca
    JOIN s USING (spectrum_uid)),
    ok AS (SELECT p, f FROM pr WHERE p IN (SELECT formula FROM fml) AND f IN (SELECT formula FROM fml)),
    df AS (SELECT p, f, symbol, sum(n)::INT AS n FROM (SELECT p, f, symbol, n FROM ok JOIN cnt ON formula = p UNION ALL SELECT p, f, symbol,
    -n FROM ok JOIN cnt ON formula = f) GROUP BY ALL),
    lo AS (SELECT p, f, {_LOSS} AS loss FROM (SELECT *, bool_or(symbol = 'C' AND n > 0) OVER (PARTITION BY p, f) AS c FROM df) GROUP BY p, f),
    us AS (SELECT s.formula AS p, ca.formula AS f FROM (SELECT DISTINCT spectrum_uid, candidate_index FROM ed) JOIN ca USING (spectrum_uid,
    candidate_index) JOIN s USING (spectrum_uid) WHERE ca.formula IS NOT NULL),
    vf AS (SELECT f AS formula, count(*) AS fn FROM us GROUP BY f), vl AS (SELECT loss, count(*) AS ln FROM us JOIN lo USING (p, f)
    WHERE loss IS NOT NULL GROUP BY loss),
    q AS (SELECT CASE WHEN EXISTS (SELECT 1 FROM ca WHERE ca.spectrum_uid = sl.uid AND ca.formula = sl.formula
    AND ca.ion_state = sl.ion_state) THEN 'hit' ELSE 'miss' END AS grp, sl.formula, s.formula AS p FROM sl JOIN s ON spectrum_uid = uid),
    z AS (SELECT grp, coalesce(fn, 0) AS fn, coalesce(ln, 0) AS ln FROM q LEFT JOIN vf USING (formula) LEFT JOIN lo ON lo.p = q.p
    AND lo.f = q.formula LEFT JOIN vl USING (loss))
    SELECT grp, threshold, count(*) AS predictions, round(avg((fn >= threshold)::INT), 9) AS fragment, round(avg((ln >= threshold)::INT),
    9) AS loss, round(avg((fn >= threshold OR ln >= threshold)::INT), 9) AS either FROM z, (VALUES (1), (5), (20), (100)) AS t(threshold) GROUP BY ALL"""))
def seen_rates(spark: SparkSession, d: str) -> DataFrame:
    """Fragments, losses and either, by threshold."""
    return seen(spark, d).select("grp", "threshold", "predictions", *[F.round(c, 9).alias(c) for c in ("fragment", "loss", "either")])


@query(sql("s ca sl", f"""WITH {_COUNTS}, g AS (SELECT uid, formula, CASE WHEN category = 'hit' THEN 'hit' ELSE 'miss' END AS grp FROM cls
    UNION ALL SELECT spectrum_uid, formula, 'candidate' FROM ca WHERE formula <> ''),
    pa AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol, unnest(regexp_extract_all(formula,
    '([A-Z][a-z]?)([0-9]*)', 2)) AS n FROM (SELECT DISTINCT formula FROM s WHERE {_FORMULA})),
    allc AS (SELECT formula, symbol, n FROM cnt UNION SELECT formula, symbol, sum(CASE WHEN n = '' THEN 1 ELSE n::INT END)::INT FROM pa GROUP BY ALL),
    v AS (SELECT formula, coalesce(sum(n) FILTER (symbol IN ('C', 'Si')), 0) AS four, coalesce(sum(n) FILTER (symbol IN ('N', 'P')),
    0) AS three, coalesce(sum(n) FILTER (symbol IN ('H', 'F', 'Cl', 'Br', 'I', 'Na', 'K')), 0) AS one FROM allc GROUP BY formula),
    w AS (SELECT formula, four - one / 2.0 + three / 2.0 + 1 AS r, one - (2 * four + 2 + three) AS x FROM v),
    q AS (SELECT grp, w.r < 0 AS a, w.x > 0 AS b, w.r > p.r + 1 AS c FROM g JOIN w USING (formula) JOIN s ON s.spectrum_uid = g.uid
    JOIN w p ON p.formula = s.formula)
    SELECT grp, count(*) AS n, round(avg(a::INT), 9) AS negative_rdbe, round(avg(b::INT), 9) AS hydrogen_excess, round(avg(c::INT),
    9) AS above_precursor, round(avg((a OR b)::INT), 9) AS hard, round(avg((a OR b OR c)::INT), 9) AS "any" FROM q GROUP BY grp"""))
def valence_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often predictions and candidates break a valence rule."""
    df = views.shared(spark, d, "formula", *views.CANDIDATES)
    precursor = df.select(F.col("spectrum_uid").alias("uid"), chem.parse_formula("formula").alias("precursor"))
    named = classified(df).select("uid", "formula", F.when(F.col("category") == "hit", "hit").otherwise("miss").alias("grp"))
    named = named.unionByName(long.candidates(df).select(F.col("spectrum_uid").alias("uid"), "formula", F.lit("candidate").alias("grp")))
    flags = named.join(precursor, "uid").withColumn("counts",
        chem.parse_formula("formula")).where("counts IS NOT NULL AND precursor IS NOT NULL").withColumn("f", chem.valence_flags("counts", "precursor"))
    rates = [F.avg(F.col(f"f.{n}").cast("double")) for n in ("negative_rdbe", "hydrogen_excess", "above_precursor", "hard", "any")]
    return flags.groupBy("grp").agg(F.count("*").alias("n"), *[F.round(r, 9).alias(n) for r, n in zip(rates, ("negative_rdbe",
        "hydrogen_excess", "above_precursor", "hard", "any"))])


_GAPS = ", ".join(f"round(quantile_cont(gap, {p}), 6) AS gap_p{round(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9))


@query(sql("s ca sl el ch", f"""WITH {_COUNTS}, ms AS (SELECT formula, sum(n * mass) AS mass FROM cnt LEFT JOIN el USING (symbol)
    GROUP BY formula HAVING count(*) = count(mass)),
    q AS (SELECT list_min(list_transform(list_filter(mzs, lambda m: m IS NOT NULL), lambda m: abs(m - (mass + delta)))) AS gap FROM cls LEFT
    JOIN ms USING (formula) LEFT JOIN ch USING (ion_state) JOIN s ON s.spectrum_uid = cls.uid WHERE NOT exact)
    SELECT count(gap) AS n, {_GAPS}, round(avg((gap <= 0.5)::INT), 6) AS within_0_5, round(avg((gap <= 2)::INT), 6) AS within_2_0,
    round(avg((gap <= 15)::INT), 6) AS within_15_0 FROM q"""))
def miss_gaps(spark: SparkSession, d: str) -> DataFrame:
    """Distance of missed predictions' m/z to the nearest observed peak."""
    from peakloom.operators import match

    df = views.shared(spark, d, "mzs", *views.CANDIDATES)
    mz = chem.mass(chem.parse_formula("formula")) + chem.channel_offset("ion_state")
    missed = classified(df).where("NOT exact").withColumn("mz", mz).join(df.select(F.col("spectrum_uid").alias("uid"), "mzs"), "uid")
    out = analysis.gap_summary(missed.withColumn("gap", match.nearest_value(F.col("mz"), F.col("mzs"))))
    return out.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes])


def conditions(df: DataFrame) -> DataFrame:
    true = long.candidates(df).select(F.col("spectrum_uid").alias("uid"), "candidate_index", F.col("formula").alias("o_formula"),
        F.col("ion_state").alias("o_ion"))
    first = views.members(df).groupBy("uid", "target").agg(F.min("candidate_index").alias("candidate_index"))
    oracle = views.assignment(df).join(views.targets(df).select("uid", "target", "y", "t"), ["uid", "target"]).join(first, ["uid",
        "target"], "left").join(true, ["uid", "candidate_index"], "left")
    return analysis.counterfactuals(views.slots(df), oracle.select("uid", "slot", "o_formula", "o_ion", "y", "t"))


_MIXED_FORMULA = "CASE WHEN om IS NULL THEN pm + pi ELSE om + coalesce(CASE WHEN pm IS NOT NULL THEN pi END, oi) END"
_CONDITIONS = {
    "all_predicted": ("active", "pm + pi", "c"), "oracle_identity_predicted_weights": ("active", "coalesce(om + oi, pm + pi)", "c"),
        "predicted_identity_oracle_weights": ("active AND matched AND same", "pm + pi", "y"),
    "oracle_formula_predicted_ion": ("active", _MIXED_FORMULA, "c"), "predicted_formula_oracle_ion": ("active",
        """CASE WHEN oi IS NULL THEN pm + pi ELSE pm + oi END""", "c"),
    "oracle_identity_oracle_weights": ("matched", "coalesce(om + oi, pm + pi)", "y"), "oracle_identity_sqrt_weights": ("matched",
        "coalesce(om + oi, pm + pi)", "t"), "presence_forced_on_matched": ("active OR matched", "pm + pi", "c"),
}


@query(sql("s pk tr tg ca sl ed le me asg el ch", f"""WITH {_COUNTS}, ms AS (SELECT formula, sum(n * mass) AS mass FROM cnt LEFT
    JOIN el USING (symbol) GROUP BY formula HAVING count(*) = count(mass)),
    fc AS (SELECT uid, target, min(candidate_index) AS candidate_index FROM me GROUP BY ALL),
    ol AS (SELECT asg.uid, asg.slot, ca.formula AS o_formula, ca.ion_state AS o_ion, tg.y, tg.t FROM asg JOIN tg ON tg.uid = asg.uid
    AND tg.target = asg.target LEFT JOIN fc ON fc.uid = asg.uid AND fc.target = asg.target
           LEFT JOIN ca ON ca.spectrum_uid = asg.uid AND ca.candidate_index = fc.candidate_index),
    dd AS (SELECT presence * intensity AS c, presence >= 0.5 AS active, y IS NOT NULL AS matched, y, t, a.mass AS pm, b.mass AS om,
    x.delta AS pi, z.delta AS oi, sl.formula = o_formula AND sl.ion_state = o_ion AS same
           FROM sl LEFT JOIN ol ON ol.uid = sl.uid AND ol.slot = sl.slot LEFT JOIN ms a ON a.formula = sl.formula LEFT
           JOIN ms b ON b.formula = o_formula LEFT JOIN ch x ON x.ion_state = sl.ion_state LEFT JOIN ch z ON z.ion_state = o_ion),
    cf AS ({" UNION ALL ".join(f"SELECT '{n}' AS condition, {mz} AS mz, {w} AS weight FROM dd WHERE {on}" for n, (on, mz, w) in _CONDITIONS.items())})
    SELECT condition, count(*) AS peaks, round(sum(mz), 2) AS mz_sum, round(avg(ln(weight)), 6) AS log_weight FROM cf WHERE mz IS NOT NULL
    AND weight > 0 GROUP BY condition"""))
def counterfactual_peaks(spark: SparkSession, d: str) -> DataFrame:
    made = conditions(views.shared(spark, d, *views.SCORES))
    entries = [F.when(F.col(c).isNotNull(), F.struct(F.lit(c).alias("condition"), F.col(c).alias("weight"))) for c in analysis.CONDITIONS]
    each = made.select("mz", F.explode(F.array_compact(F.array(*entries))).alias("e")).select("mz", "e.*")
    return each.groupBy("condition").agg(F.count("*").alias("peaks"), F.round(F.sum("mz"), 2).alias("mz_sum"),
        F.round(F.avg(F.log("weight")), 6).alias("log_weight"))


_COND = """dd AS (SELECT sl.uid, presence * intensity AS c, presence >= 0.5 AS active, y IS NOT NULL AS matched, y, t, a.mass AS pm,
    b.mass AS om, x.delta AS pi, z.delta AS oi, sl.formula = o_formula AND sl.ion_state = o_ion AS same
           FROM sl LEFT JOIN ol ON ol.uid = sl.uid AND ol.slot = sl.slot LEFT JOIN ms a ON a.formula = sl.formula LEFT
           JOIN ms b ON b.formula = o_formula LEFT JOIN ch x ON x.ion_state = sl.ion_state LEFT JOIN ch z ON z.ion_state = o_ion)"""
_BIN = "CAST(floor(mz * (14999 / 1500.0::DOUBLE)) + 1 AS INTEGER)"
_FOUR = ", ".join(f"('{n}', {o}::DOUBLE, {p}::DOUBLE)" for n, o, p in scalar.FOUR_SPACES)
_COUNTERFACTUALS = f"""WITH {_COUNTS}, ms AS (SELECT formula, sum(n * mass) AS mass FROM cnt LEFT JOIN el USING (symbol) GROUP BY formula
    HAVING count(*) = count(mass)),
    fc AS (SELECT uid, target, min(candidate_index) AS candidate_index FROM me GROUP BY ALL),
    ol AS (SELECT asg.uid, asg.slot, ca.formula AS o_formula, ca.ion_state AS o_ion, tg.y, tg.t FROM asg JOIN tg ON tg.uid = asg.uid
    AND tg.target = asg.target LEFT JOIN fc ON fc.uid = asg.uid AND fc.target = asg.target
           LEFT JOIN ca ON ca.spectrum_uid = asg.uid AND ca.candidate_index = fc.candidate_index),
    {_COND},
    cf AS ({" UNION ALL ".join(f"SELECT uid, '{n}' AS condition, {mz} AS mz, {w} AS w FROM dd WHERE {on}" for n, (on, mz, w) in _CONDITIONS.items())}),
    sp AS (SELECT * FROM (VALUES {_FOUR}) AS v(space, o_pow, p_pow)),
    pb AS (SELECT uid, condition, space, {_BIN} AS bin, sum(pow(w, p_pow)) AS v FROM cf, sp WHERE mz IS NOT NULL AND w > 0
    AND {_BIN} BETWEEN 0 AND 14999 GROUP BY ALL),
    pn AS (SELECT * REPLACE (v / top AS v) FROM (SELECT *, max(v) OVER (PARTITION BY uid, condition, space) AS top FROM pb) WHERE v / top >= 1e-5),
    pp AS (SELECT *, row_number() OVER (PARTITION BY uid, condition, space ORDER BY round(v, 12) DESC, bin) AS place FROM pn),
    ob AS (SELECT spectrum_uid AS uid, space, bin, max(o) AS o FROM (SELECT spectrum_uid, space, pow(greatest(y, 0), o_pow) AS o,
    {_BIN} AS bin FROM pk, sp) WHERE bin BETWEEN 0 AND 14999 GROUP BY ALL),
    nr AS (SELECT uid, space, sqrt(sum(o * o)) AS n FROM ob GROUP BY ALL),
    cs AS (SELECT pp.uid, condition, pp.space, {", ".join(f"coalesce(sum(v * coalesce(o, 0)) FILTER (place <= {k}) / nullif(sqrt(sum(v * v) FILTER (place <= {k})) * max(n), 0), 0) AS c{k}" for k in (20, 100))}
           FROM pp LEFT JOIN ob ON ob.uid = pp.uid AND ob.space = pp.space AND ob.bin = pp.bin LEFT JOIN nr ON nr.uid = pp.uid
           AND nr.space = pp.space GROUP BY ALL)
    SELECT uid, {", ".join(f"round(coalesce(max(c{k}) FILTER (condition = '{c}' AND space = '{n}'), 0), 5) AS {c}_cos_at_{k}_{n}" for c in analysis.CONDITIONS for n, _, _ in scalar.FOUR_SPACES for k in (20, 100))} FROM cs GROUP BY uid"""


@query(sql("s pk tr tg ca sl ed le me asg el ch", _COUNTERFACTUALS))
def counterfactuals(spark: SparkSession, d: str) -> DataFrame:
    """Cosines at 20 and 100 of the eight conditions in four spaces, wide: one row per spectrum with a prediction."""
    df = views.shared(spark, d, *views.SCORES)
    observed = long.peaks(df).withColumnRenamed("spectrum_uid", "uid")
    scored = metrics.grid_cosines(observed, conditions(df), "uid", analysis.CONDITIONS, scalar.TOP_K, scalar.FOUR_SPACES)
    measures = [f"cos_at_{k}_{n}" for n, _, _ in scalar.FOUR_SPACES for k in scalar.TOP_K]
    wide = [F.round(F.coalesce(F.max(F.when(F.col("list") == c, F.col(m))), F.lit(0.0)), 5).alias(f"{c}_{m}") for c in analysis.CONDITIONS for m in measures]
    return scored.groupBy("uid").agg(*wide)


_AXIS = ", ".join(f"('{symbol}', {z})" for symbol, z in ELEMENTS.items())


@query(sql("s ca sl", f"""WITH {_COUNTS}, pa AS (SELECT formula, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol
    FROM (SELECT DISTINCT formula FROM s WHERE {_FORMULA})),
    ax AS (SELECT formula, symbol, row_number() OVER (PARTITION BY formula ORDER BY z) - 1 AS position FROM (SELECT DISTINCT formula, symbol
    FROM pa) JOIN (VALUES {_AXIS}) AS t(symbol, z) USING (symbol)),
    q AS (SELECT position, coalesce(a.n, 0) AS p, coalesce(b.n, 0) AS o FROM sl JOIN ca ON ca.spectrum_uid = sl.uid
    AND ca.candidate_index = sl.slot AND ca.formula <> '' JOIN s ON s.spectrum_uid = sl.uid JOIN ax ON ax.formula = s.formula
           LEFT JOIN cnt a ON a.formula = sl.formula AND a.symbol = ax.symbol LEFT JOIN cnt b ON b.formula = ca.formula AND b.symbol = ax.symbol)
    SELECT position::INT AS position, count(*) FILTER (p = o) AS correct, count(*) AS total, sum(abs(p - o))::BIGINT AS abs_error FROM q
    GROUP BY position"""))
def element_agreement(spark: SparkSession, d: str) -> DataFrame:
    df = views.shared(spark, d, "formula", *views.CANDIDATES)
    true = long.candidates(df).select(F.col("spectrum_uid").alias("uid"), F.col("candidate_index").alias("slot"), F.col("formula").alias("o_formula"))
    pairs = views.slots(df).join(true, ["uid", "slot"]).join(df.select(F.col("spectrum_uid").alias("uid"), F.col("formula").alias("precursor")), "uid")
    return analysis.element_agreement(pairs)


@query("""
    WITH c AS (SELECT p_brand AS uid, [1 + p_size % 6, 1 + p_partkey % 9, p_size % 3] AS c FROM part), n AS (SELECT uid, unnest([0, 1,
    2]) AS depth, c FROM c)
    SELECT uid, depth, list_transform(c[1:depth], lambda x: x::INT) AS prefix,
    list_sort(list_distinct(list(c[depth + 1]::INT))) AS children, count(*) AS members FROM n GROUP BY uid, depth, prefix""".replace("GROUP BY uid, depth, prefix", "GROUP BY ALL"))
def prefix_nodes(spark: SparkSession, d: str) -> DataFrame:
    counts = F.array((F.col("p_size") % 6 + 1).cast("int"), (F.col("p_partkey") % 9 + 1).cast("int"), (F.col("p_size") % 3).cast("int"))
    return scores.prefix_nodes(table(spark, d, "part").select(F.col("p_brand").alias("uid"), counts.alias("counts")))


@query("""SELECT event_id, round(value - m - ln(sum(exp(value - m)) OVER (PARTITION BY user_id)), 6) + 0.0 AS log_prob FROM (SELECT *,
    max(value) OVER (PARTITION BY user_id) AS m FROM events WHERE event_type <> 'error')""")
def masked_log_softmax(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ok", F.col("event_type") != "error")
    return scores.masked_log_softmax(e, ["user_id"], "value", "ok").select("event_id", F.round("log_prob", 6).alias("log_prob"))


@query("""SELECT event_id, round(CASE WHEN abs(value - 1) <= 0.5 THEN (value - 1) * (value - 1) / 2 ELSE 0.5 * (abs(value - 1) - 0.25) END,
    9) AS huber, round(1 / (1 + exp(-value)), 9) AS sigmoid, round(greatest(value, 0) + ln(1 + exp(-abs(value))), 9) AS softplus FROM events""")
def pointwise_losses(spark: SparkSession, d: str) -> DataFrame:
    v = F.col("value")
    return table(spark, d, "events").select("event_id", F.round(scalar.huber(v - 1.0, 0.5), 9).alias("huber"), F.round(scalar.sigmoid(v),
        9).alias("sigmoid"), F.round(scalar.softplus(v), 9).alias("softplus"))
