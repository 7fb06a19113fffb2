"""Queries of keys, texts, joins, sets, windows, grouping sets and reconciliation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from peakloom.functions import scalar
from peakloom.operators import analysis, batch, compare, quantiles, verify
from peakloom.operators import spectra as long
from peakloom.plans import views
from peakloom.plans.catalog import query
from peakloom.plans.views import sql
from peakloom.session import table
from peakloom.sources import tables
from peakloom.streaming import ingest


@query("""SELECT parent_spec, (concat('0x', substr(sha256(parent_spec), 1, 16))::UBIGINT % 64)::INT AS shard, printf('part-%05d.parquet',
    (concat('0x', substr(sha256(parent_spec), 1, 16))::UBIGINT % 64)::INT) AS file FROM (SELECT DISTINCT parent_spec FROM spectra_v2)""")
def shard_assign(spark: SparkSession, d: str) -> DataFrame:
    parents = table(spark, d, "spectra_v2").select("parent_spec").distinct().withColumn("shard", scalar.shard_of("parent_spec"))
    return parents.select("parent_spec", "shard", scalar.shard_file("shard").alias("file"))


@query("SELECT printf('%s:%02d', parent_spec, collision_index) AS uid, count(*) AS n FROM spectra_v2 GROUP BY 1")
def spectrum_uid(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spectra_v2").groupBy(scalar.spectrum_uid("parent_spec", "collision_index").alias("uid")).agg(F.count("*").alias("n"))


@query("""
    WITH t AS (SELECT DISTINCT collision_energy_raw AS token, trim(collision_energy_raw) AS x FROM spectra_v2 WHERE collision_energy_raw IS NOT NULL)
    SELECT token, CASE WHEN regexp_full_match(x, '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?') THEN
      least(greatest(length(regexp_extract(x, '\\.([0-9]*)', 1)) - coalesce(try_cast(regexp_extract(x, '[eE]([+-]?[0-9]+)$', 1) AS INT), 0),
      0), 127)::INT END AS places FROM t""")
def decimal_places(spark: SparkSession, d: str) -> DataFrame:
    tokens = table(spark, d, "spectra_v2").select(F.col("collision_energy_raw").alias("token")).where("token IS NOT NULL").distinct()
    return tokens.select("token", scalar.decimal_places("token").alias("places"))


@query(r"""
    SELECT DISTINCT collision_energies, list_transform(regexp_extract_all(regexp_extract(collision_energies, '\[(.*)\]', 1), $p$'(?:[^'\\]|\\.)*'|[^,\s]+$p$),
      lambda x: CASE WHEN left(x, 1) = '''' THEN replace(substr(x, 2, length(x) - 2), '\xa0', chr(160)) ELSE x END) AS items
    FROM spec_labels WHERE regexp_full_match(collision_energies, '\s*\[.*\]\s*')""")
def literal_list(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "spec_labels").select("collision_energies").distinct()
    return labels.select("collision_energies", scalar.literal_list("collision_energies").alias("items")).where("items IS NOT NULL")


def _na(c: str) -> str:
    return f"CASE WHEN {c} IS NULL OR trim({c}) = '' OR lower(trim({c})) = 'nan' THEN 'NA' ELSE trim({c}) END"


def _num(c: str, n: int) -> str:
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 'NA' ELSE printf('%.{n}f', {c}) END"


@query(f"""
    SELECT spectrum_uid, concat('SMILES=', {_na('smiles')}, ' | formula=', {_na('formula')}, ' | adduct=', {_na('adduct')},
    ' | collision_energy=', {_num('collision_energy', 2)}, ' | instrument=', {_na('instrument')}, ' | precursor_mz=',
    {_num('precursor_mz', 4)}) AS line
    FROM (SELECT DISTINCT spectrum_uid, smiles, formula, adduct, collision_energy, instrument, precursor_mz FROM spectra_v2)""")
def format_text(spark: SparkSession, d: str) -> DataFrame:
    cols = ["spectrum_uid", "smiles", "formula", "adduct", "collision_energy", "instrument", "precursor_mz"]
    return table(spark, d, "spectra_v2").select(*cols).distinct().select("spectrum_uid", scalar.format_row(*cols[1:]).alias("line"))


@query("""
    SELECT spec, collision_energies, smiles, formula, inchikey, ionization AS adduct, instrument,
    try_cast(precursor AS DOUBLE) AS precursor_mz FROM spec_labels""")
def label_projection(spark: SparkSession, d: str) -> DataFrame:
    return tables.labels_to_output(table(spark, d, "spec_labels")).select("spec", "collision_energies", "smiles", "formula", "inchikey",
        "adduct", "instrument", "precursor_mz")


@query("""
    WITH n AS (SELECT spec, CASE WHEN fold_0 = 'val' THEN 'valid' ELSE fold_0 END AS fold FROM spec_split)
    SELECT 'repeated' AS problem, spec FROM n WHERE spec IS NOT NULL GROUP BY spec HAVING count(*) > 1 UNION ALL SELECT 'missing', spec
    FROM n WHERE spec IS NULL OR trim(spec) = ''
    UNION ALL SELECT 'unknown_fold', spec FROM n WHERE coalesce(fold NOT IN ('train', 'valid', 'test'), true)""")
def split_problems(spark: SparkSession, d: str) -> DataFrame:
    return tables.split_problems(table(spark, d, "spec_split"))


@query("SELECT DISTINCT s.spec FROM spec_split s WHERE s.spec IS NOT NULL AND NOT EXISTS (SELECT 1 FROM spec_labels l WHERE l.spec = s.spec)")
def missing_keys_anti(spark: SparkSession, d: str) -> DataFrame:
    return tables.missing_labels(table(spark, d, "spec_split").where("spec IS NOT NULL"), table(spark, d, "spec_labels"))


@query("SELECT spectrum_uid, count(*) AS n FROM spectra_v2 WHERE parent_spec IN (SELECT spec FROM spec_labels) GROUP BY 1")
def semi_filter(spark: SparkSession, d: str) -> DataFrame:
    labels = table(spark, d, "spec_labels").select(F.col("spec").alias("parent_spec"))
    return table(spark, d, "spectra_v2").select("spectrum_uid", "parent_spec").join(labels, "parent_spec",
        "left_semi").groupBy("spectrum_uid").agg(F.count("*").alias("n"))


@query("""SELECT s.spec, CASE WHEN s.fold_0 = 'val' THEN 'valid' ELSE s.fold_0 END AS fold, l.formula, l.ionization AS adduct,
    l.spec IS NOT NULL AS labelled FROM (SELECT DISTINCT spec, fold_0 FROM spec_split WHERE spec IS NOT NULL) s LEFT
    JOIN (SELECT DISTINCT spec, formula, ionization FROM spec_labels) l ON s.spec = l.spec""")
def split_label_join(spark: SparkSession, d: str) -> DataFrame:
    splits = table(spark, d, "spec_split").where("spec IS NOT NULL").distinct()
    labels = table(spark, d, "spec_labels").select("spec", "formula", F.col("ionization").alias("adduct")).distinct().withColumn("labelled", F.lit(True))
    return splits.join(labels, "spec", "left").select("spec", tables.normal_fold(F.col("fold_0")).alias("fold"), "formula", "adduct",
        F.coalesce("labelled", F.lit(False)).alias("labelled"))


@query("SELECT spec FROM (SELECT DISTINCT spec FROM spec_split WHERE spec IS NOT NULL) ORDER BY spec LIMIT 100")
def limit_parents(spark: SparkSession, d: str) -> DataFrame:
    return tables.limit_parents(table(spark, d, "spec_split").select("spec").where("spec IS NOT NULL").distinct(), 100)


@query(sql("s", """
    SELECT spectrum_uid, fold FROM (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY (concat('0x', substr(sha256(parent_spec), 1,
    16))::UBIGINT % 64)::INT, parent_spec, collision_index) AS r FROM s)
    WHERE r <= CASE fold WHEN 'train' THEN 250 WHEN 'valid' THEN 251 ELSE 0 END"""))
def fold_budget(spark: SparkSession, d: str) -> DataFrame:
    df = views.supervision(spark, d, "fold", "parent_spec", "collision_index").withColumn("shard", scalar.shard_of("parent_spec"))
    return tables.fold_budget(df, 501).select("spectrum_uid", "fold")


@query("""SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS parts, count(*) AS n, sum(l_quantity) AS quantity,
    grouping_id(l_returnflag, l_linestatus)::BIGINT AS level FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus").agg(
        F.count_distinct("l_partkey").alias("parts"), F.count("*").alias("n"), F.sum("l_quantity").alias("quantity"), F.grouping_id().alias("level")
    )


@query("""SELECT fold, count(DISTINCT parent_spec) AS parents, count(*) AS spectra, sum(len(mzs))::BIGINT AS peaks,
    grouping_id(fold)::BIGINT AS level FROM spectra_v2 GROUP BY ROLLUP (fold)""")
def fold_counters(spark: SparkSession, d: str) -> DataFrame:
    return verify.counters(table(spark, d, "spectra_v2").select("fold", "parent_spec", "mzs"))


@query("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, grouping_id(o_orderstatus,
    o_orderpriority)::BIGINT AS level FROM orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")
def strata_grouping_sets(spark: SparkSession, d: str) -> DataFrame:
    table(spark, d, "orders").createOrReplaceTempView("peakloom_orders")
    return spark.sql("""SELECT o_orderstatus, o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, grouping_id() AS level
                        FROM peakloom_orders GROUP BY GROUPING SETS ((), (o_orderstatus), (o_orderpriority))""")


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS value_p50,
    round(quantile_cont(value, 0.9), 6) AS value_p90, round(quantile_cont(value, 0.99), 6) AS value_p99, max(value) AS greatest FROM events GROUP BY 1""")
def percentile_stats(spark: SparkSession, d: str) -> DataFrame:
    wanted = quantiles.percentiles("value", (0.5, 0.9, 0.99), "value")
    out = quantiles.aggregate(table(spark, d, "events"), ("event_type",), [F.count("*").alias("n"), F.avg("value").alias("mean"),
        F.max("value").alias("greatest")], wanted, reread=True)
    return out.select("event_type", "n", "greatest", *[F.round(c, 6).alias(c) for c in ("mean", "value_p50", "value_p90", "value_p99")])


@query(sql("s pk", """
    SELECT point::DOUBLE AS point, round(CASE point WHEN 0.1 THEN quantile_cont(y, 0.1) WHEN 0.5 THEN quantile_cont(y, 0.5)
    WHEN 0.9 THEN quantile_cont(y, 0.9) WHEN 0.99 THEN quantile_cont(y, 0.99) END, 6) AS value
    FROM pk, (VALUES (0.1), (0.5), (0.9), (0.99)) AS t(point) GROUP BY point"""))
def exact_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles of all peaks' intensities without gathering them in one task."""
    out = quantiles.exact_quantiles(long.peaks(views.supervision(spark, d, *views.PEAKS)), "y", (0.1, 0.5, 0.9, 0.99))
    return out.select("point", F.round("value", 6).alias("value"))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) / nullif(sum(value), 0), 6) AS pooled FROM events GROUP BY 1")
def pooled_ratio(spark: SparkSession, d: str) -> DataFrame:
    bought = F.sum(F.when(F.col("event_type") == "purchase", F.col("value")).otherwise(0.0))
    return table(spark, d, "events").groupBy("user_id").agg(F.round(scalar.safe_ratio(bought, F.sum("value")), 6).alias("pooled"))


@query("""
    SELECT o_orderkey, CASE WHEN m < 200 THEN '[0,200)' WHEN m < 300 THEN '[200,300)' WHEN m < 400 THEN '[300,400)'
    WHEN m < 600 THEN '[400,600)' ELSE '>=600' END AS mass_bucket,
      CASE WHEN m < 200 THEN '[-inf,200)' WHEN m < 300 THEN '[200,300)' WHEN m < 400 THEN '[300,400)' WHEN m < 600 THEN '[400,600)'
      WHEN m < 900 THEN '[600,900)' ELSE '[900,inf)' END AS bucket
    FROM (SELECT o_orderkey, o_totalprice / 500.0 AS m FROM orders)""")
def mass_bucket_strata(spark: SparkSession, d: str) -> DataFrame:
    m = F.col("o_totalprice") / 500.0
    return table(spark, d, "orders").select("o_orderkey", scalar.mass_bucket(m).alias("mass_bucket"), scalar.bucket_label(m, (200, 300, 400,
        600, 900)).alias("bucket"))


@query("""
    WITH p AS (SELECT o_orderpriority AS priority, o_orderstatus AS status, o_totalprice AS v FROM orders)
    SELECT 'priority' AS dimension, priority AS label, count(*) AS n, round(avg(v), 4) AS mean, round(median(v), 4) AS median FROM p
    GROUP BY priority UNION ALL SELECT 'status', status, count(*), round(avg(v), 4), round(median(v), 4) FROM p GROUP BY status""")
def stratify(spark: SparkSession, d: str) -> DataFrame:
    out = analysis.stratify(table(spark, d, "orders"), {"priority": F.col("o_orderpriority"), "status": F.col("o_orderstatus")}, "o_totalprice")
    return out.select("dimension", "label", "n", F.round("mean", 4).alias("mean"), F.round("median", 4).alias("median"))


@query(sql("s", """
    SELECT s.spectrum_uid, CAST(s.precursor_mz AS DOUBLE) AS precursor_mz, round(list_min(list_transform(list_filter(mzs,
    lambda m: m IS NOT NULL), lambda m: abs(m - precursor_mz))), 6) AS gap FROM s"""))
def nearest_peak(spark: SparkSession, d: str) -> DataFrame:
    """Distance of the precursor m/z to the nearest observed peak."""
    from peakloom.operators import match

    return views.supervision(spark, d, "precursor_mz", "mzs").select("spectrum_uid", "precursor_mz",
        F.round(match.nearest_value(F.col("precursor_mz"), F.col("mzs")), 6).alias("gap"))


@query("""SELECT 'union_all' AS op, count(*) AS n FROM (SELECT o_custkey FROM orders UNION ALL SELECT c_custkey FROM customer) UNION ALL
    SELECT 'union', count(*) FROM (SELECT o_custkey FROM orders UNION SELECT c_custkey FROM customer)
    UNION ALL SELECT 'intersect', count(*) FROM (SELECT o_custkey FROM orders INTERSECT SELECT c_custkey FROM customer) UNION ALL
    SELECT 'except', count(*) FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)
    UNION ALL SELECT 'except_all', count(*) FROM (SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer)""")
def set_ops(spark: SparkSession, d: str) -> DataFrame:
    o, c = table(spark, d, "orders").select(F.col("o_custkey").alias("k")), table(spark, d, "customer").select(F.col("c_custkey").alias("k"))
    made = {"union_all": o.unionAll(c), "union": o.union(c).distinct(), "intersect": o.intersect(c), "except": c.subtract(o), "except_all": o.exceptAll(c)}
    out = None
    for name, df in made.items():
        row = df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out


@query("""SELECT o_custkey, o_orderkey, ((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) % 4)::INT AS rank,
    ntile(3) OVER (PARTITION BY o_custkey ORDER BY o_orderkey)::INT AS chunk, lag(o_totalprice, 1, 0) OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey) AS previous, round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey
    ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS committed, dense_rank() OVER (PARTITION BY o_custkey
    ORDER BY o_orderpriority)::INT AS dense FROM orders""")
def rank_split(spark: SparkSession, d: str) -> DataFrame:
    """Round robin, contiguous chunks, previous value, running sum and dense rank."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    return table(spark, d, "orders").select(
        "o_custkey", "o_orderkey", F.pmod(F.row_number().over(w) - 1, F.lit(4)).alias("rank"), F.ntile(3).over(w).alias("chunk"),
        F.lag("o_totalprice", 1, 0.0).over(w).alias("previous"),
        F.round(F.coalesce(F.sum("o_totalprice").over(before), F.lit(0.0)), 4).alias("committed"),
            F.dense_rank().over(Window.partitionBy("o_custkey").orderBy("o_orderpriority")).alias("dense"),
    )


@query("""
    WITH v AS (SELECT label, vec_id, embedding::DOUBLE[] AS e FROM embeddings), u AS (SELECT label, vec_id, list_transform(e,
    lambda x: x / sqrt(list_sum(list_transform(e, lambda y: y * y)))) AS e FROM v),
         p AS (SELECT label, i, sum(e[i]) AS s, count(*) AS n FROM (SELECT label, e, unnest(range(1, len(e) + 1)) AS i FROM u) GROUP BY ALL)
    SELECT label, max(n) AS slots, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1.0)), 6) AS mean_cosine FROM p GROUP BY label""")
def pairwise_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Mean cosine over all pairs of a label's vectors, without building a pair."""
    v = table(spark, d, "embeddings").select("label", F.col("vec_id").alias("slot"), F.col("embedding").cast("array<double>").alias("v"))
    return analysis.slot_diversity(v, "label").select("label", "slots", F.round("mean_cosine", 6).alias("mean_cosine"))


@query("""
    WITH a AS (SELECT DISTINCT spectrum_uid, mzs FROM spectra_v2), b AS (SELECT spectrum_uid, mzs FROM fragment_supervision_v2),
         x AS (SELECT spectrum_uid, min(mzs) AS mzs FROM a GROUP BY 1), y AS (SELECT spectrum_uid, min(mzs) AS mzs FROM b GROUP BY 1)
    SELECT CASE WHEN y.spectrum_uid IS NULL THEN 'missing' WHEN x.spectrum_uid IS NULL THEN 'extra' WHEN x.mzs IS NOT DISTINCT
    FROM y.mzs THEN 'equal' ELSE 'different' END AS status, count(*) AS n FROM x FULL JOIN y USING (spectrum_uid) GROUP BY 1""".replace("y.spectrum_uid IS NULL", "y.k IS NULL").replace("x.spectrum_uid IS NULL", "x.k IS NULL").replace("""min(mzs) AS mzs FROM a""", """min(mzs) AS mzs, 1 AS k FROM a""").replace("""min(mzs) AS mzs FROM b""", """min(mzs) AS mzs, 1 AS k FROM b"""))
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    one = lambda name: long.distinct_spectra(table(spark, d, name).select("spectrum_uid", "mzs"))
    return compare.reconcile(one("spectra_v2"), one("fragment_supervision_v2"), "spectrum_uid", ["mzs"])


_DELIVERIES = """WITH a AS (SELECT spectrum_uid, min(mzs) AS m, min(intensities) AS y FROM (SELECT DISTINCT spectrum_uid, mzs, intensities
    FROM spectra_v2) GROUP BY 1 HAVING count(*) = 1),
         b AS (SELECT spectrum_uid, min(mzs) AS m, min(intensities) AS y FROM fragment_supervision_v2 GROUP BY 1),
         v AS (SELECT 'supervised' AS variant, * FROM b UNION ALL SELECT 'first_half', spectrum_uid, m, list_transform(y, lambda x: x / 2) FROM b
               UNION ALL SELECT 'mirrored', spectrum_uid, list_reverse(m), list_reverse(y) FROM b),
         j AS (SELECT variant, a.m IS NOT DISTINCT FROM v.m AS same, list_max(list_transform(list_zip(a.y, v.y),
         lambda z: abs(z[1]::DOUBLE - z[2]::DOUBLE))) AS d FROM a JOIN v USING (spectrum_uid))"""


def deliveries(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Spectra as they were taken up, without those re-ingested with other peaks, and as they were supervised."""
    taken = table(spark, d, "spectra_v2").select("spectrum_uid", "mzs", "intensities").distinct()
    once = taken.groupBy("spectrum_uid").agg(F.count("*").alias("n"), F.min("mzs").alias("mzs"),
        F.min("intensities").alias("intensities")).where("n = 1").drop("n")
    exact = lambda df: df.withColumn("intensities", F.col("intensities").cast("array<double>"))
    return exact(once), exact(views.supervision(spark, d, "mzs", "intensities"))


@query(_DELIVERIES + """ SELECT count(*) AS shared, count(*) FILTER (same) AS identical, round(max(d) FILTER (same), 4) AS max_difference
    FROM j WHERE variant = 'supervised'""")
def reproducibility(spark: SparkSession, d: str) -> DataFrame:
    """Two deliveries of the same spectra: how many have equal peaks, and the greatest difference of intensity of those."""
    once, supervised = deliveries(spark, d)
    out = compare.compare_predictions(once, supervised, "spectrum_uid", ("mzs",), "intensities")
    return out.withColumn("max_difference", F.round("max_difference", 4))


@query(_DELIVERIES + """ SELECT variant, count(*) AS shared, count(*) FILTER (same) AS identical, round(max(d) FILTER (same),
    4) AS max_difference FROM j GROUP BY variant""")
def variant_matrix(spark: SparkSession, d: str) -> DataFrame:
    """A delivery against three variants of the other, of which two are damaged on purpose."""
    once, supervised = deliveries(spark, d)
    half = supervised.withColumn("intensities", F.transform("intensities", lambda y: y / 2))
    mirrored = supervised.select("spectrum_uid", F.reverse("mzs").alias("mzs"), F.reverse("intensities").alias("intensities"))
    options = {"key": "spectrum_uid", "identities": ("mzs",), "values": "intensities"}
    out = compare.variants(once, {"supervised": supervised, "first_half": half, "mirrored": mirrored}, **options)
    return out.withColumn("max_difference", F.round("max_difference", 4))


@query("SELECT parent_spec, count(DISTINCT batch_no) AS ranks FROM ingest_log GROUP BY 1 HAVING count(DISTINCT batch_no) > 1")
def ranks_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Parents that more than one batch delivered: the batches stand in for ranks."""
    return batch.ranks_overlap(table(spark, d, "ingest_log"), "parent_spec", "batch_no")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def windowed_counts(spark: SparkSession, d: str) -> DataFrame:
    out = ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type", "value")
    return out.select("start", "event_type", "n", F.round("total", 4).alias("total"))


@query("SELECT l_orderkey, l_linenumber, count(*) - 1 AS extra FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg((F.count("*") - 1).alias("extra")).where("extra > 0")


@query("""
    WITH s AS (SELECT unnest(range(1000)) AS step) SELECT step, round(CASE WHEN step < 50 THEN (step + 1) / 50.0
    ELSE 0.1 + 0.9 * 0.5 * (1 + cos(least((step - 50) / 950.0, 1) * pi())) END, 9) AS factor, round(0.3 * pow(0.5, greatest(step - 100,
    0) / 200.0), 9) AS prefix FROM s""")
def rate_schedule(spark: SparkSession, d: str) -> DataFrame:
    steps = spark.range(1000).withColumnRenamed("id", "step")
    return steps.select("step", F.round(scalar.rate_factor("step", 50, 1000, 0.1), 9).alias("factor"), F.round(scalar.decayed_weight("step",
        0.3, 100, 0.5, 200), 9).alias("prefix"))


@query("""
    WITH log AS (SELECT CAST(year(o_orderdate) AS INTEGER) AS epoch, o_totalprice AS loss, 1 AS n FROM orders) SELECT epoch,
    count(*) AS steps, round(avg(loss), 4) AS loss_mean, sum(n)::BIGINT AS rows, max(loss) AS loss_max FROM log GROUP BY 1""")
def epoch_summary(spark: SparkSession, d: str) -> DataFrame:
    log = table(spark, d, "orders").select(F.year("o_orderdate").alias("epoch"), F.col("o_totalprice").alias("loss"), F.lit(1).alias("n"))
    return batch.epoch_summary(log).withColumn("loss_mean", F.round("loss_mean", 4))


@query("SELECT o_orderkey, o_totalprice, o_custkey FROM orders ORDER BY o_totalprice DESC, o_custkey DESC, o_orderkey LIMIT 1")
def best_so_far(spark: SparkSession, d: str) -> DataFrame:
    return batch.best_so_far(table(spark, d, "orders").select("o_orderkey", "o_totalprice", "o_custkey"), ("o_totalprice", "o_custkey"), "o_orderkey")


@query("SELECT l_orderkey AS step, l_partkey, l_quantity AS n, round(l_quantity / sum(l_quantity) OVER (PARTITION BY l_orderkey), 9) AS weight FROM lineitem")
def batch_shares(spark: SparkSession, d: str) -> DataFrame:
    df = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("step"), "l_partkey", F.col("l_quantity").alias("n"))
    return batch.shares(df).withColumn("weight", F.round("weight", 9))


@query(sql("s", """
    WITH c AS (SELECT spectrum_uid, len(mzs) AS peaks, coalesce(len(candidate_neutral_formula), 0) AS candidates, length(smiles) AS chars,
    len(edge_peak_index) AS edges, len(list_filter(supervision_rank, lambda r: r >= 0)) AS supervised FROM s)
    SELECT 'most_peaks' AS pick, arg_min(spectrum_uid, (-peaks, spectrum_uid)) AS spectrum_uid FROM c UNION ALL SELECT 'most_candidates',
    arg_min(spectrum_uid, (-candidates, spectrum_uid)) FROM c
    UNION ALL SELECT 'longest_smiles', arg_min(spectrum_uid, (-coalesce(chars, -1), spectrum_uid)) FROM c UNION ALL SELECT 'most_edges',
    arg_min(spectrum_uid, (-coalesce(edges, 0), spectrum_uid)) FROM c
    UNION ALL SELECT 'most_supervised', arg_min(spectrum_uid, (-coalesce(supervised, 0), spectrum_uid)) FROM c"""))
def stress_picks(spark: SparkSession, d: str) -> DataFrame:
    """The most extreme spectrum by each criterion, one aggregation."""
    df = views.supervision(spark, d, "mzs", "smiles", "candidate_neutral_formula", "edge_peak_index", *views.RANK)
    scores = {"most_peaks": F.greatest(F.size("mzs"), F.lit(0)), "most_candidates": F.greatest(F.size("candidate_neutral_formula"),
        F.lit(0)), "longest_smiles": F.coalesce(F.length("smiles"), F.lit(-1)), "most_edges": F.greatest(F.size("edge_peak_index"), F.lit(0))}
    scores["most_supervised"] = F.greatest(F.size(F.filter("supervision_rank", lambda r: r >= 0)), F.lit(0))
    wide = df.agg(*[F.min_by("spectrum_uid", F.struct((-v).alias("v"), "spectrum_uid")).alias(n) for n, v in scores.items()])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("pick"), F.col(n).alias("spectrum_uid")) for n in scores])).alias("p")).select("p.*")


@query()
def batch_pack(spark: SparkSession, d: str) -> DataFrame:
    """Budgeted batches of all spectra; tokens are taken as a quarter of the conditioning text's characters."""
    costs = analysis.cost_table(views.supervision(spark, d, "formula", "mzs", "edge_peak_index", *views.RANK)).select("spectrum_uid",
        (F.col("peaks") * 4 + 32).alias("tokens"), F.col("linked").alias("candidates"), "element_steps")
    return batch.plan_batches(costs, max_tokens=8192, max_candidates=1024)


@query()
def batch_ranks(spark: SparkSession, d: str) -> DataFrame:
    return batch.split_ranks(batch_pack(spark, d), 4, 2)


@query()
def batch_workload(spark: SparkSession, d: str) -> DataFrame:
    costs = analysis.cost_table(views.supervision(spark, d, "formula", "mzs", "edge_peak_index", *views.RANK)).select("spectrum_uid",
        (F.col("peaks") * 4 + 32).alias("tokens"), F.col("linked").alias("candidates"), "element_steps")
    return batch.workload(batch.plan_batches(costs, max_tokens=8192, max_candidates=1024), costs)


@query(sql("s pk", "SELECT spectrum_uid, CAST(arg_max(peak_index, (y, -mz, -peak_index)) AS INTEGER) AS peak_index, max(y) AS y FROM pk GROUP BY 1"))
def base_peak(spark: SparkSession, d: str) -> DataFrame:
    p = long.peaks(views.supervision(spark, d, *views.PEAKS))
    return p.groupBy("spectrum_uid").agg(F.max_by("peak_index", F.struct("y", -F.col("mz"), -F.col("peak_index"))).alias("peak_index"), F.max("y").alias("y"))


