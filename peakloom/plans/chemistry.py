"""Queries of formula algebra, enumeration, matching and supervision."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import chem, scalar
from peakloom.functions.elements import ELEMENTS
from peakloom.operators import match
from peakloom.operators import spectra as long
from peakloom.plans import views
from peakloom.plans.catalog import query
from peakloom.plans.views import sql
from peakloom.session import spread, table


def formulas(spark: SparkSession, d: str) -> DataFrame:
    """Distinct formulas of spectra and candidates that parse and whose elements all have a mass."""
    own = table(spark, d, "spectra_v2").select("formula")
    fragments = table(spark, d, "fragment_supervision_v2").select(F.explode("candidate_neutral_formula").alias("formula"))
    distinct = spread(own.union(fragments).distinct(), "formula")
    # Through a generator: a filter on the counts would be pushed below the distinct and parse every row.
    return distinct.select("formula", F.explode(F.array_compact(F.array(chem.parse_formula("formula")))).alias("counts"))


@query(sql("atoms", "SELECT formula, symbol, n FROM atoms"))
def parse_formula(spark: SparkSession, d: str) -> DataFrame:
    return formulas(spark, d).select("formula", F.explode("counts").alias("symbol", "n"))


@query(sql("atoms", """
    SELECT formula, string_agg(symbol || CASE WHEN n = 1 THEN '' ELSE n::VARCHAR END, '' ORDER BY
      CASE WHEN c AND symbol = 'C' THEN 0 WHEN c AND symbol = 'H' THEN 1 ELSE 2 END, symbol) AS hill
    FROM (SELECT *, bool_or(symbol = 'C') OVER (PARTITION BY formula) AS c FROM atoms) GROUP BY formula"""))
def hill_render(spark: SparkSession, d: str) -> DataFrame:
    return formulas(spark, d).select("formula", chem.hill("counts").alias("hill"))


@query(sql("fm", "SELECT formula, round(mass, 6) AS mass FROM fm"))
def formula_mass(spark: SparkSession, d: str) -> DataFrame:
    return formulas(spark, d).select("formula", F.round(chem.mass("counts"), 6).alias("mass"))


@query(sql("atoms", """
    SELECT formula, four - one / 2.0 + three / 2.0 + 1 AS rdbe, (one - (2 * four + 2 + three))::INT AS hydrogen_excess,
           four - one / 2.0 + three / 2.0 + 1 >= 0 AND one - (2 * four + 2 + three) <= 0 AS plausible
    FROM (SELECT formula, coalesce(sum(n) FILTER (symbol IN ('C', 'Si')), 0)::DOUBLE AS four, coalesce(sum(n) FILTER (symbol IN ('N', 'P')),
    0)::DOUBLE AS three,
                 coalesce(sum(n) FILTER (symbol IN ('H', 'F', 'Cl', 'Br', 'I', 'Na', 'K')), 0)::DOUBLE AS one FROM atoms GROUP BY formula)"""))
def valence(spark: SparkSession, d: str) -> DataFrame:
    return formulas(spark, d).select("formula", chem.rdbe("counts").alias("rdbe"), chem.hydrogen_excess("counts").alias("hydrogen_excess"),
        chem.is_plausible("counts").alias("plausible"))


@query(sql("s ca fo ats el ok atoms", """
    WITH pairs AS (SELECT DISTINCT s.formula AS precursor, ca.formula AS fragment FROM s JOIN ca USING (spectrum_uid)
                   WHERE s.formula IN (SELECT formula FROM ok) AND ca.formula IN (SELECT formula FROM ok)),
         diff AS (SELECT precursor, fragment, symbol, coalesce(a.n, 0) - coalesce(b.n, 0) AS n FROM
                  (SELECT precursor, fragment, symbol FROM pairs JOIN atoms ON formula = precursor UNION SELECT precursor, fragment, symbol
                  FROM pairs JOIN atoms ON formula = fragment) k
                  LEFT JOIN atoms a ON a.formula = precursor AND a.symbol = k.symbol LEFT JOIN atoms b ON b.formula = fragment
                  AND b.symbol = k.symbol)
    SELECT precursor, fragment, CASE WHEN min(n) < 0 THEN NULL WHEN max(n) = 0 THEN '[M]' ELSE string_agg(symbol || CASE WHEN n = 1 THEN ''
    ELSE n::VARCHAR END, '' ORDER BY
      CASE WHEN c AND symbol = 'C' THEN 0 WHEN c AND symbol = 'H' THEN 1 ELSE 2 END, symbol) FILTER (n > 0) END AS loss, sum(abs(n))::INT AS l1
    FROM (SELECT *, bool_or(symbol = 'C' AND n > 0) OVER (PARTITION BY precursor, fragment) AS c FROM diff) GROUP BY precursor, fragment""".replace("symbol, coalesce(a.n", "k.symbol, coalesce(a.n")))
def neutral_loss(spark: SparkSession, d: str) -> DataFrame:
    df = views.supervision(spark, d, "formula", *views.CANDIDATES)
    pairs = df.select("spectrum_uid", F.col("formula").alias("precursor")).join(long.candidates(df), "spectrum_uid").select("precursor",
        F.col("formula").alias("fragment")).distinct()
    known = formulas(spark, d)
    p = known.select(F.col("formula").alias("precursor"), F.col("counts").alias("p"))
    f = known.select(F.col("formula").alias("fragment"), F.col("counts").alias("f"))
    return pairs.join(p, "precursor").join(f, "fragment").select("precursor", "fragment", chem.neutral_loss("p", "f").alias("loss"),
        chem.distance("p", "f").alias("l1"))


@query("""
    WITH a AS (SELECT DISTINCT adduct, trim(adduct) AS t FROM spectra_v2 WHERE adduct IS NOT NULL),
         b AS (SELECT *, regexp_extract(t, '([0-9]*)\\s*[+-]$', 1) AS digits FROM a WHERE regexp_matches(t, '(^|[^+-])[+-]$')),
         c AS (SELECT *, right(t, 1) = '+' AS pos FROM b WHERE digits = '' OR digits::INT = 1)
    SELECT adduct, unnest(list_filter([CASE WHEN pos THEN 'protonated' ELSE 'deprotonated' END,
      CASE WHEN list_contains(regexp_extract_all(adduct, '[A-Z][a-z]?'), 'Na') THEN 'sodiated' END, CASE
      WHEN list_contains(regexp_extract_all(adduct, '[A-Z][a-z]?'), 'K') THEN 'potassiated' END,
      CASE WHEN NOT pos AND list_contains(regexp_extract_all(adduct, '[A-Z][a-z]?'), 'Cl') THEN 'chloride_retained' END],
      lambda x: x IS NOT NULL)) AS channel FROM c""")
def ion_channels(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "spectra_v2").select("adduct").distinct().select("adduct", F.explode(chem.ion_channels("adduct")).alias("channel"))


@query("""
    WITH f AS (SELECT DISTINCT 1 + p_size % 6 AS c, 1 + p_partkey % 9 AS h, p_size % 3 AS o FROM part),
         g AS (SELECT 'C' || c || 'H' || h || CASE WHEN o > 0 THEN 'O' || o ELSE '' END AS formula, c::BIGINT AS c, h::BIGINT AS h,
         o::BIGINT AS o FROM f)
    SELECT formula, x.c::INT AS c, y.h::INT AS h, z.o::INT AS o FROM g, LATERAL (SELECT unnest(range(g.c + 1)) AS c) x,
    LATERAL (SELECT unnest(range(g.h + 1)) AS h) y, LATERAL (SELECT unnest(range(g.o + 1)) AS o) z
    WHERE x.c + z.o + y.h > 0 AND x.c - y.h / 2.0 + 1 >= 0 AND y.h <= 2 * x.c + 2""")
def subformula_enum_valence(spark: SparkSession, d: str) -> DataFrame:
    """All plausible subformulas of the parts' formulas, the empty one left out."""
    c, h, o = (F.col("p_size") % 6 + 1).cast("int"), (F.col("p_partkey") % 9 + 1).cast("int"), (F.col("p_size") % 3).cast("int")
    f = F.concat(F.lit("C"), c.cast("string"), F.lit("H"), h.cast("string"), F.when(o > 0, F.concat(F.lit("O"), o.cast("string"))).otherwise(""))
    heavy = match.heavy_subformulas(table(spark, d, "part").select(f.alias("formula")))
    grid = heavy.withColumn("h", F.explode(F.sequence(F.lit(0), F.col("max_h")))).withColumn("counts", match.subformula("axis", "code",
        "h")).where(F.size("counts") > 0)
    return grid.where(chem.is_plausible("counts")).select("formula", chem.count("counts", "C").alias("c"), "h", chem.count("counts", "O").alias("o"))


_EDGES = f"""WITH RECURSIVE fo AS (SELECT DISTINCT formula FROM s WHERE regexp_full_match(formula, '(({'|'.join(ELEMENTS)})(0*[1-9][0-9]*)?)+')),
     sym AS (SELECT formula, symbol, sum(CASE WHEN n = '' THEN 1 ELSE n::INT END)::INT AS n FROM (SELECT formula,
     unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)', 1)) AS symbol, unnest(regexp_extract_all(formula, '([A-Z][a-z]?)([0-9]*)',
     2)) AS n FROM fo) GROUP BY ALL),
     hv AS (SELECT formula, n, mass, CASE WHEN symbol IN ('C', 'Si') THEN 2 WHEN symbol IN ('N', 'P') THEN 1 WHEN symbol IN ('F', 'Cl',
     'Br', 'I', 'Na', 'K') THEN -1 ELSE 0 END AS bonds, row_number() OVER (PARTITION BY formula ORDER BY symbol) AS pos
            FROM sym LEFT JOIN el USING (symbol) WHERE symbol <> 'H'),
     fin AS (SELECT formula, count(pos) AS last, coalesce(max(h.n), 0) AS max_h FROM fo LEFT JOIN hv USING (formula) LEFT
     JOIN (SELECT formula, n FROM sym WHERE symbol = 'H') h USING (formula) GROUP BY formula HAVING count(pos) = count(mass)),
     rec(formula, i, counts, mass, top_h) AS (SELECT formula, 0::BIGINT, []::INT[], 0.0::DOUBLE, 2::BIGINT FROM fin
       UNION ALL SELECT r.formula, r.i + 1, list_append(r.counts, k.k::INT), r.mass + k.k * hv.mass, r.top_h + k.k * hv.bonds FROM rec r
       JOIN hv ON hv.formula = r.formula AND hv.pos = r.i + 1 JOIN range(0, 1000) k(k) ON k.k <= hv.n),
     heavy AS (SELECT r.formula, r.mass, r.top_h, row_number() OVER (PARTITION BY r.formula ORDER BY r.mass, counts) - 1 AS heavy_rank,
     floor(r.mass / 0.05)::BIGINT AS bucket FROM rec r JOIN fin ON fin.formula = r.formula AND r.i = fin.last),
     ad AS (SELECT DISTINCT adduct, trim(adduct) AS t FROM s), ap AS (SELECT adduct, right(t, 1) = '+' AS pos, regexp_extract_all(adduct,
     '[A-Z][a-z]?') AS tok FROM ad WHERE regexp_matches(t, '(^|[^+-])[+-]$') AND (regexp_extract(t, '([0-9]*)\\s*[+-]$',
     1) = '' OR regexp_extract(t, '([0-9]*)\\s*[+-]$', 1)::INT = 1)),
     ac AS (SELECT adduct, unnest(list_filter([CASE WHEN pos THEN 'protonated' ELSE 'deprotonated' END, CASE WHEN list_contains(tok,
     'Na') THEN 'sodiated' END, CASE WHEN list_contains(tok, 'K') THEN 'potassiated' END, CASE WHEN NOT pos AND list_contains(tok,
     'Cl') THEN 'chloride_retained' END], lambda x: x IS NOT NULL)) AS ion_state FROM ap),
     pb AS (SELECT s.spectrum_uid, s.formula, ac.ion_state, delta, i AS peak_index, mzs[i + 1] AS mz, mz_decimal_places[i + 1] AS dp, max_h
     FROM (SELECT *, unnest(range(len(mzs))) AS i FROM s) s JOIN ac USING (adduct) JOIN ch USING (ion_state) JOIN fin USING (formula)
     WHERE mzs[i + 1] IS NOT NULL),
     pt AS (SELECT *, CASE WHEN dp >= 2 THEN greatest(mz * 1e-5, 0.5 * pow(10, -dp)) ELSE mz * 1e-5 END + 1e-9 AS tol FROM pb),
     ph AS (SELECT pt.*, k.k AS h, mz - delta - k.k * {views.OWN_MASS["H"]!r}::DOUBLE AS centre FROM pt JOIN range(0,
     1000) k(k) ON k.k <= max_h WHERE mz - delta - k.k * {views.OWN_MASS["H"]!r}::DOUBLE + tol >= -0.001),
     pk2 AS (SELECT *, unnest(range(floor((centre - tol - 1e-7) / 0.05)::BIGINT, floor((centre + tol + 1e-7) / 0.05)::BIGINT + 1)) AS bucket FROM ph),
     hit AS (SELECT spectrum_uid, peak_index, mz, ion_state, h, heavy_rank, heavy.mass + h * {views.OWN_MASS["H"]!r}::DOUBLE + delta AS theo
     FROM pk2 JOIN heavy ON heavy.formula = pk2.formula AND heavy.bucket = pk2.bucket
             WHERE abs(mz - (heavy.mass + h * {views.OWN_MASS["H"]!r}::DOUBLE + delta)) <= tol AND (h > 0 OR heavy.mass > 0) AND h <= top_h),
     ix AS (SELECT hit.*, list_position(['protonated', 'deprotonated', 'sodiated', 'potassiated', 'chloride_retained'], ion_state) AS c FROM hit)
SELECT spectrum_uid, CAST(row_number() OVER (PARTITION BY spectrum_uid ORDER BY c, peak_index, h, heavy_rank) - 1 AS INTEGER) AS edge_index,
CAST(peak_index AS INTEGER) AS peak_index,
       CAST(dense_rank() OVER (PARTITION BY spectrum_uid ORDER BY c, heavy_rank, h) - 1 AS INTEGER) AS candidate_index,
       ion_state AS channel, CAST(h AS INTEGER) AS h, round(theo, 6) AS theo_mz, round((mz - theo) / theo * 1e6, 3) AS error_ppm FROM ix"""


@query(f"WITH {', '.join(f'{n} AS ({views.CTE[n]})' for n in ('s', 'el', 'ch'))} SELECT * FROM ({_EDGES})")
def candidate_edges(spark: SparkSession, d: str) -> DataFrame:
    """The interval join on real spectra: every peak of every distinct spectrum against the subformulas of its formula."""
    spectra = views.shared(spark, d, "formula", "adduct", "mzs", "mz_decimal_places")
    return match.number_candidates(match.match_edges(spectra)).select(
        "spectrum_uid", "edge_index", "peak_index", "candidate_index", "channel", "h", F.round("theo_mz", 6).alias("theo_mz"),
        F.round(scalar.ppm_error("mz", "theo_mz"), 3).alias("error_ppm")
    )


@query(sql("s", f"""
    WITH d AS (SELECT formula, adduct, count(*) AS n FROM s GROUP BY ALL),
         p AS (SELECT formula, CASE WHEN formula IS NULL OR NOT regexp_full_match(formula,
         '(({'|'.join(ELEMENTS)})(0*[1-9][0-9]*)?)+') THEN 'not_a_formula' END AS bad FROM (SELECT DISTINCT formula FROM s)),
         a AS (SELECT adduct, regexp_matches(trim(adduct), '(^|[^+-])[+-]$') AND coalesce(try_cast(nullif(regexp_extract(trim(adduct),
         '([0-9]*)\\s*[+-]$', 1), '') AS INT), 1) = 1 AS good FROM (SELECT DISTINCT adduct FROM s)),
         r AS (SELECT d.formula, n, coalesce(bad, CASE WHEN NOT coalesce(good, false) THEN 'unsupported_adduct' END) AS reason
               FROM d JOIN p ON d.formula IS NOT DISTINCT FROM p.formula JOIN a ON d.adduct IS NOT DISTINCT FROM a.adduct)
    SELECT reason, sum(n)::BIGINT AS spectra, count(DISTINCT coalesce(formula, '')) AS formulas FROM r WHERE reason IS NOT NULL GROUP BY reason"""))
def match_problems(spark: SparkSession, d: str) -> DataFrame:
    """Spectra without candidates by reason: nothing is left out in silence."""
    return match.problems(views.supervision(spark, d, "formula", "adduct"))


@query()
def build_supervision(spark: SparkSession, d: str) -> DataFrame:
    return match.build_supervision(views.shared(spark, d, "parent_spec", "fold", "formula", "adduct", *views.PEAKS))


@query("""
    SELECT l.l_orderkey AS uid, p.p_partkey AS part, round(l.l_extendedprice / 75.0, 6) AS mz,
    round((l.l_extendedprice / 75.0 - p.p_retailprice) / p.p_retailprice * 1e6, 4) AS ppm
    FROM lineitem l JOIN part p ON p.p_retailprice BETWEEN l.l_extendedprice / 75.0 - (CASE
    WHEN l.l_linenumber % 4 >= 2 THEN greatest(l.l_extendedprice / 75.0 * 1e-5, 0.5 * pow(10, -(l.l_linenumber % 4)))
    ELSE l.l_extendedprice / 75.0 * 1e-5 END)
      AND l.l_extendedprice / 75.0 + (CASE WHEN l.l_linenumber % 4 >= 2 THEN greatest(l.l_extendedprice / 75.0 * 1e-5, 0.5 * pow(10,
      -(l.l_linenumber % 4))) ELSE l.l_extendedprice / 75.0 * 1e-5 END)""")
def tolerance_join(spark: SparkSession, d: str) -> DataFrame:
    p = views.lineitem_peaks(spark, d).withColumn("tol", scalar.mass_tolerance("mz", "dp")).withColumn("low",
        F.col("mz") - F.col("tol")).withColumn("high", F.col("mz") + F.col("tol"))
    build = table(spark, d, "part").select(F.col("p_partkey").alias("part"), F.col("p_retailprice").alias("mass"))
    pairs = match.interval_join(p, build, "low", "high", "mass", broadcast_rows=100_000)
    return pairs.select("uid", "part", F.round("mz", 6).alias("mz"), F.round(scalar.ppm_error("mz", "mass"), 4).alias("ppm"))


@query(sql("s", """
    SELECT spectrum_uid, CAST(i AS INTEGER) AS peak_index, CASE WHEN m THEN CAST(row_number() OVER (PARTITION BY spectrum_uid, m ORDER BY
    CASE WHEN NOT isnan(y) THEN y END DESC NULLS LAST, mz NULLS FIRST, i) - 1 AS INTEGER) ELSE -1 END AS rank
    FROM (SELECT spectrum_uid, i, coalesce(supervision_mask[i + 1], false) AS m, mzs[i + 1] AS mz, intensities[i + 1] AS y
          FROM (SELECT *, unnest(range(greatest(len(mzs), len(intensities), len(supervision_mask)))) AS i FROM s))"""))
def supervision_rank(spark: SparkSession, d: str) -> DataFrame:
    df = views.supervision(spark, d, "mzs", "intensities", "supervision_mask")
    return df.select("spectrum_uid", F.posexplode(long.supervision_rank(F.col("mzs"), F.col("intensities"),
        F.col("supervision_mask"))).alias("peak_index", "rank"))


@query(sql("s", """
    SELECT spectrum_uid, CAST(t.i AS INTEGER) AS peak_index, CAST(r AS INTEGER) AS target
    FROM (SELECT spectrum_uid, unnest(list_zip(supervision_rank, range(len(supervision_rank)))) AS z FROM s) , LATERAL (SELECT z[1] AS r,
    z[2] AS i) t WHERE r BETWEEN 0 AND 63"""))
def top_slots(spark: SparkSession, d: str) -> DataFrame:
    ordered = views.supervision(spark, d, *views.RANK).select("spectrum_uid",
        F.posexplode(long.targets(F.col("supervision_rank"))).alias("target", "peak_index"))
    return ordered.select("spectrum_uid", "peak_index", "target")


@query(sql("s ed le", """
    SELECT s.spectrum_uid, len(list_filter(supervision_rank, lambda r: r BETWEEN 0 AND 63))::INT AS targets, len(mzs)::INT AS peaks,
    coalesce(l.linked, 0)::INT AS linked, coalesce(l.many, 0)::INT AS ambiguous_targets
    FROM s LEFT JOIN (SELECT spectrum_uid, sum(n) AS linked, count(*) FILTER (n >= 2) AS many FROM (SELECT spectrum_uid, target,
    count(*) AS n FROM le GROUP BY ALL) GROUP BY ALL) l USING (spectrum_uid)"""))
def cost_table(spark: SparkSession, d: str) -> DataFrame:
    from peakloom.operators import analysis

    return analysis.cost_table(views.supervision(spark, d, "formula", "mzs", "edge_peak_index", *views.RANK)).select("spectrum_uid",
        "targets", "peaks", "linked", "ambiguous_targets")
