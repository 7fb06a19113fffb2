"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from peakloom.llm import bpe, containers, lookalikes, sample, splits, terms, topn  # noqa: I001

QUERIES = {
    "p1_terms": terms.p1_terms,
    "p1_grams": terms.p1_grams,
    "p1_found": terms.p1_found,
    "p3_sample": sample.p3_sample,
    "p4_splits": splits.p4_splits,
    "p4_checks": splits.p4_checks,
    "p4_found": splits.p4_found,
    "p5_found": topn.p5_found,
    "p7_ids": bpe.p7_ids,
    "p7_round_trip": bpe.p7_round_trip,
    "p8_containers": containers.p8_containers,
    "p8_checks": containers.p8_checks,
    "p8_usage": containers.p8_usage,
    "p9_classes": lookalikes.p9_classes,
    "p9_forms": lookalikes.p9_forms,
    "p9_found": lookalikes.p9_found,
}

_P1_TERMS = """
WITH records AS (SELECT DISTINCT spectrum_uid, candidate_neutral_formula, candidate_ion_state FROM fragment_supervision_v2),
     terms AS (SELECT 'candidate_neutral_formula' AS field_name, spectrum_uid, unnest(candidate_neutral_formula) AS term FROM records
               UNION ALL SELECT 'candidate_ion_state', spectrum_uid, unnest(candidate_ion_state) FROM records),
     counted AS (SELECT field_name, term, count(*) AS occurrences, count(DISTINCT spectrum_uid) AS records FROM terms
                 WHERE term <> '' GROUP BY ALL)
SELECT field_name, term, occurrences, records,
       CASE WHEN records < 3 THEN 'rare' WHEN records * 100 > 5 * (SELECT count(DISTINCT spectrum_uid) FROM records) THEN 'common' END AS mark
FROM counted"""


# Fixed values of the SQL alone, apart from the operator's table: letters of other scripts above the Latin ones they look like,
# composed letters, signs, and Han beside Katakana.
_TWINS = (
    ("АВСЕНІЈКМОРЅТХҮ", "ABCEHIJKMOPSTXY"), ("асеһіјӏорѕухԁԛԝѵ", "acehijlopsyxdqwv"), ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧ", "ABEZHIKMNOPTYX"), ("ονϳ", "ovj"),
    ("ёїЁЇό", "ëïËÏó"), ("−‐⁃∶∗∼", "---:*~"), ("∙⋅•‧・", "·····"), ("∆∑∏µ", "ΔΣΠμ"), ("工力卜二八口", "エカトニハロ"),
)


def _look_alike_sql() -> str:
    """The form of a text by SQL's own normalisation, translate and patterns, and the table above."""
    pairs = [(o, p) for others, own in _TWINS for o, p in zip(others, own, strict=True)]
    pairs += [(chr(0xFEE0 + c), chr(c)) for c in range(0x21, 0x7F)]
    quoted = ["".join(side).replace("'", "''") for side in zip(*pairs)]
    text = r"regexp_replace(text, '\r\n|[\r\x{85}\x{2028}\x{2029}]', chr(10), 'g')"
    for pattern, to in (
        (r"[\x{AD}\x{61C}\x{180E}\x{200B}\x{200C}\x{200E}\x{200F}\x{2060}-\x{2064}\x{FEFF}]", "''"),
        (r"([^\x{1F000}-\x{1FAFF}\x{FE0F}\x{200D}])\x{200D}+", r"'\1'"),
        (r"\x{200D}+([^\x{1F000}-\x{1FAFF}\x{2600}-\x{27BF}\x{200D}]|$)", r"'\1'"), (r"^\x{200D}+", "''"),
        (r"[\x{A0}\x{1680}\x{2000}-\x{200A}\x{202F}\x{205F}\x{3000}]", "' '"),
    ):
        text = f"regexp_replace({text}, '{pattern}', {to}, 'g')"
    return f"nfc_normalize(translate({text}, '{quoted[0]}', '{quoted[1]}'))"


_P4_GROUPS = """
WITH RECURSIVE held AS (
         SELECT DISTINCT parent_spec AS p, upper(regexp_extract(inchikey, '[A-Za-z]{14}-[A-Za-z]{10}-[A-Za-z]')) AS k
         FROM spectra_v2 WHERE regexp_matches(inchikey, '(^|[^A-Za-z])[A-Za-z]{14}-[A-Za-z]{10}-[A-Za-z]($|[^A-Za-z])')),
     linked AS (SELECT DISTINCT a.p AS a, b.p AS b FROM held a JOIN held b USING (k)),
     reach(a, b) AS (SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a),
     parents AS (SELECT DISTINCT parent_spec AS p FROM spectra_v2 WHERE parent_spec IS NOT NULL),
     roots AS (SELECT p, coalesce(min(b), p) AS root FROM parents LEFT JOIN reach ON a = p GROUP BY p),
     folds AS (SELECT parent_spec AS p, CASE lower(trim(fold)) WHEN 'val' THEN 'valid' WHEN '' THEN NULL ELSE lower(trim(fold)) END AS f FROM spectra_v2),
     broken AS (SELECT root FROM roots JOIN folds USING (p) GROUP BY root HAVING count(DISTINCT f) > 1)"""


ORACLE_SQL = {
    "p9_found": f"""
WITH k AS (SELECT doc_id, text, {_look_alike_sql()} AS form FROM documents WHERE text IS NOT NULL)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM k a JOIN k b USING (form) WHERE a.doc_id < b.doc_id AND a.text <> b.text
AND regexp_matches(form, '\\S')""",
    "p1_terms": _P1_TERMS,
    "p1_grams": """
WITH records AS (SELECT DISTINCT spectrum_uid, candidate_neutral_formula, candidate_ion_state FROM fragment_supervision_v2),
     lists AS (SELECT 'candidate_neutral_formula' AS field_name, spectrum_uid, candidate_neutral_formula AS l FROM records
               UNION ALL SELECT 'candidate_ion_state', spectrum_uid, candidate_ion_state FROM records),
     runs AS (SELECT field_name, spectrum_uid, n, unnest(list_transform(range(1, len(l) - n + 2), lambda i: l[i:i + n - 1])) AS r
              FROM lists, (VALUES (1), (2), (3)) AS v(n) WHERE len(l) >= n)
SELECT field_name, CAST(n AS INTEGER) AS n, array_to_string(r, ' ') AS run, count(*) AS occurrences, count(DISTINCT spectrum_uid) AS records
FROM runs WHERE len(list_filter(r, lambda t: t IS NULL OR t = '')) = 0 GROUP BY field_name, n, r""",
    "p1_found": f"SELECT field_name, term, mark FROM ({_P1_TERMS}) WHERE mark IS NOT NULL",
    "p3_sample": """
WITH have AS (SELECT DISTINCT parent_spec, spectrum_uid FROM spectra_v2 WHERE parent_spec IS NOT NULL),
     arrived AS (SELECT parent_spec, min(batch_no) AS batch_no FROM ingest_log GROUP BY 1),
     known AS (SELECT DISTINCT parent_spec, batch_no FROM have JOIN arrived USING (parent_spec) WHERE batch_no IS NOT NULL),
     ranked AS (SELECT *, row_number() OVER (PARTITION BY batch_no ORDER BY md5('peakloom-sample-1:' || parent_spec), parent_spec) AS r,
                       count(*) OVER (PARTITION BY batch_no) AS size FROM known)
SELECT parent_spec, spectrum_uid, batch_no FROM have JOIN ranked USING (parent_spec) WHERE r <= (size * 5 + 99) // 100""",
    "p4_found": _P4_GROUPS + " SELECT p AS parent_spec, root AS group_key FROM roots JOIN broken USING (root)",
    "p4_checks": _P4_GROUPS + """
SELECT 'rows' AS check_name, count(*) AS n FROM spectra_v2 UNION ALL SELECT * FROM (VALUES ('parents_apart', 0), ('keys_apart', 0),
('shares_off', 0)) AS v(check_name, n)
UNION ALL SELECT 'rows_of_broken_groups', count(*) FROM folds JOIN roots USING (p) JOIN broken USING (root)""",
    "p7_round_trip": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
    "p8_checks": """
SELECT 'documents' AS check_name, count(*) AS violations FROM documents
UNION ALL SELECT unnest(['tokens_over', 'documents_over', 'attention_over', 'tokens_lost', 'cut_without_need', 'pieces_astray']), 0""",
    "p9_classes": f"""
WITH k AS (SELECT text, {_look_alike_sql()} AS form FROM documents WHERE text IS NOT NULL),
     c AS (SELECT form, count(DISTINCT text) AS texts, count(*) AS members FROM k WHERE regexp_matches(form, '\\S') GROUP BY form
     HAVING count(DISTINCT text) > 1)
SELECT texts, members, count(*) AS classes FROM c GROUP BY ALL""",
    "p5_found": """
WITH spectra AS (SELECT DISTINCT spectrum_uid, mzs, intensities FROM fragment_supervision_v2),
     peaks AS (SELECT spectrum_uid, unnest(range(least(len(mzs), len(intensities)))) AS i, mzs, intensities FROM spectra),
     ranked AS (SELECT spectrum_uid, i, row_number() OVER (PARTITION BY spectrum_uid ORDER BY intensities[i + 1] DESC, mzs[i + 1], i) AS place
                FROM peaks WHERE mzs[i + 1] IS NOT NULL AND intensities[i + 1] IS NOT NULL AND NOT isnan(intensities[i + 1]))
SELECT spectrum_uid, CAST(place AS INTEGER) AS place, CAST(i AS INTEGER) AS peak_index FROM ranked WHERE place <= 8""",
}
