"""SQL of problems 2 and 6: plain patterns over the same tables, written apart from the grammar and the csv reader."""

from __future__ import annotations

from peakloom.functions.elements import SYMBOLS

_NUMBER = r"([0-9]+([.,][0-9]+)?|[.,][0-9]+|[0-9]+\.)(e[+-]?[0-9]+)?"
_WORD = (
    r"(ev|electronvolts?|v|volts?|kev|kiloelectronvolts?|(kj|kilojoules?|kcal) ?(/|per) ?mol|nce|normali[sz]ed|ce|collision energy|[ch]id|cad|hcd|etd|ecd|ead|uvpd|as|frac(tion(al)?)?|[%=:(),_ \t])"
)
#: Whether a lower-case text without no-break spaces is one quantity.
_QUANTITY = rf"{_WORD}*\+?{_NUMBER}{_WORD}*"
_TEXT = "lower(replace({}, chr(160), ' '))"


def valid_energy(column: str) -> str:
    text = _TEXT.format(column)
    return f"({column} IS NULL OR trim({text}) = '' OR (regexp_full_match({text}, '{_QUANTITY}') AND NOT regexp_matches({text}, '[0-9]{{309}}|e\\+?[0-9]{{3}}')))"


def valid_formula(column: str) -> str:
    return f"coalesce(regexp_full_match({column}, '(({'|'.join(SYMBOLS)})(0*[1-9][0-9]*)?)+'), false)"


def valid_adduct(column: str) -> str:
    return f"coalesce(regexp_full_match(trim({column}), '(.*[^+0-9-])?0*1? *[+-]') AND NOT regexp_full_match(trim({column}), '.*[¹²³⁰-⁹][+-]'), false)"


P2_ENERGY = f"""
WITH t AS (SELECT spectrum_uid, collision_index, instrument, precursor_mz, collision_energy AS bare,
{_TEXT.format('collision_energy_raw')} AS x, collision_energy_raw IS NULL OR trim({_TEXT.format('collision_energy_raw')}) = '' AS blank,
             {valid_energy('collision_energy_raw')} AS valid FROM spectra_v2),
     u AS (SELECT *, regexp_extract(x, '{_NUMBER}') AS n, regexp_replace(x, '{_NUMBER}', ' ') AS rest FROM t),
     b AS (SELECT lower(regexp_replace(instrument, '[ \\t_-]+', '', 'g')) AS k, min(bare_unit) AS bare_unit FROM instrument_units GROUP BY 1
     HAVING min(bare_unit) = max(bare_unit)),
     c AS (SELECT u.*, CASE WHEN blank AND (isnan(bare) OR bare < 0 OR isinf(bare)) THEN NULL WHEN blank THEN bare
     WHEN valid THEN CAST(replace(n, ',', '.') AS DOUBLE) END AS number,
             CASE WHEN blank THEN NULL WHEN rest LIKE '%frac%' THEN 'NCE_frac' WHEN regexp_matches(rest, 'nce|normali|%') THEN 'NCE'
             WHEN regexp_matches(rest, 'kj|kilojoule') THEN 'kJ/mol' WHEN rest LIKE '%kcal%' THEN 'kcal/mol'
               WHEN regexp_matches(rest, 'kev|kiloelectron') THEN 'keV' WHEN regexp_matches(rest, 'ev|electronvolt') THEN 'eV'
               WHEN regexp_matches(rest, '(^|[^a-z])v(olts?)?([^a-z]|$)') THEN 'V' END AS written FROM u),
     d AS (SELECT c.*, CASE WHEN number IS NOT NULL THEN coalesce(written, bare_unit) END AS named FROM c LEFT
     JOIN b ON b.k = lower(regexp_replace(instrument, '[ \\t_-]+', '', 'g'))),
     e AS (SELECT d.*, unit_code, ev_per_unit, ref_mz, CASE WHEN ref_mz IS NULL THEN 1.0::DOUBLE WHEN precursor_mz > 0
     AND NOT isinf(precursor_mz) AND NOT isnan(precursor_mz) THEN precursor_mz / ref_mz END AS factor FROM d LEFT
     JOIN energy_units ON unit_code = named)
SELECT spectrum_uid, collision_index, unit_code AS energy_unit, number * ev_per_unit * factor AS energy_ev,
       CASE WHEN NOT blank AND NOT valid THEN 'invalid' WHEN blank AND bare IS NULL THEN 'missing' WHEN number IS NULL THEN 'invalid'
       WHEN unit_code IS NULL THEN 'unknown_unit' WHEN factor IS NULL THEN 'no_precursor' ELSE 'ok' END AS energy_status
FROM e"""

P2_FOUND = f"""SELECT DISTINCT spectrum_uid, CAST(round(energy_ev * 1000) AS BIGINT) AS energy_mev FROM ({P2_ENERGY})
    WHERE energy_status = 'ok' AND energy_unit <> 'eV'"""


def _by_delimiter(make) -> str:
    """A CASE over the three delimiters that occur."""
    return "CASE delim " + " ".join(f"WHEN {q} THEN {make(p)}" for q, p in (("','", ","), ("';'", ";"), ("chr(9)", "\t"))) + " END"


_SOUND = _by_delimiter(lambda d: f"regexp_full_match(line, '(\"([^\"]|\"\")*\"|[^\"{d}\\r\\n]*)({d}(\"([^\"]|\"\")*\"|[^\"{d}\\r\\n]*))*')")
# A delimiter before the line, so that every field follows one and an empty first field counts.
_PARTS = _by_delimiter(lambda d: f"regexp_extract_all('{d}' || line, '{d}(\"([^\"]|\"\")*\"|[^\"{d}\\r\\n]*)', 1)")

P6_FOUND = f"""
WITH r AS (SELECT record_id, line IS NULL OR line = '' AS none, coalesce({_SOUND}, true) AS sound, {_PARTS} AS parts FROM raw_spectra),
     f AS (SELECT record_id, none, sound, list_transform(parts, lambda p: CASE WHEN left(p, 1) = '"' THEN replace(substr(p, 2,
     length(p) - 2), '""', '"') ELSE p END) AS v FROM r),
     x AS (SELECT 'raw_spectra' AS rec_table, record_id::VARCHAR AS rec_key, CASE WHEN NOT none AND NOT sound THEN 'quoting'
     WHEN none OR len(v) <> 8 OR v IS NULL THEN 'column_count' WHEN NOT {valid_formula('v[3]')} THEN 'formula'
             WHEN NOT {valid_energy('v[5]')} THEN 'collision_energy' WHEN NOT {valid_adduct('v[4]')} THEN 'adduct' END AS reason FROM f
           UNION ALL SELECT 'spectra_v2', spectrum_uid, CASE WHEN NOT {valid_formula('formula')} THEN 'formula'
           WHEN NOT {valid_energy('collision_energy_raw')} THEN 'collision_energy' WHEN NOT {valid_adduct('adduct')} THEN 'adduct' END
           FROM spectra_v2)
SELECT DISTINCT rec_table, rec_key, reason FROM x WHERE reason IS NOT NULL"""

_FIELDS = ("spec", "collision_index", "formula", "adduct", "collision_energy_raw", "instrument", "precursor_mz", "remark")
_TYPES = {"collision_index": "INT", "precursor_mz": "DOUBLE"}


def _field(i: int, name: str) -> str:
    value = f"CASE WHEN reason IS NULL OR reason NOT IN ('quoting', 'column_count') THEN v[{i}] END"
    # Spark reads no exponent or fraction as an INT, nor signs and blanks as SQL's cast does.
    return f"try_cast({value} AS {_TYPES[name]})" if name in _TYPES else value


_RECORDS = P6_FOUND[: P6_FOUND.index("     x AS (")] + P6_FOUND[P6_FOUND.index("     x AS (") : P6_FOUND.index("           UNION ALL")].replace(
    "SELECT 'raw_spectra' AS rec_table, record_id::VARCHAR AS rec_key,", "SELECT record_id, v,"
)
P6_RECORDS = f"{_RECORDS}) SELECT record_id, {', '.join(f'{_field(i, n)} AS {n}' for i, n in enumerate(_FIELDS, 1))}, reason FROM x"

SQL = {"p2_energy": P2_ENERGY, "p2_found": P2_FOUND, "p6_records": P6_RECORDS, "p6_found": P6_FOUND}
