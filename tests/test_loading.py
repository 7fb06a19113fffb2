import csv

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.operators import loading

GOOD = "p1;3;C6H12O6;[M+H]+;20 eV;QTOF;181.07;ok"


@pytest.mark.parametrize("line, reason", [
    (GOOD, None), ('"p1";3;C6H12O6;[M+H]+;20 eV;QTOF;181.07;"a ""b"" ; c"', None), ('p1;3;C6H12O6;[M+H]+;;QTOF;181.07;"x\ny"', None),
        ('p1;3;C6H12O6;[M+H]+; ;;;""', None),
    (None, "column_count"), ("", "column_count"), ("p1;3", "column_count"), (GOOD + ";more", "column_count"), (GOOD.replace("ok", "a\nb"), "column_count"),
    (GOOD.replace("ok", '5" column'), "quoting"), (GOOD.replace("ok", '"open'), "quoting"), (GOOD.replace("ok", '"x"2'), "quoting"),
        (GOOD.replace("ok", '"said \\"ok\\" twice"'), "quoting"),
    (GOOD.replace("p1", 'p"1'), "quoting"), (GOOD.replace("ok", ' "a"'), "quoting"), (GOOD.replace("ok", 'a""b'), "quoting"), ('"' + GOOD,
        "quoting"), (GOOD.replace("ok", '"x" '), "quoting"),
    (GOOD.replace("C6H12O6", "Xx4"), "formula"), (GOOD.replace("C6H12O6", ""), "formula"), (GOOD.replace("C6H12O6", "C0"), "formula"),
        (GOOD.replace("C6H12O6", "C６"), "formula"),
    (GOOD.replace("20 eV", "20-40 eV"), "collision_energy"), (GOOD.replace("[M+H]+", "[M+2H]2+"), "adduct"), (GOOD.replace("[M+H]+",
        "[M+H]++"), "adduct"), (GOOD.replace("[M+H]+", ""), "adduct"),
    (GOOD.replace("C6H12O6", "x").replace("20 eV", "ramp"), "formula"),
])
def test_reasons(line, reason):
    assert loading.parse_record(line, ";")[1] == reason


@pytest.mark.parametrize("text, ok", [
    ("[M+H]+", 1), (" [M+H]+ ", 1), ("[M-H]1-", 1), ("[M+H]-", 1), ("+", 1), ("[M+H]01+", 1), ("[M+2H]2+", 0), ("[2M+2H] 2+", 0),
        ("[M-H]--", 0), ("[M]+.", 0), ("M+H", 0), ("[M-H]−", 0), ("[M+H]⁺", 0),
    ("[M+H]²+", 0), ("+-?", 0), (None, 0), ("  ", 0), ("[M+H]11+", 0),
])
def test_adducts(text, ok):
    if ok:
        assert loading.adduct(text) == text
    else:
        with pytest.raises(ValueError):
            loading.adduct(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='ab";,\n x', max_size=6), min_size=1, max_size=8), st.sampled_from(",;\t"))
def test_well_formed_records_round_trip(fields, delim):
    line = delim.join('"' + f.replace('"', '""') + '"' for f in fields)
    assert loading.split_record(line, delim, len(fields)) == fields


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet='a",\n', min_size=1, max_size=12))
def test_scanner_against_a_pattern(line):
    import re

    field = r'(?:"(?:[^"]|"")*"|[^",\n]*)'
    sound = re.fullmatch(rf"{field}(?:[,\n]{field})*", line) is not None
    assert all(ok for _, ok in loading.assemble(iter([line]), ",")) == sound


def test_assemble_joins_lines():
    lines = ['a,"b\n', 'c"\n', "d,e\n"]
    assert list(loading.assemble(iter(lines), ",")) == [('a,"b\nc"\n', True), ("d,e\n", True)]
    assert next(csv.reader(['a,"b\nc"\n'], strict=True)) == ["a", "b\nc"]


def test_tables(spark):
    long = "x" * 300_000
    rows = [(1, ";", GOOD, "clash"), (1, ";", GOOD, "clash"), (2, ",", GOOD, None), (3, None, GOOD, None), (4, ";", GOOD.replace("ok",
        long), None), (5, "||", GOOD, None)]
    df = spark.createDataFrame(rows, "record_id BIGINT, delim STRING, line STRING, formula STRING")
    got = sorted((r.record_id, r.reason or "", r.formula or "") for r in loading.load_delimited(df).collect())
    assert got == [(1, "", "C6H12O6"), (1, "", "C6H12O6"), (2, "column_count", ""), (3, "column_count", ""), (4, "", "C6H12O6"), (5, "column_count", "")]
    assert loading.load_delimited(df.limit(0)).count() == 0
    typed = spark.createDataFrame([("a", "C1", None, "[M]+"), ("b", None, "20", "[M]+"), ("c", "C1", "x", None), ("d", "C1", " ", None),
        (None, "C1", "5", "M+")], "spectrum_uid STRING, formula STRING, collision_energy_raw STRING, adduct STRING")
    assert {r.spectrum_uid: r.reason for r in loading.check_fields(typed).collect()} == {"a": None, "b": "formula", "c": "collision_energy",
        "d": "adduct", None: None}
    assert loading.check_fields(typed.limit(0)).count() == 0
