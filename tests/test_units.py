import pytest

from peakloom.operators.units import convert_energies, unit_table

SCHEMA = "id INT, collision_energy_raw STRING, collision_energy DOUBLE, instrument STRING, precursor_mz DOUBLE, energy_ev STRING, unit STRING"
NAN = float("nan")


@pytest.fixture(scope="module")
def tables(spark):
    instruments = spark.createDataFrame([("QTOF M7", "eV"), ("Ion Trap A1", "NCE"), ("TOF-TOF K2", "keV"), ("twice", "eV"), ("Twice", "V"),
        (None, "eV")], "instrument STRING, bare_unit STRING")
    units = spark.createDataFrame(
        [("eV", 1.0, None), ("V", 1.0, None), ("keV", 1000.0, None), ("kJ/mol", 0.0103642697, None), ("NCE", 1.0, 500.0), ("NCE_frac", 100.0, 500.0)],
        "unit_code STRING, ev_per_unit DOUBLE, ref_mz DOUBLE",
    )
    return instruments, units


def test_every_case(spark, tables):
    cases = [
        (1, "20 eV", 99.0, None, None, "ok", 20.0), (2, None, 30.0, " qtof_m7", None, "ok", 30.0), (3, " ", 30.0, "ION-TRAP a1", 250.0,
        "ok", 15.0), (4, None, 30.0, "Ion Trap A1", None, "no_precursor", None),
        (5, "0,05", 1.0, "TOF TOF K2", None, "ok", 50.0), (6, "35", 35.0, "elsewhere", 100.0, "unknown_unit", None), (7, "ramp", 35.0,
        "QTOF M7", 1.0, "invalid", None),
        (8, None, None, "QTOF M7", 1.0, "missing", None), (9, None, -1.0, "QTOF M7", 1.0, "invalid", None), (10, None, NAN, "QTOF M7", 1.0,
        "invalid", None), (11, "10 kJ per mol", None, None, None, "ok", 0.103642697),
        (12, "0.1 NCE fraction", None, None, 500.0, "ok", 10.0), (13, "5 kcal/mol", None, None, None, "unknown_unit", None), (14, "35",
        None, "twice", None, "unknown_unit", None), (15, "35", None, None, None, "unknown_unit", None),
    ]
    rows = [(*c[:5], "clash", "kept") for c in cases] * 2
    out = convert_energies(spark.createDataFrame(rows, SCHEMA), *tables).collect()
    assert len(out) == len(rows) and {r.unit for r in out} == {"kept"}
    got = {r.id: (r.energy_status, r.energy_ev) for r in out}
    for c in cases:
        assert got[c[0]][0] == c[5] and got[c[0]][1] == (None if c[6] is None else pytest.approx(c[6])), c


def test_join_without_broadcast_gives_the_same(spark, tables):
    df = spark.createDataFrame([(1, "35", None, "QTOF M7", 1.0, None, None)], SCHEMA)
    with pytest.raises(ValueError):
        convert_energies(df, *tables, max_rows=2)
    assert convert_energies(df.limit(0), *tables).count() == 0
    assert convert_energies(df, tables[0].limit(0), tables[1]).first().energy_status == "unknown_unit"


def test_unit_table(spark, tables):
    got = {r.unit: (r.scale, r.ref_mz) for r in unit_table(tables[1]).collect()}
    assert got["kJ/mol"] == (0.0103642697, None) and got["NCE"] == (1.0, 500.0)
    assert {r.unit: r.power for r in unit_table(tables[1]).collect()} == {"eV": 0, "V": 0, "keV": 0, "kJ/mol": 0, "NCE": 1, "NCE_frac": 1}
    for wrong in (("keV", 999.0, None), ("kJ/mol", 0.0104, None), ("NCE", 1.0, 400.0), ("NCE", 1.0, None), ("eV", 1.0, 500.0), ("furlong", 1.0, None)):
        with pytest.raises(ValueError, match=wrong[0]):
            unit_table(spark.createDataFrame([wrong], "unit_code STRING, ev_per_unit DOUBLE, ref_mz DOUBLE"))
    with pytest.raises(ValueError):
        unit_table(spark.createDataFrame([("m/s", 1.0, None)], "unit_code STRING, ev_per_unit DOUBLE, ref_mz DOUBLE"))
