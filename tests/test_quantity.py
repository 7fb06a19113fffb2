import pytest

from peakloom.functions import quantity as q

EV = {"20 eV": 20, "CE=25eV": 25, "HCD 30.0 eV": 30, "7.5 electronvolts": 7.5, "1.2e+01 EV": 12, "0,04 keV": 40, ".5 kiloelectronvolt": 500,
    "10 V": 10, "CID 9volts": 9}


@pytest.mark.parametrize("text, value", EV.items())
def test_energies(text, value):
    parsed = q.parse_quantity(text)
    assert parsed.status == q.VALID and q.convert(parsed.number, parsed.unit, q.ENERGY_IN_EV) == pytest.approx(value, rel=1e-9)


def test_molar_and_normalised():
    for text, factor in (("100 kJ/mol", 0.0103642697), ("100 kJ per mol", 0.0103642697), ("CE = 100 Kcal/mol", 0.0433641043)):
        parsed = q.parse_quantity(text)
        assert q.convert(parsed.number, parsed.unit, q.ENERGY_IN_EV) == pytest.approx(100 * factor, rel=1e-8)
    for text in ("30 NCE", "30%", "30 % (NCE)", "NCE30", "normalised collision energy 30", "0.3 NCE_frac", "fractional NCE 0,3"):
        parsed = q.parse_quantity(text)
        assert q.convert(parsed.number, parsed.unit, q.ENERGY_IN_EV, Z=250.0) == pytest.approx(15.0)
        assert q.convert(parsed.number, parsed.unit, q.ENERGY_IN_EV, Z=None) is None


@pytest.mark.parametrize("text", [
    "ramp", "eV", "20 eV; 40 eV", "10eV 20eV", "20-40 eV", "35 +/- 5 NCE", "-15", "-30 eV", "l5 eV", "1O eV", "0x14", "20..5", "1.2.3 keV",
        "2 0 eV", "[20, 40]", "10/20/40",
    "inf", "NaN eV", "1e999", "15 to 45 V", "n/a", "--", "20 eV V", "NCE 20 eV", "20 parsecs", "1,234.5",
])
def test_not_a_quantity(text):
    assert q.parse_quantity(text).status == q.NOT_A_QUANTITY


def test_blank_and_bare():
    assert {q.parse_quantity(t).status for t in (None, "", " ", "\xa0\t")} == {q.BLANK}
    for text, number in (("35", 35), ("CE 35", 35), ("HCD 35.5", 35.5), ("+20", 20), ("0", 0), ("6.0000e+01", 60)):
        parsed = q.parse_quantity(text)
        assert (parsed.status, parsed.number, parsed.unit) == (q.VALID, number, None)


def test_vectors_prefixes_and_offsets():
    speed = q.parse_quantity("3 m/s")
    assert speed.unit.dims == q.vector(L=1, T=-1)
    assert q.parse_quantity("2 m^2").unit.dims == q.vector(L=2)
    kelvin = q.Registry(q.SYMBOLS["K"])
    assert q.convert(20, q.parse_quantity("20 degC").unit, kelvin) == pytest.approx(293.15)
    assert q.convert(68, q.SYMBOLS["degF"], kelvin) == pytest.approx(293.15)
    assert q.convert(1, q.SYMBOLS["K"], q.Registry(q.SYMBOLS["degC"])) == pytest.approx(-272.15)
    assert q.ENERGY_IN_EV.plan(speed.unit) is None and q.convert(3, speed.unit, q.ENERGY_IN_EV) is None
    assert q.symbol("kPa").scale == 1e3 and q.symbol("mL").scale == pytest.approx(1e-6)
