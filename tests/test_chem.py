import itertools
import random

import pytest
from pyspark.sql import functions as F

from peakloom.functions import chem
from peakloom.functions.elements import ELEMENTS, ION_CHANNELS, MASSES
from peakloom.operators import match
from tests_support import VALENCE, draw, hill, plausible, rings, spare


def column(spark, values, kind="STRING"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i INT, x {kind}")


def run(spark, values, make):
    return [r[1] for r in sorted(column(spark, values).select("i", make(F.col("x"))).collect())]


def parsed(make):
    return lambda c: make(chem.parse_formula(c))


@pytest.fixture(scope="module")
def drawn():
    rng = random.Random(17)
    return [draw(rng, tuple(VALENCE)) for _ in range(150)] + [draw(rng, tuple(ELEMENTS), 40) for _ in range(60)]


def test_parse_drawn_formulas(spark, drawn):
    texts = [t for t, _ in drawn]
    assert run(spark, texts, chem.parse_formula) == [c for _, c in drawn]
    assert run(spark, texts, chem.formula_problem) == [None] * len(texts) and all(run(spark, texts, chem.is_formula))


def test_damaged_formulas(spark, drawn):
    rng = random.Random(3)
    damages = (
        lambda t: t + rng.choice("!+-. ?"), lambda t: rng.choice("7 .(") + t, lambda t: t.lower(), lambda t: "Jq" + t, lambda t: t + "N0", lambda t: t + "O000",
        lambda t: t[:1] + "١" + t[1:] if t[1:2].islower() is False else t + "١", lambda t: t + "\n", lambda t: "",
    )
    bad = [damage(t) for t, _ in drawn[:12] for damage in damages] + [None]
    assert run(spark, bad, chem.parse_formula) == [None] * len(bad)
    assert run(spark, bad, chem.formula_problem) == ["not_a_formula"] * len(bad)
    with pytest.raises(Exception, match="not a formula"):
        run(spark, ["Jq4"], lambda c: chem.parse_formula(c, strict=True))


def test_counts_beyond_the_readable_are_set_apart(spark):
    most = chem.READABLE_COUNT
    texts = [f"N{most}", f"N{most + 1}", f"N{most}O2N", "C99999999999H2", "Ge" + "9" * 40, "H" + "0" * 40 + "7"]
    reasons = run(spark, texts, chem.formula_problem)
    assert reasons == [None, "count_out_of_range", "count_out_of_range", "count_out_of_range", "count_out_of_range", None]
    assert run(spark, texts, chem.parse_formula) == [{"N": most}, None, None, None, None, {"H": 7}]
    huge = "C1000000N1000000O1000000S1000000P1000000H1000000"
    assert run(spark, [huge], parsed(chem.subformulas))[0] > match.HEAVY_CAP
    assert run(spark, [huge], parsed(chem.rdbe)) == [rings({s: most for s in "CNOSPH"} | {"O": 0, "S": 0})]


def test_rendering_masses_and_valence(spark, drawn):
    texts, counts = [t for t, _ in drawn], [c for _, c in drawn]
    assert run(spark, texts, parsed(chem.hill)) == [hill(c) for c in counts]
    assert run(spark, texts, parsed(chem.mass)) == pytest.approx([sum(n * MASSES[s] for s, n in c.items()) for c in counts])
    usual = [(t, c) for t, c in drawn if set(c) <= set(VALENCE)]
    assert run(spark, [t for t, _ in usual], parsed(chem.rdbe)) == [rings(c) for _, c in usual]
    assert run(spark, [t for t, _ in usual], parsed(chem.hydrogen_excess)) == [spare(c) for _, c in usual]
    verdicts = [plausible(c) for _, c in usual]
    assert run(spark, [t for t, _ in usual], parsed(chem.is_plausible)) == verdicts and len(set(verdicts)) == 2
    guard = [1 <= len(c) <= chem.MAX_ELEMENTS and max(c.values()) <= chem.MAX_COUNT for c in counts]
    assert run(spark, [*texts, f"N{chem.MAX_COUNT + 1}"], parsed(chem.count_guard)) == [*guard, False]


def test_every_element_has_a_number_and_a_mass(spark):
    symbols = list(ELEMENTS)
    assert run(spark, symbols, chem.atomic_number) == list(range(1, 119)) and run(spark, ["Jq", None], chem.atomic_number) == [None, None]
    masses = run(spark, symbols, chem.element_mass)
    assert all(0.9 * 2 * z < m < 3.2 * z for z, m in enumerate(masses[1:], start=2)) and masses == list(MASSES.values())
    assert all(abs(m - round(m)) < 0.22 for m in masses)  # near a whole number of nucleons
    assert run(spark, ["1", "118", "0", "119", "x"], lambda c: chem.element_symbol(c.try_cast("int"))) == [symbols[0], symbols[-1], None, None, None]


def test_losses(spark):
    rng = random.Random(8)
    pairs = [(draw(rng), draw(rng, most=3)) for _ in range(60)] + [(d := draw(rng), d) for _ in range(3)]
    df = spark.createDataFrame([(i, p[0], f[0]) for i, (p, f) in enumerate(pairs)], "i INT, p STRING, f STRING")
    p, f = chem.parse_formula("p"), chem.parse_formula("f")
    rows = df.select("i", chem.neutral_loss(p, f), chem.distance(p, f)).orderBy("i").collect()
    for (_, a), (_, b), row in ((*pair, row) for pair, row in zip(pairs, rows)):
        rest = {s: a.get(s, 0) - b.get(s, 0) for s in a | b}
        assert row[1] == (None if min(rest.values()) < 0 else hill(rest) or "[M]")
        assert row[2] == sum(map(abs, rest.values()))
    assert any(r[1] for r in rows) and any(r[1] is None for r in rows)


def test_channels(spark):
    offsets = {name: mass for name, _, _, mass in ION_CHANNELS}
    parts = ("+H", "-H", "+Na", "+K", "+Cl", "+Li", "+HCOO", "-H2O+Na")
    cases = {}
    for part, charge, sign, blank in itertools.product(parts, ("", "1", "2", "01", "3"), "+-", ("", " ")):
        names = [("protonated" if sign == "+" else "deprotonated")] + ["sodiated"] * ("Na" in part) + ["potassiated"] * ("K" in part) + ["chloride_retained"] * (sign == "-" and "Cl" in part)
        cases[f"{blank}[M{part}]{charge}{sign}{blank}"] = names if charge in ("", "1", "01") else None
    assert run(spark, list(cases), chem.ion_channels) == list(cases.values())
    assert run(spark, list(cases), lambda c: chem.is_admissible(F.lit("sodiated"), c)) == [None if v is None else "sodiated" in v for v in cases.values()]
    assert run(spark, ["[M+H]++", "[M]+-", "", None, "M+H", "[M+H]"], chem.ion_channels) == [None] * 6
    assert run(spark, list(offsets), chem.channel_offset) == list(offsets.values())


def brute_subformulas(counts):
    """(mass, counts) of all subformulas without hydrogen, by mass, ties with the last element fastest."""
    heavy = sorted(s for s in counts if s != "H")
    rows = [(sum(k * MASSES[s] for s, k in zip(heavy, ks)), i, {s: k for s, k in zip(heavy, ks) if k}) for i,
        ks in enumerate(itertools.product(*(range(counts[s] + 1) for s in heavy)))]
    return sorted(rows, key=lambda r: (r[0], r[1]))


def test_enumeration_against_product(spark):
    rng = random.Random(29)
    drawn = dict(draw(rng, ("C", "H", "N", "O", "Ge", "Ag", "Cl"), 4) for _ in range(12)) | {"H3": {"H": 3}}
    df = match.rank_by_mass(match.heavy_subformulas(column(spark, [*drawn, "bad!", None, "N99999999999", *drawn]), column="x"))
    rows = df.select("formula", "max_h", "heavy_rank", "heavy_mass", "top_h", match.subformula("axis", F.col("code"), F.lit(0)).alias("heavy")).collect()
    assert {r.formula for r in rows} == set(drawn)
    bonds = {"C": 2, "N": 1, "Cl": -1}
    for formula, counts in drawn.items():
        own = sorted((r for r in rows if r.formula == formula), key=lambda r: r.heavy_rank)
        want = brute_subformulas(counts)
        assert [r.heavy_rank for r in own] == list(range(len(want))) and [r.heavy_mass for r in own] == pytest.approx([w[0] for w in want])
        assert [r.heavy for r in own] == [w[2] for w in want] and {r.max_h for r in own} == {counts.get("H", 0)}
        assert [r.top_h for r in own] == [2 + sum(bonds.get(s, 0) * k for s, k in w[2].items()) for w in want]


def test_enumeration_cap(spark):
    df = column(spark, ["C9O9N9", "C2"])
    with pytest.raises(Exception, match="too many heavy"):
        match.heavy_subformulas(df, cap=999, column="x").count()
    assert match.heavy_subformulas(df, cap=1000, column="x").count() == 1003
    assert match.heavy_subformulas(df, cap=999, column="x", excess="skip").count() == 3
