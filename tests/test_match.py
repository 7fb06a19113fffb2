import itertools
import random

import pytest
from pyspark.sql import functions as F

from peakloom.functions.elements import ION_CHANNELS, MASSES
from peakloom.operators import match, spectra, verify
from tests_support import draw, hill, plausible

SCHEMA = "spectrum_uid STRING, fold STRING, formula STRING, adduct STRING, mzs ARRAY<DOUBLE>, intensities ARRAY<FLOAT>, mz_decimal_places ARRAY<TINYINT>"
OFFSET = {n: m for n, _, _, m in ION_CHANNELS}
ADDUCTS = {"[M+H]+": ["protonated"], "[M+Na]+": ["protonated", "sodiated"], "[M+Cl]-": ["deprotonated", "chloride_retained"]}


def row(formula, adduct, mzs, dp, uid="u"):
    return (uid, "train", formula, adduct, mzs, [float(i + 1) for i in range(len(mzs))], dp if isinstance(dp, list) else [dp] * len(mzs))


def subformulas(counts):
    symbols = sorted(counts)
    for ks in itertools.product(*(range(counts[s] + 1) for s in symbols)):
        if any(ks):
            yield {s: k for s, k in zip(symbols, ks) if k}


def mass(counts):
    return sum(MASSES[s] * k for s, k in counts.items())


def spectrum(rng, counts, channels, n=40):
    """Peaks at ions of subformulas, shifted by up to a few tolerances, and some at random, with their decimals."""
    every = [mass(c) for c in subformulas(counts)]
    dps = [rng.choice([0, 1, 2, 3, 4]) for _ in range(n)]
    mzs = [round(max(1.0, rng.choice(every) + OFFSET[rng.choice(channels)]), d) + rng.choice([0.0, 0.0,
        2e-3]) if rng.random() < 0.8 else rng.uniform(10, 250) for d in dps]
    return mzs, dps


def brute(counts, channels, mzs, dps, valence=True, ppm=10.0):
    out = set()
    for sub in subformulas(counts):
        if valence and not plausible(sub):
            continue
        for (i, mz), channel in itertools.product(enumerate(mzs), channels):
            tolerance = mz * ppm * 1e-6 if dps[i] < 2 else max(mz * ppm * 1e-6, 0.5 * 10.0 ** -dps[i])
            theo = mass(sub) + OFFSET[channel]
            if abs(mz - theo) <= tolerance + 1e-9:
                out.add((i, channel, sub.get("H", 0), round(theo, 6)))
    return out


def edges(df, **options):
    return {(r.peak_index, r.channel, r.h, round(r.theo_mz, 6)) for r in match.match_edges(df, **options).collect()}


@pytest.mark.parametrize("width", [0.003, 0.01, 0.4, 3.0])
@pytest.mark.parametrize("adduct", list(ADDUCTS))
def test_edges_against_brute_force(spark, width, adduct):
    rng = random.Random(len(adduct))
    text, counts = "C7H13NO3S", {"C": 7, "H": 13, "N": 1, "O": 3, "S": 1}
    mzs, dps = spectrum(rng, counts, ADDUCTS[adduct])
    df = spark.createDataFrame([row(text, adduct, mzs, dps)], SCHEMA)
    for valence in (True, False):
        want = brute(counts, ADDUCTS[adduct], mzs, dps, valence)
        assert edges(df, width=width, valence=valence) == want and want


def test_wide_tolerance_takes_several_hydrogens(spark):
    counts = {"C": 2, "H": 6, "O": 1}
    df = spark.createDataFrame([row("C2H6O", "[M+H]+", [20.0, 31.5, 45.0], 4)], SCHEMA)
    assert edges(df, ppm=60_000.0) == brute(counts, ["protonated"], [20.0, 31.5, 45.0], [4] * 3, ppm=60_000.0)


def test_supervision_against_brute_force(spark):
    rng = random.Random(41)
    rows, want = [], {}
    for u in range(6):
        text, counts = draw(rng, ("C", "H", "O", "N"), 6)
        mzs, dps = spectrum(rng, counts, ["protonated"], 12)
        rows.append(row(text, "[M+H]+", mzs, dps, f"u{u}"))
        hits = {}
        for sub in filter(plausible, subformulas(counts)):
            theo = mass(sub) + OFFSET["protonated"]
            peaks = [i for i, mz in enumerate(mzs) if abs(mz - theo) <= (mz * 1e-5 if dps[i] < 2 else max(mz * 1e-5, 0.5 * 10.0 ** -dps[i])) + 1e-9]
            if peaks:
                hits[hill(sub)] = set(peaks)
        want[f"u{u}"] = hits
    built = match.build_supervision(spark.createDataFrame(rows, SCHEMA))
    verify.gate(verify.supervision_checks(built))
    for r in built.collect():
        got = {f: {p for p, c in zip(r.edge_peak_index, r.edge_candidate_index) if c == i} for i, f in enumerate(r.candidate_neutral_formula)}
        assert got == want[r.spectrum_uid]
        linked = set().union(*got.values()) if got else set()
        assert r.supervision_mask == [i in linked and d >= 2 for i, d in enumerate(r.mz_decimal_places)]
        order = sorted((i for i, on in enumerate(r.supervision_mask) if on), key=lambda i: (-r.intensities[i], r.mzs[i], i))
        assert r.supervision_rank == [order.index(i) if i in order else -1 for i in range(len(r.mzs))]


def test_metals_and_dirty_rows(spark):
    """Ordinary metals have candidates; what can't be matched is counted by reason and leaves the others alone."""
    silver = MASSES["Ag"] + 4 * MASSES["C"] + 2 * MASSES["H"] + OFFSET["protonated"]
    rows = [
        row("C4H4Ag", "[M+H]+", [silver], 4, "silver"), row("C10H20Ge", "[M+H]+", [MASSES["Ge"] + OFFSET["protonated"]], 4, "germanium"),
        row("C99999999999H2", "[M+H]+", [100.0], 4, "huge"), row("C6O", "[M+2H]2+", [100.0], 4, "double"), row("bad", "[M+H]+", [100.0], 4, "bad"),
        row(None, None, [100.0], 4, "null"), row("C300N300O300", "[M+H]+", [100.0], 4, "many"), row("CH4", "[M+H]+", [], 4, "no peaks"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    built = {r.spectrum_uid: r.candidate_neutral_formula for r in match.build_supervision(df, excess="skip").collect()}
    assert built.pop("silver") == ["C4H2Ag"] and built.pop("germanium") == ["Ge"] and set(map(tuple, built.values())) == {()}
    reasons = {r.reason: (r.spectra, r.formulas) for r in match.problems(df).collect()}
    assert reasons == {"count_out_of_range": (1, 1), "not_a_formula": (2, 2), "unsupported_adduct": (1, 1), "too_many_subformulas": (1, 1)}
    assert match.problems(df.limit(0)).count() == 0 and match.match_edges(df.limit(0)).count() == 0


def test_caps(spark):
    df = spark.createDataFrame([row("C6H12O6", "[M+H]+", [90.0, 5.0], 4)], SCHEMA)
    with pytest.raises(Exception, match="too many candidates"):
        match.match_edges(df, ppm=50_000.0, peak_cap=3).count()
    assert match.match_edges(df, ppm=50_000.0, peak_cap=3, excess="skip").count() == 0
    assert [(r.peak_index, r.raw > 3) for r in match.crowded_peaks(df, ppm=50_000.0, peak_cap=3).collect()] == [(0, True)]


def test_interval_join(spark):
    rng = random.Random(3)
    probe = [(i, x := rng.uniform(-5, 5), x + rng.choice([0.0, 0.01, 2.0])) for i in range(80)]
    build = [(j, round(rng.uniform(-5, 5), 2)) for j in range(80)]
    want = {(i, j) for i, lo, hi in probe for j, v in build if lo <= v <= hi}
    p, b = spark.createDataFrame(probe, "i INT, lo DOUBLE, hi DOUBLE"), spark.createDataFrame(build, "j INT, v DOUBLE")
    for width in (0.03, 1.0, 50.0):
        assert {(r.i, r.j) for r in match.interval_join(p, b, "lo", "hi", "v", width=width).collect()} == want


def test_rank_targets_and_mask(spark):
    rng = random.Random(12)
    cases = []
    for i in range(40):
        n = rng.choice([0, 1, 5, 30])
        ys = [rng.choice([None, float("nan"), 1.0, 2.0, 7.0]) for _ in range(n)]
        cases.append((i, [rng.choice([50.0, 60.0, 70.0]) for _ in range(n)], ys, [rng.random() < 0.7 for _ in range(n)],
            [rng.randrange(n) for _ in range(n // 2)], [rng.choice([1, 2, 4]) for _ in range(n)]))
    df = spark.createDataFrame(cases, "i INT, m ARRAY<DOUBLE>, y ARRAY<FLOAT>, mask ARRAY<BOOLEAN>, e ARRAY<INT>, dp ARRAY<TINYINT>")
    rank = spectra.supervision_rank(F.col("m"), F.col("y"), F.col("mask"))
    rows = df.select("i", rank.alias("r"), spectra.targets(rank, 3).alias("t"), spectra.linked_mask(F.col("e"), F.col("dp")).alias("l")).orderBy("i").collect()
    for (_, ms, ys, on, e, dp), r in zip(cases, rows):
        last = lambda i: (1, 0.0) if ys[i] is None or ys[i] != ys[i] else (0, -ys[i])
        order = sorted((i for i, x in enumerate(on) if x), key=lambda i: (*last(i), ms[i], i))
        assert r.r == [order.index(i) if i in order else -1 for i in range(len(ms))] and r.t == order[:3]
        assert r.l == [i in e and d >= 2 for i, d in enumerate(dp)]


def test_nest_round_trip(spark):
    df = spark.createDataFrame([row("C1", "[M]+", [3.0, 1.0, 2.0], 4)], SCHEMA)
    back = spectra.nest(spectra.peaks(df), "spectrum_uid", ["peak_index"], {"mz": "mzs", "y": "intensities"}).first()
    assert back.mzs == [3.0, 1.0, 2.0] and back.intensities == [1.0, 2.0, 3.0]
