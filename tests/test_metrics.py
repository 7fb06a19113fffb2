import math
import random
import re

import pytest
from pyspark.sql import functions as F

from peakloom.functions import scalar
from peakloom.functions.elements import MASSES, PROTON_MASS
from peakloom.operators import analysis, metrics

FULL = """spectrum_uid STRING, fold STRING, formula STRING, adduct STRING, instrument STRING, mzs ARRAY<DOUBLE>, intensities ARRAY<FLOAT>, mz_decimal_places ARRAY<TINYINT>, supervision_mask ARRAY<BOOLEAN>,
supervision_rank ARRAY<INT>, candidate_neutral_formula ARRAY<STRING>, candidate_ion_state ARRAY<STRING>, candidate_theoretical_mz ARRAY<DOUBLE>, edge_peak_index ARRAY<INT>, edge_candidate_index ARRAY<INT>, edge_error_ppm ARRAY<FLOAT>"""
MZ, Y = [41.0141, 57.0335, 74.0237, 99.0441, 130.0499], [64.0, 25.0, 4.0, 9.0, 1.0]
FORMULAS = ["C2HO", "C3H5O", "C3H6S", "C5H7O2"]


@pytest.fixture(scope="module")
def oracle_row(spark):
    row = ("u", "valid", "C6H10O3S", "[M+H]+", "q", MZ, Y, [4] * 5, [True] * 3 + [False] * 2, [0, 1, 2, -1, -1], FORMULAS,
        ["protonated"] * 4, [0.0] * 4, [0, 1, 2, 3], [0, 1, 2, 3], [0.0] * 4)
    empty = ("none", "train", "C1", "[M+H]+", None, [], [], [], [], [], [], [], [], [], [], [])
    return spark.createDataFrame([row, empty], FULL)


def dense(peaks, pool):
    bins = {}
    for mz, y in peaks:
        b = math.floor(mz * (14999 / 1500)) + 1
        if 0 <= b < 15000:
            bins[b] = pool(bins.get(b, 0.0), y)
    return bins


def brute_cosine(predicted, observed, k, power):
    p = dense(predicted, lambda a, b: a + b)
    top = max(p.values(), default=0.0)
    p = {b: v / top for b, v in p.items() if top > 0 and v / top >= 1e-5}
    p = dict(sorted(p.items(), key=lambda x: (-x[1], x[0]))[:k])
    o = dense([(m, max(y, 0.0) ** power) for m, y in observed], max)
    norm = math.sqrt(sum(v * v for v in p.values())) * math.sqrt(sum(v * v for v in o.values()))
    return sum(v * o.get(b, 0.0) for b, v in p.items()) / norm if norm else 0.0


def test_scores_against_brute_force(spark):
    rng = random.Random(5)
    observed, predicted = {}, {}
    for u in range(12):
        observed[f"u{u}"] = [(rng.uniform(-1, 120), rng.choice([0.0, rng.uniform(0, 100)])) for _ in range(rng.choice([0, 5, 60]))]
        predicted[f"u{u}"] = [(rng.choice([rng.uniform(0, 120), 1e9, -5.0, 50.0]), rng.choice([0.0, 1e-9,
            rng.random()])) for _ in range(rng.choice([0, 3, 40]))]
    o = spark.createDataFrame([(u, m, y) for u, ps in observed.items() for m, y in ps], "spectrum_uid STRING, mz DOUBLE, y DOUBLE")
    p = spark.createDataFrame([(u, m, w) for u, ps in predicted.items() for m, w in ps], "spectrum_uid STRING, mz DOUBLE, weight DOUBLE")
    spine = spark.createDataFrame([(u,) for u in observed], "spectrum_uid STRING")
    scored = metrics.score_predictions(p, o, spine, ks=(5, 20))
    for r in scored.collect():
        u = r.spectrum_uid
        for k in (5, 20):
            assert r[f"cos_at_{k}_canonical_sqrt"] == pytest.approx(brute_cosine(predicted[u], observed[u], k, 0.5))
            assert r[f"cos_at_{k}_legacy_raw"] == pytest.approx(brute_cosine(predicted[u], observed[u], k, 1.0))
        inside = sum(0 <= math.floor(m * (14999 / 1500)) + 1 < 15000 for m, _ in predicted[u])
        assert (r.predicted_peaks, r.out_of_range) == (len(predicted[u]), len(predicted[u]) - inside)
        assert r.collisions == max(0, inside - r.predicted_bins) and r.zero_prediction == (r.predicted_bins == 0)
    assert metrics.summarise_scores(scored, ks=(5, 20)).first().spectra == 12


def test_bins(spark):
    df = spark.createDataFrame([("u", 100.0, 1.0), ("u", 100.001, 7.0), ("u", 100.002, 3.0), ("u", 1e9, 5.0), ("u", -5.0, 5.0)],
        "k STRING, mz DOUBLE, y DOUBLE")
    assert [r.v for r in metrics.bin_observation(df, ["k"]).collect()] == [7.0] and [r.v for r in metrics.sum_bins(df, ["k"]).collect()] == [11.0]
    assert metrics.bin_prediction(df.withColumn("y", F.lit(0.0)), ["k"]).count() == 0
    tied = spark.createDataFrame([("u", b, 1.0) for b in (5, 3, 4)], "k STRING, bin INT, v DOUBLE")
    assert {r.bin for r in metrics.top_bins(tied, ["k"], 2).collect()} == {3, 4}


def oracle_cosine(peaks, of_observation, of_weight):
    """peaks: (observed m/z, intensity) and (m/z, weight) of the oracle, whose bins all differ."""
    observed, predicted = peaks
    o = {math.floor(m * (14999 / 1500)): y**of_observation for m, y in observed}
    p = {math.floor(m * (14999 / 1500)): w**of_weight for m, w in predicted}
    dot = sum(w * o.get(b, 0.0) for b, w in p.items())
    return dot / math.sqrt(sum(x * x for x in o.values()) * sum(x * x for x in p.values()))


def test_spaces_and_oracles(spark, oracle_row):
    rendered = [sum(int(n or 1) * MASSES[s] for s, n in re.findall("([A-Z])([0-9]*)", f)) + PROTON_MASS for f in FORMULAS]
    roots = [math.sqrt(y) for y in Y]
    lists = {
        "peak_copy": list(zip(MZ, roots)), "support_mask": list(zip(MZ[:4], roots)), "formula_rendered": list(zip(rendered, roots)),
        "slot_capacity": list(zip(rendered[:3], roots)),
    }
    got = {r.oracle: r for r in metrics.oracle_ceilings(oracle_row).collect()}
    assert set(got) == set(lists)
    for name, own in lists.items():
        for space, of_observation, of_weight in scalar.FOUR_SPACES:
            assert got[name][f"cos_at_100_{space}"] == pytest.approx(oracle_cosine((list(zip(MZ, Y)), own), of_observation, of_weight)), (name, space)
    assert got["peak_copy"].cos_at_100_canonical_sqrt == pytest.approx(1.0) and got["peak_copy"].cos_at_100_raw_via_squared_prediction == pytest.approx(1.0)
    one = metrics.oracle_ceilings(oracle_row, (1,)).where("oracle = 'peak_copy'").first()
    assert one.cos_at_1_legacy_raw == pytest.approx(max(Y) / math.sqrt(sum(y * y for y in Y)))
    assert {r.peak_index: r.rendered for r in metrics.rendered_peaks(oracle_row).collect()} == pytest.approx(dict(enumerate([*rendered, None])))
    energy = sum(y * y for y in Y)
    assert [r.support_cosine for r in metrics.support_oracle(oracle_row).collect()] == [pytest.approx(math.sqrt(1 - Y[4] ** 2 / energy))]


def test_audits(spark, oracle_row):
    block = analysis.peak_block(analysis.peak_support(oracle_row)).first()
    assert (block.peaks, block.supported_peaks, block.zero_fraction) == (5, 4, 0.2) and block.intensity_coverage == pytest.approx(sum(Y[:4]) / sum(Y))
    strata = {(r.dimension, r.label): r for r in analysis.strata_by_spectrum(oracle_row).collect()}
    assert strata[("all", "all")].spectra == 2 and strata[("instrument", "?")].spectra == 1 and strata[("adduct", "[M+H]+")].spectra == 2
    d = {r.spectrum_uid: r for r in analysis.slot_diagnostics(oracle_row).collect()}
    assert (d["u"].supervised, d["u"].edges, d["u"].reused, d["u"].kept_l1, d["none"].peaks) == (3, 4, 0, sum(Y[:3]), 0)
    s = analysis.summarise_slots(analysis.slot_diagnostics(oracle_row)).first()
    assert (s.spectra, s.zero_energy) == (2, 1) and s.l1_pooled == pytest.approx(sum(Y[:3]) / sum(Y)) and s.l1_mean == pytest.approx(sum(Y[:3]) / sum(Y) / 2)
    z = analysis.zero_targets(oracle_row).first()
    assert (z.rows, z.zero_target_rows, z.zero_target_peaks, z.rows_left) == (2, 1, 0, 1)
    c = {r.spectrum_uid: r for r in analysis.cost_table(oracle_row).collect()}
    assert (c["u"].targets, c["u"].linked, c["u"].elements, c["u"].element_steps) == (3, 3, 4, 12) and c["none"].targets == 0
    assert analysis.covered_intensity(oracle_row, spark.createDataFrame([("u", FORMULAS[0], "protonated")],
        "spectrum_uid STRING, formula STRING, ion_state STRING")).first().covered == Y[0]
