import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from peakloom.operators import analysis, assign, scores
from peakloom.plans import catalog


def test_log_sum_exp(spark):
    rows = [("a", -1.0), ("a", -2.0), ("a", -3.0), ("b", -2000.0), ("b", -2000.5), ("c", float("-inf")), ("d", 511.9999), ("d", 512.0001), ("d", -5.0)]
    df = spark.createDataFrame(rows, "k STRING, v DOUBLE")
    got = {r.k: r.lse for r in scores.log_sum_exp(df, ["k"], "v").collect()}
    assert got["a"] == pytest.approx(math.log(sum(math.exp(v) for k,
        v in rows if k == "a"))) and got["b"] == pytest.approx(-2000 + math.log(1 + math.exp(-0.5))) and got["c"] == pytest.approx(-1e9)
    assert got["d"] == pytest.approx(512 + math.log(2 * math.cosh(1e-4)))
    for size in (1, 2, 5):
        chunks = []
        for k in "ab":
            own = [v for x, v in rows if x == k]
            for at in range(0, len(own), size):
                part = own[at : at + size]
                chunks.append((k, max(part), sum(math.exp(v - max(part)) for v in part)))
        merged = scores.merge_log_sum_exp(spark.createDataFrame(chunks, "k STRING, m DOUBLE, s DOUBLE"), ["k"])
        assert {r.k: r.lse for r in merged.collect()} == pytest.approx({k: got[k] for k in "ab"})


def test_bags_and_costs_against_brute_force(spark):
    rng = random.Random(21)
    slot_rows, member_rows, target_rows, scored = [], [], [], {}
    for u in ("u", "v"):
        n = 9
        for s in range(4):
            scored[u, s] = [rng.uniform(-8, 0) for _ in range(n)]
            slot_rows.append((u, s, rng.uniform(0, 3)))
        for t in range(3):
            target_rows.append((u, t, rng.random()))
            member_rows += [(u, t, c) for c in rng.sample(range(n), rng.randint(1, 4))]
    member_rows += [member_rows[0], ("w", 0, 1), ("u", 0, 99)]  # a repeated row, a spectrum without scores, a candidate without a score
    table = spark.createDataFrame([(*k, v) for k, v in scored.items()], "uid STRING, slot INT, log_probs ARRAY<DOUBLE>")
    m = spark.createDataFrame(member_rows, "uid STRING, target INT, candidate_index INT")
    bag = lambda u, t: sorted({c for a, b, c in member_rows if (a, b) == (u, t) and c < 9})
    want = {(u, s, t): math.log(sum(math.exp(v[c]) for c in bag(u, t))) for (u, s), v in scored.items() for t in range(3)}
    assert {(r.uid, r.slot, r.target): r.bag_log_prob for r in scores.bag_log_probability(table, m).collect()} == pytest.approx(want)
    slots = spark.createDataFrame(slot_rows, "uid STRING, slot INT, contribution DOUBLE")
    targets = spark.createDataFrame(target_rows, "uid STRING, target INT, t DOUBLE")
    huber = lambda x: x * x / 2 if abs(x) <= 1 else abs(x) - 0.5
    costs = {(u, s, t): -want[u, s, t] + 0.25 * huber(c - y) for u, s, c in slot_rows for v, t, y in target_rows if u == v}
    assert {(r.uid, r.slot, r.target): r.cost for r in scores.matching_costs(table, m, slots, targets).collect()} == pytest.approx(costs)
    pairs = [("u", 0, 0), ("u", 2, 1), ("v", 3, 2)]
    best = {k: max(range(9), key=lambda c: v[c]) for k, v in scored.items()}
    own = spark.createDataFrame([(*k, c) for k, c in best.items()], "uid STRING, slot INT, candidate_index INT")
    found = scores.matched_bags(table, m, spark.createDataFrame(pairs, "uid STRING, slot INT, target INT"), own)
    for r in found.collect():
        assert r.cardinality == len(bag(r.uid, r.target)) and -r.bag_nll == pytest.approx(want[r.uid, r.slot,
            r.target]) and r.bag_mass == pytest.approx(math.exp(-r.bag_nll))
        assert r.argmax_in_bag == (best[r.uid, r.slot] in bag(r.uid, r.target)) and r.best_in_bag == max(scored[r.uid, r.slot][c] for c in bag(r.uid, r.target))
    assert found.count() == 3 and {r.grp: r.pairs for r in scores.identity_metrics(found).collect()}["all"] == 3


def test_presence_and_softmax(spark):
    df = spark.createDataFrame([(0.0, True), (2.0, True), (-1.0, False)], "x DOUBLE, on BOOLEAN")
    r = scores.balanced_bce(df, "x", F.col("on")).first()
    pos, neg = (math.log(2) + math.log1p(math.exp(-2))) / 2, math.log1p(math.exp(-1))
    assert r.presence_loss == pytest.approx((pos + neg) / 2)
    assert scores.balanced_bce(df.where("NOT on"), "x", F.col("on")).first().presence_loss == pytest.approx(neg)
    soft = scores.masked_log_softmax(df.withColumn("k", F.lit(1)), ["k"], "x", "on").collect()
    assert sum(math.exp(r.log_prob) for r in soft) == pytest.approx(1.0) and len(soft) == 2
    total = scores.total_loss(spark.createDataFrame([(1.0, None)], "a DOUBLE, b DOUBLE"), {"a": 2.0, "b": 3.0}).first().total
    assert total == 2.0


def test_cosine_losses(spark):
    peaks = spark.createDataFrame([("u", 0, 0.8, True), ("u", 1, 0.6, False)], "uid STRING, peak_index INT, t DOUBLE, selected BOOLEAN")
    a = spark.createDataFrame([("u", 0, 1.0, 0.5), ("u", 0, 1.0, 0.5)], "uid STRING, peak_index INT, intensity DOUBLE, contribution DOUBLE")
    assert scores.spectrum_cosine_loss(a, peaks).first().loss == pytest.approx(1 - 0.8, abs=1e-6)
    r = scores.cosine_decomposition(peaks, a.limit(1)).first()
    assert (r.oracle, r.forced) == pytest.approx((0.8, 0.8))
    assert scores.spectrum_cosine_loss(a.limit(0), peaks).first().loss == pytest.approx(1.0)


def test_cosine_losses_of_odd_rows_without_a_join(spark, tmp_path):
    """Against the SQL; every exploded side of a join would be shuffled, or broadcast through the driver."""
    duckdb = pytest.importorskip("duckdb")
    rng, nan = random.Random(5), float("nan")
    rows = [
        ("shared", [50.0, 51.0, 52.0], [1.0, 4.0, 9.0], [1, 1, 0], ["CH4"] * 3, ["a"] * 3),  # two peaks of one rank
        ("gaps", [50.0, None, 52.0, 53.0, 54.0], [1.0, 2.0, nan, None, 5.0], [3, 0, 1, 2, None], ["CH4", None, "", "C2"], ["a", "a", "a", "a"]),
        ("long", [50.0, 51.0], [2.0, 3.0], [-1, 0, 1, 2], ["CH4", "C"], ["a", "a", "a"]),
        ("short", [50.0, 51.0, 52.0], [2.0, -3.0, 0.0], [0], ["CH4", "C"], [None, "a"]),
        ("no candidates", [50.0], [2.0], [0], None, None), ("no ranks", [50.0], [2.0], None, ["CH4"], ["a"]), ("dark", [50.0], [0.0], [0], ["CH4"], ["a"]),
        ("no peaks", [], [], [], ["CH4"], ["a"]), ("null lists", None, None, None, None, None), ("all null", [50.0], [None], [0], ["CH4"], ["a"]),
        (None, [50.0, 51.0], [1.0, 2.0], [0, 1], ["CH4", "C"], ["a", "a"]),
    ]
    for k in range(12):  # up to 150 candidates and ranks, of which 64 are slots and targets
        n, c = rng.choice((1, 40, 150)), rng.choice((1, 63, 64, 65, 150))
        ranks = rng.sample(range(n), n) if k % 2 else [rng.randrange(-1, 70) for _ in range(n)]
        rows.append((f"drawn {k}", [50.0 + i for i in range(n)], [rng.uniform(0, 9) for _ in range(n)], ranks,
            ["C" * rng.randint(1, 9) for _ in range(c)], ["a"] * c))
    schema = "spectrum_uid STRING, mzs ARRAY<DOUBLE>, intensities ARRAY<FLOAT>, supervision_rank ARRAY<INT>, candidate_neutral_formula ARRAY<STRING>, candidate_ion_state ARRAY<STRING>"
    df = spark.createDataFrame([*rows, rows[0]], schema)
    none = {"mz_decimal_places": "ARRAY<TINYINT>", "supervision_mask": "ARRAY<BOOLEAN>", "candidate_theoretical_mz": "ARRAY<DOUBLE>", "precursor_mz": "DOUBLE"}
    path = f"{tmp_path}/fragment_supervision_v2.parquet"
    df.select("*", *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()]).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW fragment_supervision_v2 AS SELECT * FROM '{path}/*.parquet'")
    want = {r[0]: r[1:] for r in con.execute(catalog.ORACLE_SQL["spectrum_cosine_loss"]).fetchall()}
    out = catalog.QUERIES["spectrum_cosine_loss"](spark, str(tmp_path))
    got = {r[0]: tuple(r)[1:] for r in out.collect()}
    assert got.keys() == want.keys() and len(got) == len(rows) - 3
    for uid, values in want.items():
        assert got[uid] == pytest.approx(values, abs=2e-6), uid
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan and plan.split("== Initial Plan ==")[-1].count("Exchange hashpartitioning") == 1


def test_prefix_tree(spark):
    df = spark.createDataFrame([("u", [1, 2]), ("u", [1, 3]), ("u", [0, 2])], "uid STRING, counts ARRAY<INT>")
    nodes = {(r.depth, tuple(r.prefix)): (r.children, r.members) for r in scores.prefix_nodes(df).collect()}
    assert nodes == {(0, ()): ([0, 1], 3), (1, (1,)): ([2, 3], 2), (1, (0,)): ([2], 1)}
    child = spark.createDataFrame([("u", 0, [], 0, math.log(0.25)), ("u", 0, [], 1, math.log(0.25)), ("u", 1, [1], 2, 0.0), ("u", 1, [0], 2,
        0.0)], "uid STRING, depth INT, prefix ARRAY<INT>, child INT, log_prob DOUBLE")
    r = scores.prefix_nll(scores.prefix_nodes(df), child).first()
    assert (r.nodes, r.prefix_nll) == (3, pytest.approx(math.log(2) / 3))


def test_assignment_against_brute_force(spark):
    rng = np.random.default_rng(0)
    rows, want = [], {}
    for u in range(15):
        slots, targets = int(rng.integers(1, 7)), 0
        targets = int(rng.integers(1, slots + 1))
        cost = rng.integers(-5, 9, (slots, targets)).astype(float)
        rows += [(f"u{u}", s, t, float(cost[s, t])) for s in range(slots) for t in range(targets)]
        want[f"u{u}"] = min(sum(cost[p[t], t] for t in range(targets)) for p in itertools.permutations(range(slots), targets))
    out = assign.assign(spark.createDataFrame(rows, "uid STRING, slot INT, target INT, cost DOUBLE")).groupBy("uid").agg(F.sum("cost").alias("c"), F.count_distinct("slot").alias("s"), F.count("*").alias("n")).collect()
    assert {r.uid: r.c for r in out} == pytest.approx(want) and all(r.s == r.n for r in out)
    # The cheapest cell first would force the dearest one.
    assert assign.min_cost_assignment(np.array([[3.0, 4, 9], [5, 30, 9], [9, 9, 6]])) == [(0, 1), (1, 0), (2, 2)]
    with pytest.raises(ValueError):
        assign.min_cost_assignment(np.zeros((1, 2)))


def test_matching(spark):
    assert assign.max_matching([(0, 0), (1, 0), (0, 1)]) == [(0, 1), (1, 0)]
    rng = random.Random(1)
    for _ in range(200):
        links = list({(rng.randrange(5), rng.randrange(5)) for _ in range(rng.randrange(9))})
        best = max((k for k in range(len(links) + 1) for s in itertools.combinations(links, k) if len({a for a,
            _ in s}) == k == len({b for _, b in s})), default=0)
        assert len(assign.max_matching(links)) == best
    predicted = spark.createDataFrame([("u", 0, "P", "x"), ("u", 1, "Q", "x"), ("v", 0, "Z", "x")],
        "uid STRING, prediction INT, formula STRING, ion_state STRING")
    bags = spark.createDataFrame([("u", 0, "P", "x"), ("u", 0, "Q", "x"), ("u", 1, "Q", "x"), ("v", 0, "A", "x")],
        "uid STRING, target INT, formula STRING, ion_state STRING")
    targets = spark.createDataFrame([("u", 0, 2.0), ("u", 1, 3.0), ("v", 0, 5.0), ("v", 1, 0.0)], "uid STRING, target INT, y DOUBLE")
    d = assign.fragment_diagnostics(predicted, bags, targets)
    got = {r.uid: r for r in d.collect()}
    assert (got["u"].matched, got["u"].unique_matched, got["u"].ambiguous_matched, got["v"].matched) == (2, 1, 1, 0)
    s = assign.summarise_fragments(d).first()
    assert (s.bag_hit, s.intensity_hit, s.precision) == pytest.approx((2 / 4, 5 / 10, 2 / 3))


def test_identities(spark):
    p = spark.createDataFrame([("u", i, f, "a") for i, f in enumerate(["C2H4", "C2H5", "C2H9", "C3H4", "C4H4", "C9H4", "C2H4"])] + [("u", 7,
        "C2H4", "b"), ("w", 0, "C1", "a")], "uid STRING, slot INT, formula STRING, ion_state STRING")
    c = spark.createDataFrame([("u", 0, "C2H4", "a"), ("u", 1, "C2H6", "a")], "uid STRING, candidate_index INT, formula STRING, ion_state STRING")
    got = {(r.uid, r.slot): r.category for r in analysis.classify_identities(p, c).collect()}
    assert [got[("u", i)] for i in range(8)] == ["hit", "hydrogen_to_2", "hydrogen_above_2", "one_heavy", "two_heavy", "far", "hit",
        "hit"] and got[("w", 0)] == "no_candidates"
    slots = spark.createDataFrame([("u", 0, 0.9, 0.3, "CH4", "protonated"), ("u", 1, 0.8, 0.3, "CH4", "protonated"), ("u", 2, 0.1, 9.0,
        "C2", "protonated"), ("u", 3, 0.9, 1.0, "", "protonated")],
        "uid STRING, slot INT, presence DOUBLE, contribution DOUBLE, formula STRING, ion_state STRING")
    r = analysis.render(slots).collect()
    assert len(r) == 1 and (r[0].weight, r[0].slots, r[0].slot, r[0].place) == (pytest.approx(0.6), 2, 0, 0)


def test_counterfactuals(spark):
    slots = spark.createDataFrame([("u", 0, 0.9, 0.5, "CH4", "protonated"), ("u", 1, 0.1, 0.4, "C2", "protonated"), ("u", 2, 0.9, 0.3, "O",
        "sodiated")], "uid STRING, slot INT, presence DOUBLE, contribution DOUBLE, formula STRING, ion_state STRING")
    oracle = spark.createDataFrame([("u", 0, "CH4", "protonated", 100.0, 0.8), ("u", 1, "C2H2", "sodiated", 9.0, 0.2)],
        "uid STRING, slot INT, o_formula STRING, o_ion STRING, y DOUBLE, t DOUBLE")
    got = {}
    for r in analysis.counterfactuals(slots, oracle).collect():
        for condition in analysis.CONDITIONS:
            if r[condition] is not None:
                got.setdefault(condition, {})[r.slot] = (r.mz, r[condition])
    assert set(got["all_predicted"]) == {0, 2} and set(got["presence_forced_on_matched"]) == {0, 1, 2} and set(got["predicted_identity_oracle_weights"]) == {0}
    assert got["predicted_identity_oracle_weights"][0][1] == 100.0 and got["oracle_identity_sqrt_weights"][1][1] == 0.2
    assert got["oracle_identity_oracle_weights"][1][0] == pytest.approx(26.01565 + 22.98922,
        abs=1e-4) and got["oracle_formula_predicted_ion"][2] == got["all_predicted"][2]


def test_seen_and_agreement(spark):
    predicted = spark.createDataFrame([("hit", "CH4", "H2O"), ("miss", "C9", None)], "grp STRING, formula STRING, loss STRING")
    fragments, losses = spark.createDataFrame([("CH4", 5)], "formula STRING, n BIGINT"), spark.createDataFrame([("H2O", 25)], "loss STRING, n BIGINT")
    got = {(r.grp, r.threshold): (r.fragment, r.loss, r.either) for r in analysis.seen_rates(predicted, fragments, losses).collect()}
    assert got[("hit", 5)] == (1, 1, 1) and got[("hit", 20)] == (0, 1, 1) and got[("hit", 100)] == (0, 0, 0) and got[("miss", 1)] == (0, 0, 0)
    pairs = spark.createDataFrame([("CH4", "C2H4", "C2H6O")], "formula STRING, o_formula STRING, precursor STRING")
    assert {r.position: (r.correct, r.total, r.abs_error) for r in analysis.element_agreement(pairs).collect()} == {0: (1, 1, 0), 1: (0, 1, 1), 2: (1, 1, 0)}


def test_strata_and_diversity(spark):
    pairs = spark.createDataFrame([(1, 0.5, 0.6, 150.0, 3), (3, 1.5, 0.2, 700.0, 40)],
        "cardinality BIGINT, bag_nll DOUBLE, bag_mass DOUBLE, precursor_mz DOUBLE, targets BIGINT")
    got = {r.stratum: r for r in analysis.bag_strata(pairs).collect()}
    assert got["all"].geometric_mass == pytest.approx(math.exp(-1.0)) and got["unique_bag"].pairs == got["cardinality_2_4"].pairs == got["precursor_mz_600_1e+09"].pairs == 1
    vectors = [("u", 0, [1.0, 0.0]), ("u", 1, [1.0, 1.0]), ("u", 2, [0.0, 2.0]), ("v", 0, [1.0, 0.0])]
    got = {r.uid: r.mean_cosine for r in analysis.slot_diversity(spark.createDataFrame(vectors, "uid STRING, slot INT, v ARRAY<DOUBLE>")).collect()}
    assert got["u"] == pytest.approx((math.sqrt(0.5) + math.sqrt(0.5) + 0.0) / 3) and got["v"] is None
