from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from peakloom.operators import batch, compare, verify


@pytest.fixture(scope="module")
def costs(spark):
    rows = [(f"u{i:04d}", 10 + (i * 7) % 90, (i * 13) % 50, (i * i) % 997) for i in range(700)] + [("huge", 5000, 1, 5), ("wide", 1, 900,
        5), ("none", None, None, 1)]
    return spark.createDataFrame(rows, "spectrum_uid STRING, tokens INT, candidates INT, element_steps INT")


def test_budgets(costs):
    planned = batch.plan_batches(costs, max_rows=16, max_tokens=600, max_candidates=200, bucket_rows=64).join(costs, "spectrum_uid").collect()
    assert len(planned) == 703 and len({r.spectrum_uid for r in planned}) == 703
    by = defaultdict(list)
    for r in planned:
        by[r.batch_id].append(r)
    for rows in by.values():
        if rows[0].singleton:
            assert len(rows) == 1
        else:
            assert len(rows) <= 16 and sum(r.tokens or 0 for r in rows) <= 600 and sum(r.candidates or 0 for r in rows) <= 200
    assert {r.spectrum_uid for r in planned if r.singleton} == {"huge", "wide"}
    assert len(by) < 200
    again = batch.plan_batches(costs, max_rows=16, max_tokens=600, max_candidates=200, bucket_rows=64)
    assert {(r.spectrum_uid, r.batch_id) for r in again.collect()} == {(r.spectrum_uid, r.batch_id) for r in planned}
    other = batch.plan_batches(costs, max_rows=16, max_tokens=600, max_candidates=200, bucket_rows=64, epoch=1)
    assert {(r.spectrum_uid, r.batch_id) for r in other.collect()} != {(r.spectrum_uid, r.batch_id) for r in planned}
    assert {r.measure for r in batch.workload(again, costs).collect()} == {"rows", "tokens", "candidates", "element_steps"}


def test_ranks(spark):
    batches = spark.createDataFrame([(f"b{i}",) for i in range(23)], "batch_id STRING")
    plan = batch.split_ranks(batches, world=4, accumulation=2)
    rows = sorted(plan.collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(23)) and [r.rank for r in rows] == [i % 4 for i in range(23)] and [r.dropped for r in rows] == [False] * 16 + [True] * 7
    mine = [r.position for r in rows if not r.dropped and r.rank == 1]
    assert sorted(r.position for r in batch.remaining(plan, 1, 1, 4).collect()) == mine[1:]
    assert batch.split_ranks(batches.limit(0), 4).count() == 0


def test_logs(spark):
    log = spark.createDataFrame([(1, 0.5, 1.0, 10), (2, 0.7, 2.0, 30), (3, 0.7, float("nan"), 10), (3, 0.1, None, 1)],
        "epoch INT, score DOUBLE, loss DOUBLE, n INT")
    assert batch.best_so_far(log, ("score",)).first().epoch == 2
    assert batch.not_finite(log).count() == 2
    assert {r.epoch: r.steps for r in batch.epoch_summary(log).collect()} == {1: 1, 2: 1, 3: 2}
    weights = batch.shares(log.withColumnRenamed("epoch", "step"))
    assert weights.where("step = 3").agg(F.sum("weight")).first()[0] == pytest.approx(1.0)
    twice = spark.createDataFrame([("a", 0), ("a", 1), ("b", 1), ("b", 1)], "spectrum_uid STRING, rank INT")
    assert [r.spectrum_uid for r in batch.ranks_overlap(twice).collect()] == ["a"]


def test_compare(spark):
    a = spark.createDataFrame([("x", [1.0]), ("y", None), ("z", [2.0])], "k STRING, v ARRAY<DOUBLE>")
    b = spark.createDataFrame([("x", [1.0]), ("y", None), ("w", [2.0]), ("v", [0.0])], "k STRING, v ARRAY<DOUBLE>")
    assert {r.status: r.n for r in compare.reconcile(a, b, "k", ["v"]).collect()} == {"equal": 2, "missing": 1, "extra": 2}
    p = spark.createDataFrame([("x", ["C"], ["p"], [1.0]), ("y", ["O"], ["p"], [1.0])],
        "spectrum_uid STRING, predicted_formulas ARRAY<STRING>, predicted_ion_states ARRAY<STRING>, predicted_intensities ARRAY<DOUBLE>")
    q = spark.createDataFrame([("x", ["C"], ["p"], [1.5]), ("y", ["N"], ["p"], [9.0])], p.schema)
    rows = {r.variant: r for r in compare.variants(p, {"same": p, "other": q}).collect()}
    assert (rows["same"].identical, rows["same"].max_difference) == (2, 0.0) and (rows["other"].shared, rows["other"].identical,
        rows["other"].max_difference) == (2, 1, 0.5)
    assert compare.fingerprint(a, ["k", "v"]).first() == compare.fingerprint(a.repartition(5), ["k", "v"]).first()


def test_checks(spark):
    schema = "spectrum_uid STRING, parent_spec STRING, collision_index INT, fold STRING, inchikey STRING, mzs ARRAY<DOUBLE>, intensities ARRAY<FLOAT>, mz_decimal_places ARRAY<TINYINT>"
    good = [("p:00", "p", 0, "train", "K", [1.0], [1.0], [2]), ("p:01", "p", 1, "train", "K", [], [], []), ("q:00", "q", 0, "valid", None, [], [], [])]
    verify.gate(verify.spectra_checks(spark.createDataFrame(good, schema)))
    bad = [*good, good[0], ("q:7", "q", 7, "train", "K", [1.0], [], []), ("r:00", "r", 0, "Test", "K", None, [], [])]
    got = {r.check_name: r.violations for r in verify.spectra_checks(spark.createDataFrame(bad, schema)).collect()}
    assert got == {"parallel_lengths": 2, "fold_domain": 1, "uid_form": 1, "uid_unique": 1, "parent_in_one_fold": 1, "inchikey_in_one_fold": 1}
    with pytest.raises(ValueError, match="parallel_lengths: 2"):
        verify.gate(verify.spectra_checks(spark.createDataFrame(bad, schema)), ignore=("uid_form",))
    counts = spark.createDataFrame([(3, 5)], "spectra BIGINT, peaks BIGINT")
    assert {r.check_name: r.violations for r in verify.manifest_checks(counts, {"spectra": 3,
        "peaks": 7}).collect()} == {"manifest_spectra": 0, "manifest_peaks": 2}
