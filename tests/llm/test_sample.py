import hashlib
import random

from peakloom.llm import sample

ITEMS = "item STRING, batch INT"


def brute(rows, rate, salt=sample.SALT):
    first = {}
    for item, batch in rows:
        if item is not None and batch is not None:
            first[item] = min(batch, first.get(item, batch))
    out = set()
    for b in set(first.values()):
        own = sorted((hashlib.md5((salt + i).encode()).hexdigest(), i) for i, x in first.items() if x == b)
        out |= {(i, b) for _, i in own[: -(-len(own) * rate[0] // rate[1])]}
    return out


def test_against_brute_force_and_growth(spark):
    rows = [(f"i{n}", 1 + n % 4 if n % 3 else 1) for n in range(1500)] + [("late", 9), ("late", 2), (None, 1), ("never", None)]
    chosen = set()
    for upto in (1, 2, 3, 4, 9):
        have = [r for r in rows if r[1] is None or r[1] <= upto]
        for partitions, digits in ((1, 4), (7, 1), (3, 2)):
            df = spark.createDataFrame(have * 2, ITEMS).repartition(partitions)
            got = {tuple(r) for r in sample.frozen_bottom_k(df, "item", "batch", (5, 100), cell_digits=digits).collect()}
            assert got == brute(have, (5, 100))
        assert {i for i, _ in chosen} <= {i for i, b in got} | {"late"}  # late moves only if a smaller batch shows up
        chosen = got


def test_rates_and_empty(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], ITEMS)
    assert sample.frozen_bottom_k(df, "item", "batch", (0, 1)).count() == 0
    assert sample.frozen_bottom_k(df, "item", "batch", (1, 1)).count() == 2
    assert sample.frozen_bottom_k(df, "item", "batch", (1, 1000)).count() == 2
    assert sample.frozen_bottom_k(df.limit(0), "item", "batch").count() == 0


def test_rows_of_sampled_items(spark):
    rows = spark.createDataFrame([("p1", "u1"), ("p1", "u2"), ("p1", "u2"), (None, "u3"), ("unlogged", "u4")], "parent_spec STRING, spectrum_uid STRING")
    log = spark.createDataFrame([("p1", 3), ("p1", 2), ("p1", 2), ("only in the log", 2)], "parent_spec STRING, batch_no INT")
    got = {tuple(r) for r in sample.sample_rows(rows, log, rate=(1, 2)).collect()}
    assert got == {("p1", "u1", 2), ("p1", "u2", 2)}


def test_ledger_loses_nothing(spark, tmp_path):
    """Late items, items that vanish and corrected batch numbers: what was chosen stays, sizes are exact, reruns change nothing."""
    ledger = sample.Ledger(spark, str(tmp_path / "ledger"))
    df = lambda rows: spark.createDataFrame(rows, ITEMS).repartition(3)
    step = lambda rows: {tuple(r) for r in sample.frozen_bottom_k(df(rows), "item", "batch", (5, 100), ledger=ledger).collect()}
    rows = [(f"a{n}", 1) for n in range(101)]
    first = step(rows)
    assert first == brute(rows, (5, 100)) and len(first) == 6
    assert step(rows) == first and step(rows[::-1]) == first
    # Nineteen more for the closed batch: nothing is open yet, so they wait.
    late = [(f"late{n}", 1) for n in range(19)]
    assert step(rows + late) == first
    # A new batch opens; one chosen item's batch is corrected to it, another item vanishes from the input.
    moved, gone = (i for i, _ in sorted(first)[:2])
    second_rows = [(i, 2 if i == moved else b) for i, b in rows + late if i != gone] + [(f"b{n}", 2) for n in range(240)]
    second = step(second_rows)
    assert first <= second and {b for _, b in second - first} == {2}
    # The late ones with a hash below the threshold of their batch take part in the open batch, no others.
    text = lambda i: (hashlib.md5((sample.SALT + i).encode()).hexdigest(), i)
    last = max(text(i) for i, _ in first)
    joined = [(i, 2) for i, _ in late if text(i) <= last] + [(f"b{n}", 2) for n in range(240)]
    assert second - first == brute(joined, (5, 100))
    assert step(second_rows + rows) == second and ledger.epochs() == 2


def test_growth_without_order(spark, tmp_path):
    """Whatever arrives next, the sample before is a subset of the sample after, and the rate holds."""
    rng = random.Random(77)
    ledger = sample.Ledger(spark, str(tmp_path / "ledger"))
    seen, before = [], set()
    for b in range(1, 5):
        seen += [(f"i{len(seen) + n}", b if rng.random() < 0.9 else rng.randint(1, b)) for n in range(300)]
        after = {tuple(r) for r in sample.frozen_bottom_k(spark.createDataFrame(seen, ITEMS), "item", "batch", (10, 100), ledger=ledger).collect()}
        assert before <= after
        before = after
    assert len({i for i, _ in before}) == len(before) and 100 <= len(before) <= 140


def test_crash_between_the_two_parts_is_repaired(spark, tmp_path):
    ledger = sample.Ledger(spark, str(tmp_path / "ledger"))
    rows = spark.createDataFrame([(f"i{n}", 1) for n in range(50)], ITEMS)
    rows.select("item").write.parquet(f"{ledger.path}/chosen/epoch=0")  # chosen was written, closed wasn't
    assert ledger.epochs() == 0 and ledger.chosen() is None
    assert sample.frozen_bottom_k(rows, "item", "batch", (10, 100), ledger=ledger).count() == 5 and ledger.epochs() == 1
