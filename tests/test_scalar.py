import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from peakloom.functions import scalar


def values(spark, rows, kind, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], f"i INT, x {kind}")
    return [r[1] for r in sorted(df.select("i", make(F.col("x"))).collect(), key=lambda r: r[0])]


def test_keys(spark):
    ids = [f"parent {i}" for i in range(40)] + ["", "Ω"]
    want = [int.from_bytes(hashlib.sha256(i.encode()).digest()[:8], "big") for i in ids]
    assert values(spark, ids, "STRING", scalar.shard_of) == [n % 64 for n in want]
    assert values(spark, ids, "STRING", lambda c: scalar.shard_of(c, 7)) == [n % 7 for n in want]
    numbers = [0, 3, 42, 99, 100, 2024]
    assert values(spark, numbers, "INT", lambda c: scalar.spectrum_uid(F.lit("x"), c)) == [f"x:{n:02d}" for n in numbers]
    shards = [0, 9, 63, 12345]
    assert values(spark, shards, "INT", scalar.shard_file) == [f"part-{n:05d}.parquet" for n in shards]
    assert values(spark, [f"/data/fold=train/part-{n:05d}.parquet" for n in shards] + ["part"], "STRING", scalar.shard_of_file) == [*shards, None]


def test_decimals(spark):
    rng = random.Random(6)
    tokens = {}
    for _ in range(60):
        whole, places, power = str(rng.randint(0, 999)), rng.randint(0, 6), rng.choice([None, -2, 0, 1, 3])
        text = whole + ("." + "".join(rng.choice("0123456789") for _ in range(places)) if places else "") + ("" if power is None else f"e{power}")
        tokens[text] = max(places - (power or 0), 0)
    odd = ["x1", "", "1,5", None]
    assert values(spark, [*tokens, *odd], "STRING", scalar.decimal_places) == [*tokens.values(), None, None, None, None]


def test_tolerance_and_bins(spark):
    rng = random.Random(9)
    cases = [(rng.uniform(20, 1200), rng.randint(0, 6)) for _ in range(50)]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i INT, mz DOUBLE, dp INT")
    got = [r[1] for r in df.select("i", scalar.mass_tolerance("mz", "dp")).orderBy("i").collect()]
    assert got == pytest.approx([mz * 1e-5 if dp < 2 else max(mz * 1e-5, 0.5 * 10.0**-dp) for mz, dp in cases])
    mzs = [rng.uniform(-3, 1600) for _ in range(200)] + [0.0, 1500.0]
    bins = [math.floor(m * (14999 / 1500)) + 1 for m in mzs]
    assert values(spark, mzs, "DOUBLE", scalar.bin_index) == bins
    assert values(spark, mzs, "DOUBLE", lambda c: scalar.in_range(scalar.bin_index(c))) == [0 <= b < 15000 for b in bins]


def test_text(spark):
    df = spark.createDataFrame([("N#N", "N2", "[M]+", 7.5, "QTOF", 28.00615)], "s STRING, f STRING, a STRING, e DOUBLE, i STRING, p DOUBLE")
    line = df.select(scalar.format_row("s", "f", "a", "e", "i", "p")).first()[0]
    names = ("SMILES", "formula", "adduct", "collision_energy", "instrument", "precursor_mz")
    assert line == " | ".join(f"{n}={v}" for n, v in zip(names, ("N#N", "N2", "[M]+", "7.50", "QTOF", f"{28.00615:.4f}")))
    assert values(spark, [None, "", "  ", "NaN", " x "], "STRING", scalar.text_or_na) == ["NA"] * 4 + ["x"]
    numbers = {"0.125": "0.12", "2.675": "2.67", "0.375": "0.38", "1e3": "1000.00", "inf": "NA", "nan": "NA", "abc": "NA", None: "NA"}
    assert values(spark, list(numbers), "STRING", lambda c: scalar.number_or_na(c, 2)) == list(numbers.values())
    lists = {"[10, 20.0]": ["10", "20.0"], "['30 eV', 1e2]": ["30 eV", "100.0"], "['1e2', '22,5 V']": ["1e2", "22,5 V"], "[]": [], "10": None, None: None}
    assert values(spark, list(lists), "STRING", scalar.literal_list) == list(lists.values())


def test_buckets(spark):
    assert values(spark, [0.0, 199.9, 200.0, 600.0, None], "DOUBLE", scalar.mass_bucket) == ["[0,200)", "[0,200)", "[200,300)", ">=600", None]
    assert values(spark, [-1.0, 5.0, 10.0], "DOUBLE", lambda c: scalar.bucket_label(c, (0, 10))) == ["[-inf,0)", "[0,10)", "[10,inf)"]


def test_losses(spark):
    xs = [-800.0, -2.0, 0.0, 0.5, 3.0, 800.0]
    assert values(spark, xs, "DOUBLE", scalar.softplus) == pytest.approx([0.0, math.log1p(math.exp(-2)), math.log(2),
        math.log1p(math.exp(0.5)), math.log1p(math.exp(3)), 800.0])
    assert values(spark, xs, "DOUBLE", lambda c: scalar.bce_with_logits(c, F.lit(1.0)))[:2] == pytest.approx([800.0, math.log1p(math.exp(2))])
    assert values(spark, [0.5, -3.0], "DOUBLE", scalar.huber) == pytest.approx([0.125, 2.5])
    assert values(spark, [1.0, 0.0], "DOUBLE", lambda c: scalar.safe_ratio(F.lit(1.0), c)) == [1.0, None]
    steps = values(spark, [0, 49, 50, 1000, 5000], "INT", lambda c: scalar.rate_factor(c, 50, 1000, 0.1))
    assert steps == pytest.approx([0.02, 1.0, 1.0, 0.1, 0.1])
    assert values(spark, [0, 100, 300], "INT", lambda c: scalar.decayed_weight(c, 0.3, 100, 0.5, 200)) == pytest.approx([0.3, 0.3, 0.15])
    with pytest.raises(ValueError):
        scalar.observation_in_space("y", "other")
