import hashlib
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from peakloom.operators import verify
from peakloom.sources import ms, sink, tables
from peakloom.streaming import ingest

def written(blocks, meta=("remark one", "number 2")):
    """A record of metadata lines and blocks of (energy, peak lines) as text."""
    lines = [f"{'>#'[i % 2]}{m}" for i, m in enumerate(meta)] + [""]
    for energy, peaks in blocks:
        lines += [f">collision {energy}", *peaks, ""]
    return "\n".join(lines)


def drawn(rng, n):
    """n peaks as (m/z text, intensity text) with a known number of decimals each, in no order."""
    return [(f"{rng.uniform(20, 900):.{rng.randrange(5)}f}", f"{rng.choice([0.0, rng.uniform(0, 9999)]):.3f}") for _ in range(n)]


RECORD = written([(7.5, ["41.25 3", "88.0 0"]), ("12", ["63.125 0.5"])])
GOOD_LINE = ("77.031", "15.5")
#: What breaks a peak line or a block line, each made from sound parts.
FAULTS = [
    GOOD_LINE[0], " ".join(GOOD_LINE) + " 4", "m/z " + GOOD_LINE[1], GOOD_LINE[0] + " high", *[f"{bad} {GOOD_LINE[1]}" for bad in ("NaN", "-inf", "-" + GOOD_LINE[0], "0", "0.000", "7,5", "٣.٥")],
    *[f"{GOOD_LINE[0]} {bad}" for bad in ("nan", "Infinity", "-" + GOOD_LINE[1], "1e999", "0x1")], ">collision", ">collision low", ">collision 3 4", ">collision inf", "#remark after the block",
]


def parse(spark, contents, expected=None):
    df = spark.createDataFrame([(f"s{i}", c, e) for i, (c, e) in enumerate(zip(contents, expected or [None] * len(contents)))],
        "spec STRING, content STRING, expected STRING")
    return sorted(ms.parse_records(df, "expected" if expected else None).collect(), key=lambda r: (r.spec, r.block or 0))


@pytest.mark.parametrize("ends", ["\n", "\r\n", "\r"])
def test_drawn_records(spark, ends):
    rng = random.Random(len(ends))
    records = [[(f"{rng.uniform(1, 90):.{rng.randrange(3)}f}", drawn(rng, rng.choice([0, 1, 7]))) for _ in range(rng.randint(1, 4))] for _ in range(6)]
    texts = [written([(e, [f"{m}{rng.choice([' ', '   ', chr(9)])}{y}" for m, y in peaks]) for e, peaks in r]).replace("\n", ends) for r in records]
    rows = parse(spark, texts)
    want = [(f"s{i}", b, e, peaks) for i, r in enumerate(records) for b, (e, peaks) in enumerate(r)]
    assert len(rows) == len(want)
    for row, (spec, block, energy, peaks) in zip(rows, want):
        assert (row.spec, row.block, row.error, row.collision_energy_raw, row.collision_energy) == (spec, block, None, energy, float(energy))
        assert row.mzs == [float(m) for m, _ in peaks] and row.intensities == pytest.approx([float(y) for _, y in peaks])
        assert row.mz_decimal_places == [len(m.partition(".")[2]) for m, _ in peaks]


def test_faults(spark):
    texts = [written([(5, [" ".join(GOOD_LINE), line])]) for line in FAULTS] + [" ".join(GOOD_LINE) + "\n" + RECORD, None]
    got = parse(spark, texts)
    assert len(got) == len(texts) and all(r.error and r.mzs is None for r in got)
    assert {r.error for r in got if r.spec == f"s{len(FAULTS) + 1}"} == {"missing"}


def test_records_without_blocks_and_energies_of_the_label(spark):
    assert parse(spark, [written([]), ""]) == []
    same, other = ["[7.5, 12]", "[7.50, 12.0]"], ["[12, 7.5]", "[7.5]", "[7.5, 12, 12]", "[7.5, 12.5]", "[]"]
    got = parse(spark, [RECORD] * 7, same + other)
    assert {r.spec for r in got if r.error is None} == {"s0", "s1"} and sum(r.error is not None for r in got) == len(other)


def test_build_publish_and_read(spark, tmp_path):
    for name in ("a", "b", "bad"):
        (tmp_path / "ms").mkdir(exist_ok=True)
        (tmp_path / "ms" / f"{name}.ms").write_text(RECORD if name != "bad" else RECORD + "oops\n")
    header = "\t".join(tables.LABEL_COLUMNS)
    (tmp_path / "labels.tsv").write_text(header + "\n" + "".join(f"{s}\t47.1\t[7.5, 12]\tCCO\tC2H6O\tKEY{s}\t[M+H]+\t\"Orbitrap\n" for s in ("a", "b", "bad")))
    (tmp_path / "split.tsv").write_text("spec\tFold_0\na\ttrain\nb\tval\nbad\ttrain\nlost\ttest\n")
    labels = tables.labels_to_output(tables.read_tsv(spark, str(tmp_path / "labels.tsv"), tables.LABEL_COLUMNS))
    splits = tables.load_splits(tables.read_tsv(spark, str(tmp_path / "split.tsv"), ("spec", "Fold_0")), fold="Fold_0")
    assert [r.spec for r in tables.missing_labels(splits, labels).collect()] == ["lost"]
    built = ms.build_spectra(splits, labels, ms.read_records(spark, str(tmp_path / "ms")), shards=4).cache()
    assert {r.parent_spec: r.error for r in built.where("error IS NOT NULL").collect()} == {"bad": "peak line needs two fields", "lost": "no complete label"}
    good = built.where("error IS NULL").drop("error")
    assert {r.instrument for r in good.collect()} == {'"Orbitrap'} and {r.fold for r in good.collect()} == {"train", "valid"}
    out = str(tmp_path / "out")
    manifest = sink.publish(good, out, "spectra_v2", 4, checks=verify.spectra_checks, folds=("train", "valid"))
    assert manifest["counts"]["all"] == {"parents": 2, "spectra": 4, "peaks": 6} and manifest["counts"]["train"]["spectra"] == 2
    with pytest.raises(FileExistsError):
        sink.publish(good, out, "spectra_v2", 4)
    sink.publish(good, out, "spectra_v2", 4, overwrite=True)
    assert sorted(os.listdir(tmp_path)) == ["labels.tsv", "ms", "out", "split.tsv"]
    back = sink.read_dataset(spark, out, ("spectrum_uid", "mzs"), fold="train")
    assert {r.spectrum_uid for r in back.collect()} == {"a:00", "a:01"} and "PartitionFilters: [isnotnull(fold" in back._jdf.queryExecution().toString()
    assert verify.unsorted_rows(spark.read.parquet(out), ["parent_spec", "collision_index"], "sorted").first().violations == 0
    with pytest.raises(ValueError):
        sink.read_dataset(spark, out, accept=("other",))
    assert json.load(open(os.path.join(out, sink.MANIFEST)))["schema_version"] == "spectra_v2"
    with pytest.raises(ValueError):
        sink.publish(good.unionByName(good), str(tmp_path / "never"), "spectra_v2", 4, checks=verify.spectra_checks)
    with pytest.raises(ValueError, match="shard_of_parent"):
        sink.publish(good.withColumn("shard", (F.col("shard") + 1) % 4), str(tmp_path / "never"), "spectra_v2", 4, checks=verify.spectra_checks)
    assert not os.path.exists(tmp_path / "never")


def test_splits(spark):
    df = spark.createDataFrame([("a", "train"), ("b", "val"), ("a", "valid"), (None, "test"), ("c", "holdout")], "spec STRING, fold_0 STRING")
    assert {(r.problem, r.spec) for r in tables.split_problems(df).collect()} == {("repeated", "a"), ("missing", None), ("unknown_fold", "c")}
    with pytest.raises(ValueError):
        tables.load_splits(df)
    rows = spark.createDataFrame([(f, 0, f"p{i}", 0) for f in ("train", "valid", "test") for i in range(9)],
        "fold STRING, shard INT, parent_spec STRING, collision_index INT")
    assert {r.fold: r["count"] for r in tables.fold_budget(rows, 7).groupBy("fold").count().collect()} == {"train": 3, "valid": 4}


def test_predictions_and_guards(spark, tmp_path):
    p = spark.createDataFrame([("u",), ("v",)], "spectrum_uid STRING")
    s = spark.createDataFrame([("u", 0.5, False)], "spectrum_uid STRING, cos_at_20_legacy_raw DOUBLE, zero_prediction BOOLEAN")
    got = {r.spectrum_uid: (r.cos_at_20_legacy_raw, r.zero_prediction, r.fold) for r in sink.prediction_table(p, s, "valid").collect()}
    assert got == {"u": (0.5, False, "valid"), "v": (0.0, True, "valid")}
    with pytest.raises(ValueError):
        sink.prediction_table(p, s, "test")
    with pytest.raises(ValueError):
        sink.conditioning_only(p.withColumn("mzs", F.array()))
    assert sink.conditioning_only(p) is p
    sink.append_jsonl(s, str(tmp_path / "log"))
    sink.append_jsonl(s, str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "x").write_bytes(b"abc")
    digests = sink.file_digests(spark, str(tmp_path / "f"))
    assert digests.first().sha256 == "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad" and sink.tree_digest(digests).first().files == 1


def test_stream_of_records(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for round_no, names in enumerate((("a", "b"), ("c",))):
        for n in names:
            (tmp_path / "in" / f"{n}.ms").write_text(RECORD)
        query = ingest.write_blocks(ingest.stream_blocks(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "state"))
        assert query.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 2 * (2 + round_no)
    assert {r.spectrum_uid for r in spark.read.parquet(str(tmp_path / "out")).collect()} >= {"a:00", "c:01"}


def test_stream_windows(spark, tmp_path):
    rows = spark.sql("""SELECT * FROM VALUES (TIMESTAMP '2024-01-01 00:10:00', 'k', 1.0D), (TIMESTAMP '2024-01-01 00:50:00', 'k', 2.0D),
        (TIMESTAMP '2024-01-01 03:00:00', 'k', 4.0D), (TIMESTAMP '2024-01-01 03:00:00', 'k', 4.0D) AS t(ts, by, v)""")
    rows.write.parquet(str(tmp_path / "in"))
    still = {(r.start.hour, r.n, r.total) for r in ingest.windowed_counts(spark.read.parquet(str(tmp_path / "in")), "ts", "by", "v").collect()}
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    query = ingest.windowed_counts(stream, "ts", "by", "v").writeStream.format("memory").queryName("windows").outputMode("complete").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert {(r.start.hour, r.n, r.total) for r in spark.table("windows").collect()} == still and len(still) == 2
    assert ingest.first_arrivals(rows, ["ts", "by", "v"], "ts").count() == 3


def test_layout_faults_are_seen(spark):
    """Rows in a wrong folder, a wrong shard or out of order are counted, each by its own check."""
    rows = [("train", scalar_shard(p), p, i, f"/d/fold=train/shard={scalar_shard(p)}/x.parquet") for p in ("a", "b", "c") for i in (0, 1)]
    df = lambda rs: spark.createDataFrame(rs, "fold STRING, shard INT, parent_spec STRING, collision_index INT, file STRING").coalesce(1)
    found = lambda rs: {r.check_name: r.violations for r in verify.layout_checks(df(rs), 8, file=F.col("file")).collect() if r.violations}
    ordered = sorted(rows, key=lambda r: (r[1], r[2], r[3]))
    assert found(ordered) == {}
    f, shard, p, i, file = ordered[0]
    assert found([("valid", shard, p, i, file), *ordered[1:]]) == {"fold_is_folder": 1}
    assert found([(f, (shard + 1) % 8, p, i, file), *ordered[1:]]) == {"shard_is_folder": 1, "shard_of_parent": 1}
    assert found([ordered[1], ordered[0], *ordered[2:]]) == {"rows_in_order": 1}
    assert found([(f, None, p, i, None), *ordered[1:]]) == {"fold_is_folder": 1, "shard_is_folder": 1, "shard_of_parent": 1, "shard_in_range": 1}


def scalar_shard(parent):
    return int.from_bytes(hashlib.sha256(parent.encode()).digest()[:8], "big") % 8
