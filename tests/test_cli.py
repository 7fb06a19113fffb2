import hashlib

import pytest
from pyspark.sql import functions as F

from peakloom.__main__ import main
from peakloom.functions import chem
from peakloom.functions.elements import MASSES, PROTON_MASS
from peakloom.functions.register import register_all
from peakloom.sources import tables

FORMULA = "C5H8O2"
FRAGMENTS = ({"C": 2, "H": 3, "O": 1}, {"C": 3, "H": 5}, {"C": 4, "H": 7, "O": 1}, {"C": 5, "H": 8, "O": 2})
IONS = [sum(MASSES[s] * n for s, n in f.items()) + PROTON_MASS for f in FRAGMENTS]
#: Ions of subformulas with rising intensity, and one peak between the second and third that is none.
PEAKS = "".join(f"{mz:.4f} {10 * (i + 1)}\n" for i, mz in enumerate([*IONS[:2], (IONS[1] + IONS[2]) / 2 + 0.3, *IONS[2:]]))


def test_from_text_to_scores(spark, tmp_path):
    (tmp_path / "ms").mkdir()
    for name in ("a", "b", "c"):
        (tmp_path / "ms" / f"{name}.ms").write_text(f">compound x\n>collision 10\n{PEAKS}>collision 20\n{PEAKS}")
    (tmp_path / "labels.tsv").write_text("\t".join(tables.LABEL_COLUMNS) + "\n" + "".join(f"{s}\t101.06\t[10, 20]\tC\t{FORMULA}\tKEY{s}\t[M+H]+\tOrbitrap\n" for s in "abc"))
    (tmp_path / "split.tsv").write_text("spec\tFold_0\na\ttrain\nb\tvalid\nc\ttest\n")
    at = lambda n: str(tmp_path / n)
    assert main(["build-spectra", "--labels", at("labels.tsv"), "--split", at("split.tsv"), "--records", at("ms"), "--out", at("spectra"),
        "--num-shards", "4"], spark) == 0
    assert sorted(p.name for p in (tmp_path / "spectra" / "fold=valid").iterdir() if p.is_dir()) == [f"shard={n}" for n in range(4)]
    assert main(["verify", "--kind", "spectra", "--data", at("spectra")], spark) == 0
    assert main(["build-supervision", "--spectra", at("spectra"), "--out", at("supervision"), "--num-shards", "4"], spark) == 0
    assert main(["verify", "--kind", "supervision", "--data", at("supervision")], spark) == 0
    rows = spark.read.parquet(at("supervision"))
    assert {r.fold for r in rows.select("fold").distinct().collect()} == {"train", "valid"}
    linked = rows.first().supervision_mask
    assert linked == [True, True, False, True, True] and rows.first().supervision_rank == [3, 2, -1, 1, 0]
    assert main(["audit", "--data", at("supervision"), "--out", at("audit")], spark) == 0
    assert spark.read.json(at("audit") + "/slots").first().supervised_max == 4
    valid = rows.where("fold = 'valid'")
    predicted = valid.select(
        "spectrum_uid", F.col("mzs").alias("predicted_mz"), F.transform("intensities", lambda y: F.sqrt(y.cast("double"))).alias("predicted_intensities"),
        F.array(F.lit("C3H5"), F.lit("C3H6")).alias("predicted_formulas"), F.array(F.lit("protonated"), F.lit("protonated")).alias("predicted_ion_states"),
    )
    predicted.write.parquet(at("predicted"))
    assert main(["evaluate", "--predictions", at("predicted"), "--data", at("supervision"), "--fold", "valid", "--out", at("scores")], spark) == 0
    assert spark.read.json(at("scores") + "/summary").first().cos_at_100_canonical_sqrt_mean == pytest.approx(1.0)
    with pytest.raises(ValueError):
        main(["evaluate", "--predictions", at("predicted"), "--data", at("supervision"), "--fold", "test", "--out", at("never")], spark)
    assert main(["identity-errors", "--predictions", at("predicted"), "--data", at("supervision"), "--out", at("identities")], spark) == 0
    assert {r.category: r.n for r in spark.read.json(at("identities") + "/errors").collect()} == {"hit": 2, "hydrogen_to_2": 2}
    seen = {(r.grp, r.threshold): r.fragment for r in spark.read.json(at("identities") + "/vocabulary").collect()}
    assert (seen["hit", 1], seen["miss", 1], seen["hit", 5]) == (1.0, 0.0, 0.0)
    # Slots that repeat the four linked peaks exactly.
    targets = valid.select("spectrum_uid", F.posexplode("supervision_rank").alias("i", "target"), "mzs", "intensities").where("target >= 0")
    root = F.sqrt(F.get(F.col("intensities"), F.col("i")).cast("double"))
    names = F.array(*[F.lit(chem_text) for chem_text in ("C2H3O", "C3H5", "", "C4H7O", "C5H8O2")])
    slots = targets.select("spectrum_uid", F.col("target").alias("slot"), F.lit(1.0).alias("presence"), root.alias("intensity"),
        F.get(names, F.col("i")).alias("formula"), F.lit("protonated").alias("ion_state"))
    slots.write.parquet(at("slots"))
    targets.select("spectrum_uid", F.col("target").alias("slot"), "target").write.parquet(at("assignment"))
    given = ["--slots", at("slots"), "--assignment", at("assignment"), "--data", at("supervision")]
    assert main(["decompose", *given, "--out", at("parts")], spark) == 0
    part = spark.read.parquet(at("parts") + "/per_spectrum").first()
    assert part.oracle == pytest.approx(part.forced) and part.forced == pytest.approx(part.gated) and part.oracle == pytest.approx(((150 - 30) / 150) ** 0.5)
    assert spark.read.json(at("parts") + "/summary").first().spectra == 2
    assert main(["audit-contract", *given, "--out", at("contract")], spark) == 0
    means = {r.condition: r.cos_at_100_canonical_sqrt for r in spark.read.json(at("contract") + "/counterfactual_means").collect()}
    ceilings = {r.oracle: r.cos_at_100_canonical_sqrt for r in spark.read.json(at("contract") + "/oracle_means").collect()}
    assert means["all_predicted"] == pytest.approx(ceilings["slot_capacity"]) and ceilings["peak_copy"] == pytest.approx(1.0)
    assert {r.identities: r.bags for r in spark.read.json(at("contract") + "/bags").collect()} == {1: 8}
    (tmp_path / "ms" / "a.ms").write_text("oops\n")
    assert main(["build-spectra", "--labels", at("labels.tsv"), "--split", at("split.tsv"), "--records", at("ms"), "--out", at("bad"),
        "--num-shards", "4"], spark) == 1


def test_sql_functions(spark):
    register_all(spark, "pl_")
    r = spark.sql("""SELECT pl_shard_of('any') AS s, pl_spectrum_uid('p', 12) AS u, pl_bin_index(250.25D) AS b, pl_mass_tolerance(50D,
        3) AS t, pl_safe_ratio(3D, 4D) AS z, pl_huber(0.25D, 1D) AS h""").first()
    shard = int.from_bytes(hashlib.sha256(b"any").digest()[:8], "big") % 64
    assert (r.s, r.u, r.b, r.t, r.z, r.h) == (shard, "p:12", int(250.25 * 14999 / 1500) + 1, pytest.approx(5e-4), 0.75, 0.03125)


def test_decodable(spark):
    df = spark.createDataFrame([("CH4", "C2H6"), ("CH7", "C2H6"), ("O", "C2H6")], "f STRING, p STRING")
    assert [r[0] for r in df.select(chem.is_decodable(chem.parse_formula("f"), chem.parse_formula("p"))).collect()] == [True, False, False]
