"""Command line: build, verify, audit and evaluate datasets.

    python -m peakloom build-spectra --labels L.tsv --split S.tsv --records DIR --out OUT [--num-shards N] [--limit-parents N] [--overwrite]
    python -m peakloom build-supervision --spectra DIR --out OUT [--ppm P] [--heavy-cap N] [--peak-cap N] [--limit-spectra N] [--overwrite]
    python -m peakloom verify --kind spectra|supervision --data DIR
    python -m peakloom audit --data DIR --out OUT
    python -m peakloom evaluate --predictions P --data DIR --fold F --out OUT
    python -m peakloom identity-errors --predictions P --data DIR [--fold F] --out OUT [--sections errors,valence,vocabulary]
    python -m peakloom decompose --slots S --assignment A --data DIR [--fold F] --out OUT
    python -m peakloom audit-contract --slots S --assignment A --data DIR [--fold F] --out OUT [--sections oracles,counterfactual,bags]

predictions: (spectrum_uid, predicted_formulas, predicted_ion_states, predicted_mz, predicted_intensities); slots: (spectrum_uid, slot,
presence, intensity, formula, ion_state); assignment: (spectrum_uid, slot, target). Each is a Parquet table.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import chem, scalar
from peakloom.operators import analysis, match, metrics, quantiles, scores, spectra, verify
from peakloom.plans import views
from peakloom.session import cut
from peakloom.sources import ms, sink, tables

SUPERVISION_INPUTS = ["spectrum_uid", "parent_spec", "fold", "shard", "collision_index", "collision_energy", "smiles", "formula",
    "inchikey", "adduct", "instrument", "precursor_mz", "mzs", "intensities", "mz_decimal_places"]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="peakloom")
    commands = top.add_subparsers(dest="command", required=True)
    build = commands.add_parser("build-spectra")
    for name in ("--labels", "--split", "--records", "--out"):
        build.add_argument(name, required=True)
    build.add_argument("--num-shards", type=int, default=scalar.SHARDS)
    build.add_argument("--limit-parents", type=int)
    build.add_argument("--overwrite", action="store_true")
    supervise = commands.add_parser("build-supervision")
    supervise.add_argument("--spectra", required=True)
    supervise.add_argument("--out", required=True)
    supervise.add_argument("--num-shards", type=int, default=scalar.SHARDS)
    supervise.add_argument("--ppm", type=float, default=scalar.PPM)
    supervise.add_argument("--heavy-cap", type=int, default=match.HEAVY_CAP)
    supervise.add_argument("--peak-cap", type=int, default=match.PEAK_CAP)
    supervise.add_argument("--limit-spectra", type=int)
    supervise.add_argument("--overwrite", action="store_true")
    check = commands.add_parser("verify")
    check.add_argument("--kind", choices=("spectra", "supervision"), required=True)
    check.add_argument("--data", required=True)
    audit = commands.add_parser("audit")
    audit.add_argument("--data", required=True)
    audit.add_argument("--out", required=True)
    evaluate = commands.add_parser("evaluate")
    for name in ("--predictions", "--data", "--fold", "--out"):
        evaluate.add_argument(name, required=True)
    for name, inputs, sections in (
        ("identity-errors", ("--predictions",), "errors,valence,vocabulary"), ("decompose", ("--slots", "--assignment"), None),
        ("audit-contract", ("--slots", "--assignment"), "oracles,counterfactual,bags"),
    ):
        command = commands.add_parser(name)
        for flag in (*inputs, "--data", "--out"):
            command.add_argument(flag, required=True)
        command.add_argument("--fold", default="valid")
        if sections:
            command.add_argument("--sections", default=sections)
    return top


def build_spectra(spark: SparkSession, args: argparse.Namespace) -> int:
    splits = tables.load_splits(tables.read_tsv(spark, args.split, ("spec", "Fold_0")), fold="Fold_0")
    if args.limit_parents is not None:
        splits = tables.limit_parents(splits, args.limit_parents)
    labels = tables.labels_to_output(tables.read_tsv(spark, args.labels, tables.LABEL_COLUMNS))
    built = ms.build_spectra(splits, labels, ms.read_records(spark, args.records), args.num_shards)
    failed = built.where("error IS NOT NULL").select("parent_spec", "error")
    if (first := failed.first()) is not None:
        print(f"{failed.count()} records failed, the first: {first['parent_spec']}: {first['error']}", file=sys.stderr)
        return 1
    good = built.drop("error")
    sink.publish(good, args.out, "spectra_v2", args.num_shards, args.overwrite,
        checks=lambda df: verify.spectra_checks(df).where("check_name <> 'inchikey_in_one_fold'"), folds=tables.FOLDS)
    return 0


def build_supervision(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = sink.read_dataset(spark, args.spectra, tuple(SUPERVISION_INPUTS), accept=("spectra_v2",)).where("fold <> 'test'")
    if args.limit_spectra is not None:
        rows = tables.fold_budget(rows, args.limit_spectra)
    built = match.build_supervision(rows, args.ppm, args.peak_cap, args.heavy_cap)
    sink.publish(built, args.out, "fragment_supervision_v2", args.num_shards, args.overwrite,
        checks=lambda df: verify.supervision_checks(df, args.ppm), folds=("train", "valid"), ppm=args.ppm)
    return 0


def verify_dataset(spark: SparkSession, args: argparse.Namespace) -> int:
    df = sink.read_dataset(spark, args.data)
    checks = verify.spectra_checks(df) if args.kind == "spectra" else verify.supervision_checks(df)
    checks.show(100, truncate=False)
    try:
        verify.gate(checks, ignore=("inchikey_in_one_fold",))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


def audit(spark: SparkSession, args: argparse.Namespace) -> int:
    df = sink.read_dataset(spark, args.data, accept=("fragment_supervision_v2",))
    analysis.strata_by_spectrum(df).coalesce(1).write.json(f"{args.out}/strata")
    analysis.peak_block(analysis.peak_support(df), ("dp",)).coalesce(1).write.json(f"{args.out}/decimals")
    analysis.summarise_slots(analysis.slot_diagnostics(df)).coalesce(1).write.json(f"{args.out}/slots")
    return 0


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    sink.refuse_test(args.fold)
    df = sink.read_dataset(spark, args.data, fold=args.fold)
    predictions = spark.read.parquet(args.predictions)
    lists = {"predicted_mz": "mz", "predicted_intensities": "weight"}
    peaks = spectra.explode_lists(predictions, "spectrum_uid", "slot", lists)
    scored = metrics.score_predictions(peaks, spectra.peaks(df), df)
    sink.prediction_table(predictions.drop("fold", "zero_prediction", *[c for c in predictions.columns if c.startswith("cos_at_")]), scored,
        args.fold).write.parquet(f"{args.out}/scored")
    metrics.summarise_scores(scored).coalesce(1).write.json(f"{args.out}/summary")
    return 0


def identity_errors(spark: SparkSession, args: argparse.Namespace) -> int:
    """Categories of missed identities, valence rates, and how often predictions were seen in the train fold."""
    sink.refuse_test(args.fold)
    df = sink.read_dataset(spark, args.data, fold=args.fold)
    lists = {"predicted_formulas": "formula", "predicted_ion_states": "ion_state"}
    predicted = spectra.explode_lists(spark.read.parquet(args.predictions), "spectrum_uid", "slot", lists).withColumnRenamed("spectrum_uid",
        "uid").where("formula <> ''")
    candidates = spectra.candidates(df).select(F.col("spectrum_uid").alias("uid"), "candidate_index", "formula", "ion_state")
    classes = cut(analysis.classify_identities(predicted, candidates))
    classes.write.parquet(f"{args.out}/identities")
    keys = df.select(F.col("spectrum_uid").alias("uid"), "precursor_mz", F.col("formula").alias("precursor"))
    sections = args.sections.split(",")
    if "errors" in sections:
        by = classes.join(keys, "uid").groupBy("category", scalar.mass_bucket("precursor_mz").alias("bucket"))
        by.agg(F.count("*").alias("n")).coalesce(1).write.json(f"{args.out}/errors")
    if "valence" in sections:
        flags = classes.join(keys, "uid").withColumn("f", chem.valence_flags(chem.parse_formula("formula"), chem.parse_formula("precursor")))
        rates = [F.avg(F.col(f"f.{n}").cast("double")).alias(n) for n in ("negative_rdbe", "hydrogen_excess", "above_precursor", "hard", "any")]
        flags.groupBy(F.col("category").alias("grp")).agg(F.count("*").alias("n"), *rates).coalesce(1).write.json(f"{args.out}/valence")
    if "vocabulary" in sections:
        fragments, losses = analysis.train_vocabulary(sink.read_dataset(spark, args.data, fold="train"))
        loss = chem.neutral_loss(chem.parse_formula("precursor"), chem.parse_formula("formula"))
        named = classes.join(keys, "uid").select(F.when(F.col("category") == "hit", "hit").otherwise("miss").alias("grp"), "formula", loss.alias("loss"))
        analysis.seen_rates(named, fragments, losses).coalesce(1).write.json(f"{args.out}/vocabulary")
    return 0


def slot_tables(spark: SparkSession, args: argparse.Namespace) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(spectra of the fold, slots with contribution, assignment), the latter two by uid."""
    sink.refuse_test(args.fold)
    df = sink.read_dataset(spark, args.data, fold=args.fold)
    slots = spark.read.parquet(args.slots).withColumnRenamed("spectrum_uid", "uid").withColumn("contribution", F.col("presence") * F.col("intensity"))
    return df, slots, spark.read.parquet(args.assignment).withColumnRenamed("spectrum_uid", "uid")


def decompose(spark: SparkSession, args: argparse.Namespace) -> int:
    """What limits each spectrum's cosine: per-spectrum Parquet and means."""
    df, slots, assignment = slot_tables(spark, args)
    rank = spectra.explode_lists(df, "spectrum_uid", "peak_index", {"supervision_rank": "rank"})
    peaks = metrics.transformed(spectra.peaks(df)).join(rank, ["spectrum_uid", "peak_index"], "left")
    peaks = peaks.select(F.col("spectrum_uid").alias("uid"), "peak_index", "t", F.coalesce(F.col("rank").between(0, scalar.SLOTS - 1),
        F.lit(False)).alias("selected"))
    targets = views.targets(df).select("uid", "target", "peak_index")
    placed = assignment.join(targets, ["uid", "target"]).join(slots, ["uid", "slot"]).select("uid", "peak_index", "intensity", "contribution")
    out = cut(scores.spectrum_cosine_loss(placed, peaks).join(scores.cosine_decomposition(peaks, placed), "uid"))
    out.write.parquet(f"{args.out}/per_spectrum")
    columns = ("loss", "oracle", "forced", "gated")
    wanted = [w for c in columns for w in quantiles.percentiles(c, (0.1, 0.5, 0.9), c)]
    summary = quantiles.aggregate(out, (), [F.count("*").alias("spectra"), *[F.avg(c).alias(f"{c}_mean") for c in columns]], wanted)
    summary.coalesce(1).write.json(f"{args.out}/summary")
    return 0


def audit_contract(spark: SparkSession, args: argparse.Namespace) -> int:
    """Oracle ceilings, counterfactual conditions and target bags: per-spectrum Parquet and means."""
    df, slots, assignment = slot_tables(spark, args)
    sections = args.sections.split(",")
    names = [f"cos_at_{k}_{n}" for n, _, _ in scalar.FOUR_SPACES for k in scalar.TOP_K]
    if "oracles" in sections:
        ceilings = cut(metrics.oracle_ceilings(df))
        ceilings.write.parquet(f"{args.out}/oracles")
        ceilings.groupBy("oracle").agg(F.count("*").alias("spectra"), *[F.avg(n).alias(n) for n in names]).coalesce(1).write.json(f"{args.out}/oracle_means")
    if "counterfactual" in sections:
        true = spectra.candidates(df).select(F.col("spectrum_uid").alias("uid"), "candidate_index", F.col("formula").alias("o_formula"),
            F.col("ion_state").alias("o_ion"))
        first = views.members(df).groupBy("uid", "target").agg(F.min("candidate_index").alias("candidate_index"))
        matched = assignment.join(views.targets(df).select("uid", "target", "y", "t"), ["uid", "target"]).join(first, ["uid", "target"],
            "left").join(true, ["uid", "candidate_index"], "left")
        made = analysis.counterfactuals(slots, matched.select("uid", "slot", "o_formula", "o_ion", "y", "t"))
        scored = cut(metrics.grid_cosines(spectra.peaks(df).withColumnRenamed("spectrum_uid", "uid"), made, "uid", analysis.CONDITIONS,
            scalar.TOP_K, scalar.FOUR_SPACES))
        scored.write.parquet(f"{args.out}/counterfactual")
        scored.groupBy(F.col("list").alias("condition")).agg(F.count("*").alias("spectra"),
            *[F.avg(n).alias(n) for n in names]).coalesce(1).write.json(f"{args.out}/counterfactual_means")
    if "bags" in sections:
        spectra.bags(df).groupBy("spectrum_uid", "target").agg(F.count("*").alias("identities")).groupBy("identities").agg(F.count("*").alias("bags")).coalesce(1).write.json(f"{args.out}/bags")
    return 0


COMMANDS = {"build-spectra": build_spectra, "build-supervision": build_supervision, "verify": verify_dataset, "audit": audit,
    "evaluate": evaluate, "identity-errors": identity_errors, "decompose": decompose, "audit-contract": audit_contract}


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("peakloom").getOrCreate()
    return COMMANDS[args.command](spark, args)


if __name__ == "__main__":
    sys.exit(main())
