"""Sharded Parquet datasets with manifests: written aside, checked as written, published by one rename.

Nothing here needs a local path: folders are moved and manifests read through the file system that the path names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.operators import verify
from peakloom.sources.files import Files

MANIFEST = "manifest.json"
VERSIONS = ("spectra_v2", "fragment_supervision_v2")


def write_sharded(df: DataFrame, path: str, shards: int, order: tuple[str, ...] = ("parent_spec", "collision_index"), folds: Sequence[str] = ()) -> None:
    """zstd Parquet under fold=../shard=../, sorted inside each file; one shuffle, by shard.

    A shard of one of ``folds`` that has no row gets a file without rows, so that every shard is there.
    """
    by = ("fold", "shard")
    spread = df.repartition(shards, *[F.col(c) for c in by]).sortWithinPartitions(*by, *order)
    spread.write.partitionBy(*by).option("compression", "zstd").parquet(path)
    files = Files(df.sparkSession)
    empty = None
    for fold in folds:
        have = set(files.names(f"{path}/fold={fold}"))
        for n in range(shards):
            if f"shard={n}" not in have:
                empty = empty if empty is not None else df.drop(*by).limit(0).coalesce(1)
                empty.write.mode("overwrite").parquet(f"{path}/fold={fold}/shard={n}")


def make_manifest(df: DataFrame, version: str, **extra: object) -> dict:
    """Counts by fold and overall, from one rollup; a row per fold reaches the driver."""
    rows = verify.counters(df, ("fold",)).collect()
    counts = {r["fold"] if r["level"] == 0 else "all": {k: r[k] for k in ("parents", "spectra", "peaks")} for r in rows}
    return {"schema_version": version, "created_utc": datetime.now(timezone.utc).isoformat(timespec="seconds"), "counts": counts, **extra}


def publish(
    df: DataFrame, out: str, version: str, shards: int, overwrite: bool = False, checks: Callable[[DataFrame], DataFrame] | None = None,
        folds: Sequence[str] = (), **extra: object,
) -> dict:
    """Write beside out, run the gate on what was written, write the manifest, then rename; an older dataset is moved away and removed last.

    checks makes the table of checks from the dataset as it is read back; those of the layout come with it. A failed gate leaves
    the temporary directory for inspection and out untouched.
    """
    spark, files = df.sparkSession, Files(df.sparkSession)
    if files.exists(out) and not overwrite:
        raise FileExistsError(out)
    token = uuid.uuid4().hex[:8]
    tmp, trash = f"{out}.tmp.{token}", f"{out}.old.{token}"
    write_sharded(df, tmp, shards, folds=folds)
    written = spark.read.parquet(tmp)
    if checks is not None:
        verify.gate(checks(written).unionByName(verify.layout_checks(written, shards)))
        missing = {f: sorted({f"shard={n}" for n in range(shards)} - set(files.names(f"{tmp}/fold={f}"))) for f in folds}
        if any(missing.values()):
            raise ValueError(f"shards without a file: {missing}")
    manifest = make_manifest(written, version, **extra)
    files.write_text(f"{tmp}/{MANIFEST}", json.dumps(manifest, indent=2, sort_keys=True))
    if files.exists(out):
        files.rename(out, trash)
    files.rename(tmp, out)
    files.delete(trash)
    return manifest


def read_manifest(spark: SparkSession, path: str) -> dict:
    return json.loads(Files(spark).read_text(f"{path}/{MANIFEST}"))


def read_dataset(spark: SparkSession, path: str, columns: tuple[str, ...] | None = None, shards: list[int] | None = None, accept: tuple[str,
    ...] = VERSIONS, fold: str | None = None) -> DataFrame:
    """A published dataset behind its version gate; fold and shards prune partitions, columns prune the scan."""
    version = read_manifest(spark, path)["schema_version"]
    if version not in accept:
        raise ValueError(f"schema version {version!r} is not one of {accept}")
    df = spark.read.parquet(path)
    if fold is not None:
        df = df.where(F.col("fold") == fold)
    if shards is not None:
        df = df.where(F.col("shard").isin(shards))
    return df.select(*columns) if columns else df


def refuse_test(fold: str) -> None:
    if fold == "test":
        raise ValueError("the test fold is sealed")


ALLOWED_INPUTS = ("spectrum_uid", "smiles", "formula", "adduct", "collision_energy", "instrument", "precursor_mz")


def conditioning_only(df: DataFrame, extra: tuple[str, ...] = ()) -> DataFrame:
    """df, or an error if it holds a column that a prediction mustn't see."""
    leak = sorted(set(df.columns) - set(ALLOWED_INPUTS) - set(extra))
    if leak:
        raise ValueError(f"columns that leak the observation: {leak}")
    return df


def prediction_table(predictions: DataFrame, scores: DataFrame, fold: str) -> DataFrame:
    """Predictions with their scores by spectrum_uid: no score counts as a cosine of 0 and a zero prediction."""
    refuse_test(fold)
    joined = predictions.join(scores, "spectrum_uid", "left").withColumn("fold", F.lit(fold))
    filled = [F.coalesce(F.col(c), F.lit(0.0)).alias(c) if c.startswith("cos_at_") else F.coalesce(F.col(c),
        F.lit(True)).alias(c) if c == "zero_prediction" else F.col(c) for c in joined.columns]
    return joined.select(*filled)


def append_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of every file under path."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def tree_digest(digests: DataFrame) -> DataFrame:
    """(files, sha256): one digest of (name, digest) in order of the names."""
    lines = F.transform(F.array_sort(F.collect_list(F.struct("name", "sha256"))), lambda f: F.concat(f["name"], F.lit(" "), f["sha256"]))
    return digests.agg(F.count("*").alias("files"), F.sha2(F.array_join(lines, "\n").cast("binary"), 256).alias("sha256"))
