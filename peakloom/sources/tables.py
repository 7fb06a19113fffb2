"""Label and split tables: tab-separated text, no quoting, no inference, validated on load."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LABEL_COLUMNS = ("spec", "precursor", "collision_energies", "smiles", "formula", "inchikey", "ionization", "instrument")
#: Label column -> output column.
LABEL_OUTPUT = {"precursor": "precursor_mz", "ionization": "adduct"}
FOLDS = ("train", "valid", "test")


def read_tsv(spark: SparkSession, path: str, columns: tuple[str, ...]) -> DataFrame:
    """All columns as STRING. A file whose header lacks a column, or has them in another order, is an error."""
    reader = spark.read.option("sep", "\t").option("quote", "").option("header", True).option("enforceSchema", False)
    return reader.schema(", ".join(f"`{c}` STRING" for c in columns)).csv(path)


def normal_fold(fold: Column) -> Column:
    return F.when(fold == "val", "valid").otherwise(fold)


def split_problems(splits: DataFrame, spec: str = "spec", fold: str = "fold_0") -> DataFrame:
    """(problem, spec): repeated or missing specs and unknown folds."""
    named = splits.select(F.col(spec).alias("spec"), normal_fold(F.col(fold)).alias("fold"))
    repeated = named.where("spec IS NOT NULL").groupBy("spec").count().where("count > 1").select(F.lit("repeated").alias("problem"), "spec")
    missing = named.where("spec IS NULL OR trim(spec) = ''").select(F.lit("missing").alias("problem"), "spec")
    unknown = named.where(~F.coalesce(F.col("fold").isin(*FOLDS), F.lit(False))).select(F.lit("unknown_fold").alias("problem"), "spec")
    return repeated.unionByName(missing).unionByName(unknown)


def load_splits(splits: DataFrame, spec: str = "spec", fold: str = "fold_0") -> DataFrame:
    """(spec, fold); an error if split_problems finds any."""
    first = split_problems(splits, spec, fold).first()
    if first is not None:
        raise ValueError(f"{first['problem']}: {first['spec']}")
    return splits.select(F.col(spec).alias("spec"), normal_fold(F.col(fold)).alias("fold"))


def labels_to_output(labels: DataFrame) -> DataFrame:
    """Renamed label columns with a DOUBLE precursor_mz; nulls and unparsable numbers stay null for the caller to report."""
    out = labels.select(*[F.col(c).alias(LABEL_OUTPUT.get(c, c)) for c in LABEL_COLUMNS])
    return out.withColumn("precursor_mz", F.col("precursor_mz").try_cast("double"))


def incomplete_labels(labels: DataFrame) -> DataFrame:
    """Labels with a null in any column that is needed."""
    return labels.where(" OR ".join(f"`{c}` IS NULL" for c in LABEL_COLUMNS))


def missing_labels(splits: DataFrame, labels: DataFrame) -> DataFrame:
    return splits.select("spec").distinct().join(labels.select("spec"), "spec", "left_anti")


def limit_parents(splits: DataFrame, n: int) -> DataFrame:
    """The first n specs in sorted order: a top-n, not a full sort."""
    return splits.orderBy("spec").limit(n)


def fold_budget(df: DataFrame, n: int, order: tuple[str, ...] = ("shard", "parent_spec", "collision_index")) -> DataFrame:
    """At most floor(n/2) train rows and the rest valid ones, the first in order: two top-n, no window over a fold."""
    first = lambda fold, k: df.where(F.col("fold") == fold).orderBy(*order).limit(k)
    return first("train", n // 2).unionByName(first("valid", n - n // 2))
