"""Text records of spectra (``.ms``): one record to several collision blocks, inside the JVM.

Grammar: line ends are LF, CR or CRLF, blank lines don't count. Lines that start with ``>`` or ``#`` are
metadata, legal only before the first block. ``>collision E`` with one finite number opens a block. A
peak line has two fields: an m/z above 0 and an intensity of at least 0, both finite. Peaks keep the
file's order. The first fault of a record makes the record fail; it is reported, not raised.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions import scalar

_NUMBER = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """(spec, content STRING) of every ``.ms`` file under path; spec is the file's stem."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.ms").option("recursiveFileLookup", True).load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.ms$", 1).alias("spec"), F.decode("content", "UTF-8").alias("content"))


def _finite(token: Column) -> Column:
    value = F.when(token.rlike(f"^{_NUMBER}$"), token.try_cast("double"))
    return F.when(F.abs(value) < float("inf"), value)


def parse_records(records: DataFrame, expected: str | None = None) -> DataFrame:
    """(spec, error, block, collision_energy_raw, collision_energy, mzs, intensities, mz_decimal_places).

    A sound record gives a row per block (none if it holds no block); a faulty one a single row with its first
    error. A null content is the error ``missing``. expected: a column with the label's list of energies, whose
    tokens must equal the blocks' in number, value and order.

    A record is parsed inside its row by array functions, so nothing is shuffled.
    """
    content = F.regexp_replace("content", "\r\n?", "\n")
    lines = F.filter(F.transform(F.split(content, "\n"), lambda s: F.trim(F.regexp_replace(s, r"\s+", " "))), lambda s: s != "")

    def kind(s: Column) -> Column:
        return F.when(s.rlike(r"^>collision( |$)"), "block").when(s.rlike("^[>#]"), "meta").otherwise("peak")

    def read(s: Column) -> Column:
        parts = F.split(s, " ")
        a, b = _finite(F.get(parts, F.lit(0))), _finite(F.get(parts, F.lit(1)))
        two = F.size(parts) == 2
        ascii_only = s.rlike(r"^[\x00-\x7f]*$")
        energy = _finite(F.get(parts, F.lit(1)))
        fault = (
            F.when((kind(s) == "block") & ~two, "collision line needs one value")
            .when((kind(s) == "block") & energy.isNull(), "collision energy is no finite number")
            .when((kind(s) == "peak") & ~ascii_only, "not ASCII")
            .when((kind(s) == "peak") & ~two, "peak line needs two fields")
            .when((kind(s) == "peak") & (a.isNull() | (a <= 0)), "m/z must be a finite number above 0")
            .when((kind(s) == "peak") & (b.isNull() | (b < 0)), "intensity must be a finite number of at least 0")
        )
        return F.struct(
            kind(s).alias("kind"), fault.alias("fault"), F.when(kind(s) == "block", F.get(parts, F.lit(1))).alias("energy"), a.alias("mz"), b.alias("y"),
            scalar.decimal_places(F.get(parts, F.lit(0))).alias("dp"),
        )

    parsed = records.withColumn("l", F.transform(lines, read))
    starts = F.filter(F.transform("l", lambda x, i: F.when(x["kind"] == "block", i)), lambda i: i.isNotNull())
    parsed = parsed.withColumn("starts", starts)
    first = F.coalesce(F.get(F.col("starts"), F.lit(0)), F.lit(2**31 - 1))

    def placed(x: Column, i: Column) -> Column:
        return F.coalesce(x["fault"], F.when((x["kind"] == "meta") & (i > first),
            "metadata after the first block").when((x["kind"] == "peak") & (i < first), "peak before the first block"))

    faults = F.filter(F.transform("l", placed), lambda f: f.isNotNull())
    energies = F.transform("starts", lambda i: F.get(F.col("l"), i)["energy"])
    error = F.when(F.col("content").isNull(), "missing").otherwise(F.get(faults, F.lit(0)))
    if expected is not None:
        wanted = scalar.literal_list(expected)
        differ = ~F.coalesce(F.transform(energies, lambda e: e.try_cast("double")) == F.transform(wanted, lambda e: e.try_cast("double")), F.lit(False))
        error = F.coalesce(error, F.when(differ, "energies differ from the label"))

    def block(i: Column, b: Column) -> Column:
        end = F.coalesce(F.get(F.col("starts"), b + 1), F.size("l"))
        body = F.slice("l", i + 2, end - i - 1)
        raw = F.get(F.col("l"), i)["energy"]
        return F.struct(
            b.alias("block"), raw.alias("collision_energy_raw"), raw.try_cast("double").alias("collision_energy"), F.transform(body,
                lambda p: p["mz"]).alias("mzs"),
            F.transform(body, lambda p: p["y"].cast("float")).alias("intensities"), F.transform(body,
                lambda p: p["dp"].cast("tinyint")).alias("mz_decimal_places"),
        )

    parsed = parsed.withColumn("error", error)
    blocks = F.when(F.col("error").isNull(), F.transform("starts", block))
    # A faulty record keeps one row with null block columns.
    out = parsed.select("spec", "error", F.explode(F.when(F.col("error").isNotNull(), F.array(F.lit(None))).otherwise(blocks)).alias("b"))
    return out.select("spec", "error", "b.*")


def build_spectra(splits: DataFrame, labels: DataFrame, records: DataFrame, shards: int = scalar.SHARDS, check_energies: bool = True) -> DataFrame:
    """Spectra rows and failures in one relation: failures have an error and no uid.

    splits: (spec, fold); labels: output of labels_to_output; records: (spec, content). Parents without a label
    or record fail, as do records with a fault.
    """
    joined = splits.join(labels, "spec", "left").join(records, "spec", "left")
    blocks = parse_records(joined, "collision_energies" if check_energies else None)
    unlabelled = F.when(F.col("formula").isNull() | F.col("precursor_mz").isNull(), "no complete label")
    keep = joined.select("spec", "fold", "smiles", "formula", "inchikey", "adduct", "instrument", "precursor_mz")
    out = blocks.join(keep, "spec").withColumn("error", F.coalesce(unlabelled, "error"))
    ok = F.col("error").isNull()
    return out.select(
        F.when(ok, scalar.spectrum_uid("spec", "block")).alias("spectrum_uid"), F.col("spec").alias("parent_spec"), "fold",
            scalar.shard_of("spec", shards).alias("shard"),
        F.col("block").cast("int").alias("collision_index"), "collision_energy", "collision_energy_raw", "smiles", "formula", "inchikey",
            "adduct", "instrument", "precursor_mz",
        "mzs", "intensities", "mz_decimal_places", "error",
    )
