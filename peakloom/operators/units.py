"""Problem 2: quantities recorded in different units, brought to one canonical unit."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from peakloom.functions.quantity import BLANK, ENERGY_IN_EV, VALID, Registry, convert, lex, parse_quantity, unit_of
from peakloom.session import SMALL_ROWS, small, table

QUANTITY = T.StructType(
    [T.StructField("status", T.StringType()), T.StructField("number", T.DoubleType()), T.StructField("unit", T.StringType())]
)


#: Relative difference up to which a table's scale and the one that follows from the dimensions count as the same.
AGREEMENT = 1e-6


@F.pandas_udf(QUANTITY)
def quantity(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """parse_quantity over a column; each distinct text of an Arrow batch is parsed once."""
    for batch in texts:
        codes, distinct = pd.factorize(batch)
        parsed = [parse_quantity(t) for t in distinct] + [parse_quantity(None)]  # code -1: null
        yield pd.DataFrame(
            {
                "status": [parsed[i].status for i in codes],
                "number": [parsed[i].number for i in codes],
                "unit": [parsed[i].unit.code if parsed[i].unit else None for i in codes],
            }
        )


def name_key(name: Column) -> Column:
    """Instrument names are equal if they differ only in letter case, blanks, hyphens and underscores."""
    return F.lower(F.regexp_replace(name, r"[\s\p{Z}\-_]+", ""))


def unit_table(units: DataFrame, registry: Registry = ENERGY_IN_EV, max_rows: int = SMALL_ROWS) -> DataFrame:
    """(unit, dims, scale, offset, power, ref_mz, unit_code) of each row of a table of unit_code, ev_per_unit and ref_mz.

    unit is the grammar's normal form of unit_code, so that ``kilojoule per mole`` meets ``kJ/mol``; dims are its exponents over
    the base dimensions, and power is the exponent of m/z that they lack for an energy, which the row must supply. The table and
    the vectors must tell the same: a code that the grammar doesn't read, whose dimensions can't become the registry's target,
    that needs an m/z and has no reference or the other way round, or whose scale isn't what the vectors give, raises. The
    table must have at most max_rows rows; it is a table of units, and a larger one raises.
    """
    rows = units.select("unit_code", "ev_per_unit", "ref_mz").where("unit_code IS NOT NULL").distinct().limit(max_rows + 1).collect()
    if len(rows) > max_rows:
        raise ValueError(f"more than {max_rows} units")
    out = {}
    for code, scale, ref in rows:
        q = parse_quantity(f"1 {code}")
        unit = q.unit or unit_of([t[:2] for t in lex(code) or []])
        if unit is None or registry.plan(unit) is None:
            raise ValueError(f"unit {code!r} can't be converted to {registry.target.code}")
        _, offset, need = registry.plan(unit)
        power = need.get("Z", 0)
        if (power != 0) != (ref is not None):
            raise ValueError(f"unit {code!r} has an exponent of {power} of m/z and the reference {ref}")
        own = convert(1.0, unit, registry, Z=ref) - offset
        if not math.isclose(own, scale, rel_tol=AGREEMENT):
            raise ValueError(f"unit {code!r} is {scale} {registry.target.code} by the table and {own} by its dimensions")
        out[unit.code] = (unit.code, list(unit.dims), float(scale), float(offset), power, None if ref is None else float(ref), code)
    schema = "unit STRING, dims ARRAY<INT>, scale DOUBLE, offset DOUBLE, power INT, ref_mz DOUBLE, unit_code STRING"
    return units.sparkSession.createDataFrame(sorted(out.values()), schema)


def convert_energies(
    df: DataFrame,
    instruments: DataFrame,
    units: DataFrame,
    *,
    raw: str = "collision_energy_raw",
    bare: str = "collision_energy",
    instrument: str = "instrument",
    precursor: str = "precursor_mz",
    max_rows: int = SMALL_ROWS,
) -> DataFrame:
    """df with energy_unit (a unit_code or null), energy_ev (DOUBLE or null) and energy_status.

    The text decides; where it is null or blank, the number in ``bare`` counts as a bare number of the
    instrument's unit. energy_status is ``ok``, ``missing`` (neither is there), ``invalid`` (text or
    number is no single finite non-negative quantity), ``unknown_unit`` (a bare number of an unlisted
    instrument, or a unit that ``units`` lacks) or ``no_precursor`` (a normalised energy without a finite,
    positive m/z). All rows stay, repeated ones too; columns of df with the names of the three new ones
    are replaced, other extra columns pass through. An instrument listed twice with different units
    counts as unlisted. Empty tables give empty results.

    Both dimension tables are broadcast if they have at most max_rows rows, else joined by shuffle.
    """
    fresh = df.drop("energy_unit", "energy_ev", "energy_status")
    # Inner names that can't clash with columns of df.
    q, ik, bu = "__quantity", "__instrument_key", "__bare_unit"
    by_name = (
        instruments.select(name_key(F.col("instrument")).alias(ik), parse_code(F.col("bare_unit")).alias(bu))
        .where(f"{ik} IS NOT NULL")
        .groupBy(ik)
        .agg(F.min(bu).alias(bu), F.max(bu).alias("__other"))
        .where(f"{bu} = __other")
        .drop("__other")
    )
    known = unit_table(units, max_rows=max_rows).select(
        F.col("unit").alias("__unit"), F.col("scale").alias("__scale"), F.col("offset").alias("__offset"), F.col("ref_mz").alias("__ref"),
            F.col("unit_code").alias("__code"),
        F.col("power").alias("__power"),
    )
    number = F.col(bare).cast("double")
    usable = number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number < float("inf"))
    text = F.col(f"{q}.status")
    from_text = text != BLANK
    out = (
        fresh.withColumn(q, quantity(F.col(raw)))
        .withColumn(ik, name_key(F.col(instrument)))
        .withColumn("__number", F.when(text == VALID, F.col(f"{q}.number")).when((text == BLANK) & usable, number))
        .join(small(by_name, max_rows), ik, "left")
        .withColumn("__named", F.when(F.col("__number").isNotNull(), F.coalesce(F.col(f"{q}.unit"), F.col(bu))))
        .join(F.broadcast(known), F.col("__named") == F.col("__unit"), "left")
    )
    mz = F.col(precursor).cast("double")
    # The m/z to the power that the unit's exponents lack, relative to the reference at which the scale holds.
    factor = F.when(F.col("__power") == 0, F.lit(1.0)).when((mz > 0) & (mz < float("inf")), F.pow(mz / F.col("__ref"), F.col("__power").cast("double")))
    status = (
        F.when(from_text & (text != VALID), "invalid")
        .when(~from_text & number.isNull(), "missing")
        .when(F.col("__number").isNull(), "invalid")
        .when(F.col("__code").isNull(), "unknown_unit")
        .when(factor.isNull(), "no_precursor")
        .otherwise("ok")
    )
    return out.select(
        *[F.col(f"`{c}`") for c in fresh.columns],
        F.col("__code").alias("energy_unit"),
        ((F.col("__number") * F.col("__scale") + F.col("__offset")) * factor).alias("energy_ev"),
        status.alias("energy_status"),
    )


@F.pandas_udf(T.StringType())
def parse_code(codes: pd.Series) -> pd.Series:
    """The grammar's normal form of a unit code, null where it reads none."""
    known = {c: parse_quantity(f"1 {c}").unit for c in codes.dropna().unique()}
    return codes.map(lambda c: known[c].code if c is not None and known.get(c) else None).astype(object)


def p2_energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of spectra_v2 with its energy in eV, or null where that can't be known."""
    cols = ["spectrum_uid", "collision_index", "collision_energy_raw", "collision_energy", "instrument", "precursor_mz"]
    df = table(spark, sf_dir, "spectra_v2").select(*cols)
    return convert_energies(df, table(spark, sf_dir, "instrument_units"), table(spark, sf_dir, "energy_units")).select(
        "spectrum_uid", "collision_index", "energy_unit", "energy_ev", "energy_status"
    )


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spectra whose energy is recorded in a unit other than eV and can be converted, in thousandths of an eV."""
    return (
        p2_energy(spark, sf_dir)
        .where("energy_status = 'ok' AND energy_unit <> 'eV' AND spectrum_uid IS NOT NULL")
        .select("spectrum_uid", F.round(F.col("energy_ev") * 1000.0).cast("bigint").alias("energy_mev"))
        .distinct()
    )
