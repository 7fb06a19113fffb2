"""Problem 6: rows that fail to parse, set apart with the reason while the valid rows load."""

from __future__ import annotations

import csv
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from peakloom.functions.elements import ELEMENTS
from peakloom.functions.quantity import NOT_A_QUANTITY, parse_quantity
from peakloom.session import table

FIELDS = ("spec", "collision_index", "formula", "adduct", "collision_energy_raw", "instrument", "precursor_mz", "remark")
#: The reasons in the order in which they apply.
REASONS = ("quoting", "column_count", "formula", "collision_energy", "adduct")

_FORMULA = re.compile(r"(?:([A-Z][a-z]?)([0-9]*))+")
_PART = re.compile(r"([A-Z][a-z]?)([0-9]*)")
_CHARGE = re.compile(r"(?:^|[^+\-])[+-]$")


class Malformed(Exception):
    """A record without the promised structure; its argument is the reason."""


def formula(text: str | None) -> str:
    """A sequence of real element symbols, each with an optional count of at least 1; else ValueError."""
    if not text or _FORMULA.fullmatch(text) is None:
        raise ValueError("formula")
    for symbol, count in _PART.findall(text):
        if symbol not in ELEMENTS or (count and not count.strip("0")):
            raise ValueError("formula")
    return text


def energy(text: str | None) -> str | None:
    """Null, blank, or one finite non-negative number alone or with words the grammar knows; else ValueError."""
    if parse_quantity(text).status == NOT_A_QUANTITY:
        raise ValueError("collision_energy")
    return text


def adduct(text: str | None) -> str:
    """Apart from outer blanks it ends in one ASCII sign, and a charge number before the sign is 1; else ValueError."""
    body = (text or "").strip()
    if not body or _CHARGE.search(body) is None:
        raise ValueError("adduct")
    head, digits = body[:-1].rstrip(), ""
    while head and head[-1].isdigit():
        head, digits = head[:-1], head[-1] + digits
    if digits and not (digits.isdecimal() and int(digits) == 1) and digits != "¹":
        raise ValueError("adduct")
    return text


#: The typed constructors in the order of REASONS.
TYPED = {"formula": formula, "collision_energy_raw": energy, "adduct": adduct}


def assemble(lines: Iterator[str], delim: str) -> Iterator[tuple[str, bool]]:
    """Join physical lines into records: a line break inside a quoted field belongs to the record.

    Yields (record, sound); sound is False if a double quote stands elsewhere than around a whole field
    or doubled inside one, or if the last quoted field isn't closed. One pass, one state per character
    class: at the start of a field, in a bare field, in quotes, after a closing quote.
    """
    start, bare, quoted, closed = range(4)
    parts, state, sound = [], start, True
    token = re.compile(f'["{re.escape(delim)}\r\n]')
    for line in lines:
        parts.append(line)
        at = 0
        for m in token.finditer(line):
            sign, here = m.group(), m.start()
            if here > at:  # other characters came first
                if state == start:
                    state = bare
                elif state == closed:
                    sound, state = False, bare
            at = here + 1
            if sign == '"':
                if state == start:
                    state = quoted
                elif state == quoted:
                    state = closed
                elif state == closed and here and line[here - 1] == '"':
                    state = quoted  # a doubled quote
                else:
                    sound = False
            elif state != quoted:
                state = start
        if at < len(line):
            if state == start:
                state = bare
            elif state == closed:
                sound, state = False, bare
        if state != quoted:
            yield "".join(parts), sound
            parts, state, sound = [], start, True
    if parts:
        yield "".join(parts), False


def split_record(line: str | None, delim: str | None, width: int = len(FIELDS)) -> list[str]:
    """The fields of one record by Python's strict csv reader; Malformed with quoting or column_count."""
    if line is None or line == "" or delim is None or len(delim) != 1 or delim in '"\r\n':
        raise Malformed("column_count")
    records = list(assemble(iter([line]), delim))
    if not all(sound for _, sound in records):
        raise Malformed("quoting")
    try:
        rows = list(csv.reader([record for record, _ in records], delimiter=delim, quotechar='"', doublequote=True, strict=True))
    except csv.Error as error:
        # Quotes are sound here: what is left is a bare line break, which starts another record.
        raise Malformed("column_count" if "new-line" in str(error) else "quoting") from error
    if len(rows) != 1 or len(rows[0]) != width:
        raise Malformed("column_count")
    return rows[0]


def parse_record(line: str | None, delim: str | None) -> tuple[dict[str, str] | None, str | None]:
    """(fields, None), or (fields as far as they are known, reason)."""
    try:
        record = dict(zip(FIELDS, split_record(line, delim)))
    except Malformed as error:
        return None, str(error)
    try:
        for name, make in TYPED.items():
            make(record[name])
    except ValueError as error:
        return record, str(error)
    return record, None


def load_delimited(df: DataFrame, *, line: str = "line", delim: str = "delim", key: str = "record_id") -> DataFrame:
    """(key, the eight fields as STRING, reason) for each row of a table of text records.

    reason is null for a valid row. Structural failures (``quoting``, ``column_count``) leave all fields
    null; later ones keep the fields as read. Null and empty lines, and a delimiter that isn't one
    character, are ``column_count``. Whole lines are read, however long. Repeated rows stay repeated;
    extra columns are dropped, so their names can't clash. An empty table gives an empty result.
    """
    source = df.select(F.col(key).alias("__key"), F.col(delim).alias("__delim"), F.col(line).alias("__line"))
    kind = df.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, " + ", ".join(f"{f} STRING" for f in FIELDS) + ", reason STRING"

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        for batch in batches:
            columns: dict[str, list] = {f: [] for f in (*FIELDS, "reason")}
            for text, sep in zip(batch.column("__line").to_pylist(), batch.column("__delim").to_pylist()):
                record, reason = parse_record(text, sep)
                for f in FIELDS:
                    columns[f].append(record[f] if record else None)
                columns["reason"].append(reason)
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), *(pa.array(v, pa.string()) for v in columns.values())], names=[key, *columns]
            )

    return source.mapInArrow(parse, schema)


def check_fields(df: DataFrame, *, key: str = "spectrum_uid") -> DataFrame:
    """(key, formula, collision_energy_raw, adduct, reason) for each row of a typed table.

    reason is the first failing field's, null for a valid row. Each distinct value of an Arrow batch is
    checked once. Null and empty formulas and null and blank adducts fail; null and blank energies
    don't. All rows stay; extra columns are dropped.
    """
    kind = df.schema[key].dataType.simpleString()
    names = ("formula", "collision_energy_raw", "adduct")
    schema = f"`{key}` {kind}, " + ", ".join(f"{n} STRING" for n in names) + ", reason STRING"

    def fails(make, value: str | None) -> str | None:
        try:
            make(value)
        except ValueError as error:
            return str(error)
        return None

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            reasons: list[str | None] = [None] * batch.num_rows
            for name in reversed(names):
                coded = batch.column(name).dictionary_encode()
                found = [fails(TYPED[name], v) for v in coded.dictionary.to_pylist()]
                of_null = fails(TYPED[name], None)
                for i, code in enumerate(coded.indices.to_pylist()):
                    reason = of_null if code is None else found[code]
                    if reason:
                        reasons[i] = reason
            yield pa.RecordBatch.from_arrays(
                [batch.column("__key"), *(batch.column(n) for n in names), pa.array(reasons, pa.string())], names=[key, *names, "reason"]
            )

    return df.select(F.col(key).alias("__key"), *names).mapInArrow(check, schema)


def p6_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of raw_spectra: the valid ones typed, the others with their reason."""
    loaded = load_delimited(table(spark, sf_dir, "raw_spectra"))
    return loaded.select(
        "record_id", "spec", F.expr("try_cast(collision_index AS INT)").alias("collision_index"), "formula", "adduct", "collision_energy_raw",
        "instrument", F.expr("try_cast(precursor_mz AS DOUBLE)").alias("precursor_mz"), "remark", "reason",
    )


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per failing record of raw_spectra and of spectra_v2."""
    raw = load_delimited(table(spark, sf_dir, "raw_spectra")).where("reason IS NOT NULL")
    spectra = check_fields(table(spark, sf_dir, "spectra_v2")).where("reason IS NOT NULL")
    return (
        raw.select(F.lit("raw_spectra").alias("rec_table"), F.col("record_id").cast("string").alias("rec_key"), "reason")
        .unionByName(spectra.select(F.lit("spectra_v2").alias("rec_table"), F.col("spectrum_uid").alias("rec_key"), "reason"))
        .distinct()
    )
