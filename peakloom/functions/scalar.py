"""Scalar Column expressions: keys, tolerances, bins, texts, losses."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Defaults of matching and scoring.
PPM, EPSILON, SLOTS, MIN_DECIMALS, SHARDS = 10.0, 1e-9, 64, 2, 64
BINS, BIN_RANGE, DUST, TOP_K, PRESENCE = 15_000, 1500.0, 1e-5, (20, 100), 0.5
# Names of the evaluation and comparison spaces.
SPACES = ("canonical_sqrt", "legacy_raw")
#: Comparison spaces: (name, observation exponent, prediction exponent), both over root intensities.
FOUR_SPACES = (("canonical_sqrt", 0.5, 1.0), ("legacy_raw", 1.0, 1.0), ("raw_via_squared_prediction", 1.0, 2.0), ("double_sqrt", 0.5, 0.5))
MISSING = "NA"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def shard_of(parent: Column | str, shards: int = SHARDS) -> Column:
    """The first 64 bits of sha256 as an unsigned number, modulo the number of shards."""
    high = F.conv(F.substring(F.sha2(_col(parent), 256), 1, 16), 16, 10).cast("decimal(20,0)")
    return (high % shards).cast("int")


def spectrum_uid(parent: Column | str, index: Column | str) -> Column:
    return F.format_string("%s:%02d", _col(parent), _col(index).cast("int"))


def shard_file(shard: Column | str) -> Column:
    return F.format_string("part-%05d.parquet", _col(shard).cast("int"))


def shard_of_file(path: Column | str) -> Column:
    return F.regexp_extract(_col(path), r"part-(\d+)\.parquet$", 1).try_cast("int")


def decimal_places(token: Column | str) -> Column:
    """Digits after the decimal mark of a numeric token less its exponent, from 0 to 127; null for no number."""
    text = F.trim(_col(token))
    shape = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE]([+-]?[0-9]+))?$"
    fraction = F.length(F.regexp_extract(text, r"\.([0-9]*)", 1))
    exponent = F.coalesce(F.regexp_extract(text, shape, 3).try_cast("int"), F.lit(0))
    return F.when(text.rlike(shape), F.least(F.greatest(fraction - exponent, F.lit(0)), F.lit(127)))


def is_low_precision(decimals: Column | str) -> Column:
    return _col(decimals) < MIN_DECIMALS


def mass_tolerance(mz: Column | str, decimals: Column | str, ppm: float = PPM) -> Column:
    """The relative tolerance, at least half a unit of the last place where two or more places are given."""
    relative = _col(mz) * F.lit(float(ppm) * 1e-6)
    half = F.lit(0.5) * F.pow(F.lit(10.0), -_col(decimals).cast("double"))
    return F.when(_col(decimals) >= MIN_DECIMALS, F.greatest(relative, half)).otherwise(relative)


def theoretical_mz(heavy: Column | str, hydrogens: Column | str, hydrogen_mass: float, offset: Column | str) -> Column:
    return _col(heavy) + _col(hydrogens).cast("double") * F.lit(hydrogen_mass) + _col(offset)


def ppm_error(mz: Column | str, theory: Column | str) -> Column:
    return (_col(mz) - _col(theory)) / _col(theory) * F.lit(1e6)


def bin_index(mz: Column | str, bins: int = BINS, span: float = BIN_RANGE) -> Column:
    """Bin number from 1; null where it exceeds the range of INT."""
    return (F.floor(_col(mz) * F.lit((bins - 1) / span)) + 1).try_cast("int")


def in_range(index: Column | str, bins: int = BINS) -> Column:
    return F.coalesce(_col(index).between(0, bins - 1), F.lit(False))


def observation_in_space(y: Column | str, space: str) -> Column:
    """Intensity as the observation of a comparison space; an unknown space is an error."""
    if space not in SPACES:
        raise ValueError(f"unknown space {space!r}")
    positive = F.greatest(_col(y).cast("double"), F.lit(0.0))
    return F.sqrt(positive) if space == "canonical_sqrt" else positive


def text_or_na(value: Column | str) -> Column:
    text = F.trim(_col(value))
    return F.when(F.coalesce((text == "") | (F.lower(text) == "nan"), F.lit(True)), MISSING).otherwise(text)


def number_or_na(value: Column | str, decimals: int) -> Column:
    """Fixed decimals of the exact binary value, ties to even; NA for null, unparsable or infinite numbers.

    The JVM's formatter rounds the shortest decimal text half up, which differs at ties; so this one
    expression is an Arrow function.
    """

    @F.pandas_udf("string")
    def text(values: pd.Series) -> pd.Series:
        return values.map(lambda x: f"{x:.{decimals}f}" if x is not None and math.isfinite(x) else MISSING).astype(object)

    return text(_col(value).try_cast("double"))


def format_row(smiles: Column | str, formula: Column | str, adduct: Column | str, energy: Column | str, instrument: Column | str,
    precursor: Column | str) -> Column:
    """The conditioning text of a spectrum."""
    parts = (
        ("SMILES", text_or_na(smiles)), ("formula", text_or_na(formula)), ("adduct", text_or_na(adduct)), ("collision_energy", number_or_na(energy, 2)),
        ("instrument", text_or_na(instrument)), ("precursor_mz", number_or_na(precursor, 4)),
    )
    return F.concat_ws(" | ", *[F.concat(F.lit(f"{name}="), value) for name, value in parts])


def literal_list(text: Column | str) -> Column:
    """ARRAY<STRING> of a list literal such as ``[10, 20.0, '30 eV']``; null where it is none.

    Quoted items keep their text, with the escape of a no-break space resolved; a bare number with an exponent is
    written out, as printing the parsed number would.
    """
    body = F.regexp_extract(_col(text), r"^\s*\[(.*)\]\s*$", 1)
    items = F.regexp_extract_all(body, F.lit(r"""('(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^,\s]+)"""), F.lit(1))

    def value(x: Column) -> Column:
        quoted = x.rlike("^['\"]")
        inner = F.replace(F.substring(x, F.lit(2), F.length(x) - 2), F.lit(r"\xa0"), F.lit("\u00a0"))
        return F.when(quoted, inner).when(x.rlike("^[0-9.]+[eE][+-]?[0-9]+$"), x.try_cast("double").cast("string")).otherwise(x)

    return F.when(_col(text).rlike(r"^\s*\[.*\]\s*$"), F.transform(items, value))


def edge_label(low: float, high: float) -> str:
    return f"[{low:g},{high:g})"


def bucket_label(value: Column | str, edges: Sequence[float]) -> Column:
    """The half-open bucket that holds a value; edges are closed by minus and plus infinity."""
    bounds = [-math.inf, *edges, math.inf]
    out = F.when(_col(value).isNull(), None)
    for low, high in zip(bounds, bounds[1:]):
        out = out.when((_col(value) >= F.lit(low)) & (_col(value) < F.lit(high)), edge_label(low, high))
    return out


def mass_bucket(value: Column | str, edges: Sequence[float] = (0.0, 200.0, 300.0, 400.0, 600.0)) -> Column:
    """[low,high) labels from 0 on, the last one open: ``>=600``."""
    out = F.when(_col(value).isNull(), None)
    for low, high in zip(edges, edges[1:]):
        out = out.when((_col(value) >= low) & (_col(value) < high), f"[{low:g},{high:g})")
    return out.when(_col(value) >= edges[-1], f">={edges[-1]:g}")


def huber(difference: Column | str, delta: float = 1.0) -> Column:
    d = F.abs(_col(difference))
    return F.when(d <= delta, d * d / 2.0).otherwise(delta * (d - delta / 2.0))


def sigmoid(x: Column | str) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-_col(x)))


def softplus(x: Column | str) -> Column:
    return F.greatest(_col(x), F.lit(0.0)) + F.log1p(F.exp(-F.abs(_col(x))))


def bce_with_logits(x: Column | str, target: Column | str) -> Column:
    return softplus(x) - _col(x) * _col(target)


def rate_factor(step: Column | str, warmup: int, total: int, floor: float) -> Column:
    """Learning-rate factor: linear warm-up, then a cosine down to floor."""
    warmup = max(1, warmup)
    s = _col(step).cast("double")
    progress = F.least(F.greatest((s - warmup) / max(1.0, float(total - warmup)), F.lit(0.0)), F.lit(1.0))
    if total <= warmup:
        return F.when(s < warmup, (s + 1.0) / warmup).otherwise(floor)
    return F.when(s < warmup, (s + 1.0) / warmup).otherwise(floor + (1.0 - floor) * 0.5 * (1.0 + F.cos(progress * math.pi)))


def decayed_weight(step: Column | str, weight: float, warmup: int, rate: float, period: int) -> Column:
    """A loss weight that holds through the warm-up and then falls by rate per period."""
    after = F.greatest(_col(step).cast("double") - warmup, F.lit(0.0))
    return F.lit(float(weight)) * F.pow(F.lit(float(rate)), after / max(1, period))


def safe_ratio(numerator: Column | str, denominator: Column | str) -> Column:
    return _col(numerator).cast("double") / F.nullif(_col(denominator).cast("double"), F.lit(0.0))
