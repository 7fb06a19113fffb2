"""Formula algebra as Column expressions over MAP<STRING,INT>; nothing here leaves the JVM."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from peakloom.functions.elements import ELEMENTS, ION_CHANNELS, MASSES

#: Symbols by the sign of their valence in the double-bond equivalent.
FOUR_BONDS, THREE_BONDS, ONE_BOND = ("C", "Si"), ("N", "P"), ("H", "F", "Cl", "Br", "I", "Na", "K")
#: Bounds of the count vocabulary.
MAX_COUNT, MAX_ELEMENTS = 512, 32
#: Counts of an element above this aren't read, so that sums and differences of counts fit an INT.
READABLE_COUNT = 1_000_000
#: Products of counts stop growing above this.
_MANY = 2**31


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _symbols(values: Iterable[str]) -> Column:
    """ARRAY<STRING> of plain words, as one expression: a call to the JVM per word would dominate planning."""
    return F.expr("array(" + ", ".join(f"'{v}'" for v in values) + ")")


def _numbers(values: dict[str, float | int]) -> Column:
    """MAP from plain words to numbers, as one expression."""
    return F.expr("map(" + ", ".join(f"'{k}', {v!r}" + ("D" if isinstance(v, float) else "") for k, v in values.items()) + ")")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, with value evaluated once: higher-order functions take no part in common-subexpression elimination."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_SYMBOL, _COUNT = "([A-Z][a-z]?)[0-9]*", "[A-Z][a-z]?([0-9]*)"


#: Elements in the order of a look-up that runs through a list: those of organic molecules first.
_USUAL_FIRST = tuple(dict.fromkeys(("C", "H", "N", "O", "S", "P", "F", "Cl", "Br", "I", "Na", "K", "Si", *ELEMENTS)))


def _shape(text: Column) -> Column:
    """Whether a text looks like a formula: a lower-case letter can only belong to the capital before it, so it is cut in one way."""
    return text.rlike(r"^([A-Z][a-z]?(0*[1-9][0-9]*)?)+\z")


def _real(symbols: Column) -> Column:
    return F.forall(symbols, lambda s: F.array_contains(_symbols(_USUAL_FIRST), s))


def is_formula(text: Column | str) -> Column:
    """Wholly element symbols with optional counts of at least 1; false for null."""
    text = _col(text)
    return F.coalesce(_shape(text) & _real(F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(1))), F.lit(False))


def _pairs(text: Column) -> Column:
    """ARRAY of (symbol s, count n BIGINT) of a text of that shape, in its order; a count beyond BIGINT is null."""
    symbols = F.regexp_extract_all(text, F.lit(_SYMBOL), F.lit(1))
    counts = F.regexp_extract_all(text, F.lit(_COUNT), F.lit(1))
    numbers = F.transform(counts, lambda c: F.when(c == "", F.lit(1).cast("bigint")).otherwise(c.try_cast("bigint")))
    return F.arrays_zip(symbols.alias("s"), numbers.alias("n"))


def _summed(pairs: Column) -> Column:
    """pairs with one entry per symbol."""
    distinct = F.array_distinct(pairs["s"])

    def total(s: Column) -> Column:
        # A count beyond the readable ones stands for all such: sums can't overflow.
        add = lambda acc, p: acc + F.when(p["s"] == s, F.least(p["n"], F.lit(2**32))).otherwise(0)
        return F.struct(s.alias("s"), F.aggregate(pairs, F.lit(0).cast("bigint"), add).alias("n"))

    return F.when(F.size(distinct) == F.size(pairs), pairs).otherwise(F.transform(distinct, total))


def _readable(pairs: Column) -> Column:
    return F.forall(pairs, lambda p: F.coalesce(p["n"] <= READABLE_COUNT, F.lit(False)))


def parse_formula(text: Column | str, strict: bool = False) -> Column:
    """MAP of element counts; repeated symbols add up. Not a formula, or an element counted more than
    ``READABLE_COUNT`` times: null (``formula_problem`` tells which), or an error if strict.
    """
    text = _col(text)
    whole = lambda p: F.when(_readable(p), F.map_from_arrays(p["s"], F.transform(p["n"], lambda n: n.cast("int"))))
    found = F.when(_shape(text), let(_pairs(text), lambda p: F.when(_real(p["s"]), let(_summed(p), whole))))
    if not strict:
        return found
    return F.coalesce(found, F.raise_error(F.concat(F.lit("not a formula: "), F.coalesce(text, F.lit("null")))).cast("map<string,int>"))


def formula_problem(text: Column | str) -> Column:
    """Why parse_formula gives null: ``not_a_formula`` or ``count_out_of_range``; null where it doesn't."""
    text = _col(text)
    return F.when(~is_formula(text), "not_a_formula").when(~let(_pairs(text), lambda p: let(_summed(p), _readable)), "count_out_of_range")


def count(counts: Column | str, symbol: str) -> Column:
    return F.coalesce(F.element_at(_col(counts), symbol), F.lit(0))


def hill(counts: Column | str) -> Column:
    """Carbon, hydrogen, then alphabetical; without carbon all alphabetical. Zeros and counts of 1 aren't written."""

    def write(kept: Column) -> Column:
        carbon = F.map_contains_key(kept, "C")

        def place(symbol: Column) -> Column:
            return F.when(carbon & (symbol == "C"), 0).when(carbon & (symbol == "H"), 1).otherwise(2)

        entries = F.transform(F.map_entries(kept), lambda e: F.struct(place(e["key"]).alias("place"), e["key"].alias("symbol"), e["value"].alias("n")))
        return F.array_join(F.transform(F.array_sort(entries), lambda e: F.concat(e["symbol"], F.when(e["n"] == 1, "").otherwise(e["n"].cast("string")))), "")

    return let(F.map_filter(_col(counts), lambda _, n: n > 0), write)


def element_mass(symbol: Column | str) -> Column:
    """Mass of the most common isotope, null for what is no element."""
    masses = {s: MASSES[s] for s in _USUAL_FIRST}
    return F.element_at(_numbers(masses), _col(symbol))


def atomic_number(symbol: Column | str) -> Column:
    position = F.array_position(_symbols(ELEMENTS), _col(symbol))
    return F.when(position > 0, position.cast("int"))


def element_symbol(number: Column | str) -> Column:
    n = _col(number).cast("int")
    return F.when(n.between(1, len(ELEMENTS)), F.element_at(_symbols(ELEMENTS), n))


def mass(counts: Column | str) -> Column:
    """Sum of count times mass in alphabetical order of the symbols, so that equal maps give equal doubles."""
    entries = F.array_sort(F.map_entries(_col(counts)))
    return F.aggregate(entries, F.lit(0.0), lambda acc, e: acc + e["value"].cast("double") * element_mass(e["key"]))


def _total(counts: Column | str, symbols: tuple[str, ...]) -> Column:
    out = count(counts, symbols[0])
    for s in symbols[1:]:
        out = out + count(counts, s)
    return out


def rdbe(counts: Column | str) -> Column:
    """Rings and double bonds."""
    four, three, one = (_total(counts, s).cast("double") for s in (FOUR_BONDS, THREE_BONDS, ONE_BOND))
    return four - one / 2.0 + three / 2.0 + 1.0


def hydrogen_excess(counts: Column | str) -> Column:
    """Monovalent atoms beyond what the others can bind; at most 0 in a possible molecule."""
    return _total(counts, ONE_BOND) - (2 * _total(counts, FOUR_BONDS) + 2 + _total(counts, THREE_BONDS))


def is_plausible(counts: Column | str) -> Column:
    return (rdbe(counts) >= 0) & (hydrogen_excess(counts) <= 0)


def valence_flags(counts: Column | str, precursor: Column | str) -> Column:
    """Five flags of a fragment; unsaturation beyond the precursor's by more than 1 is the soft one."""
    r = rdbe(counts)
    negative, excess, above = r < 0, hydrogen_excess(counts) > 0, r > rdbe(precursor) + 1.0
    return F.struct(
        negative.alias("negative_rdbe"), excess.alias("hydrogen_excess"), above.alias("above_precursor"),
        (negative | excess).alias("hard"), (negative | excess | above).alias("any"),
    )


def subtract(whole: Column | str, part: Column | str) -> Column:
    """Element-wise difference of two maps; absent elements count as 0."""
    return F.map_zip_with(_col(whole), _col(part), lambda _, a, b: F.coalesce(a, F.lit(0)) - F.coalesce(b, F.lit(0)))


def neutral_loss(precursor: Column | str, fragment: Column | str) -> Column:
    """Hill string of precursor less fragment: null if the fragment holds more, [M] if nothing is left."""

    def write(rest: Column) -> Column:
        text = let(hill(rest), lambda t: F.when(t == "", "[M]").otherwise(t))
        return F.when(~F.exists(F.map_values(rest), lambda n: n < 0), text)

    return let(subtract(precursor, fragment), write)


def distance(a: Column | str, b: Column | str) -> Column:
    """Sum of absolute count differences."""
    return F.aggregate(F.map_values(subtract(a, b)), F.lit(0), lambda acc, n: acc + F.abs(n))


def subformulas(counts: Column | str) -> Column:
    """How many subformulas a formula has, itself and the empty one included; above 2**31 a lower bound."""
    return F.aggregate(F.map_values(_col(counts)), F.lit(1).cast("bigint"), lambda acc, n: F.when(acc > _MANY, acc).otherwise(acc * (n + 1)))


def heavy_subformulas(counts: Column | str) -> Column:
    return subformulas(F.map_filter(_col(counts), lambda s, _: s != "H"))


def count_guard(counts: Column | str) -> Column:
    """Whether the counts fit the count vocabulary: 1 to 32 elements, each from 1 to 512."""
    values = F.map_values(_col(counts))
    return F.size(values).between(1, MAX_ELEMENTS) & F.forall(values, lambda n: n.between(1, MAX_COUNT))


def by_atomic_number(counts: Column | str) -> Column:
    """ARRAY of (symbol, n) in order of atomic number: the element axis of a precursor."""
    entries = F.transform(F.map_entries(_col(counts)), lambda e: F.struct(atomic_number(e["key"]).alias("z"), e["key"].alias("symbol"), e["value"].alias("n")))
    return F.transform(F.array_sort(entries), lambda e: F.struct(e["symbol"].alias("symbol"), e["n"].alias("n")))


def charge_sign(adduct: Column | str) -> Column:
    """+1 or -1; null where the adduct isn't singly charged or can't be read."""
    text = F.trim(_col(adduct))
    digits = F.regexp_extract(text, r"([0-9]*)\s*[+-]\z", 1)
    single = text.rlike(r"(^|[^+-])[+-]\z") & ((digits == "") | (digits.try_cast("int") == 1))
    return F.when(F.coalesce(single, F.lit(False)), F.when(text.endswith("+"), 1).otherwise(-1))


def ion_channels(adduct: Column | str, strict: bool = False) -> Column:
    """ARRAY of channel names to search for an adduct; null (or an error if strict) for an unsupported charge."""
    sign = charge_sign(adduct)
    tokens = F.regexp_extract_all(_col(adduct), F.lit("([A-Z][a-z]?)"), F.lit(1))
    has = lambda s: F.array_contains(tokens, s)
    names = F.array(
        F.when(sign > 0, "protonated").otherwise("deprotonated"),
        F.when(has("Na"), "sodiated"),
        F.when(has("K"), "potassiated"),
        F.when((sign < 0) & has("Cl"), "chloride_retained"),
    )
    bad = F.raise_error(F.concat(F.lit("unsupported charge: "), F.coalesce(_col(adduct), F.lit("null")))) if strict else F.lit(None)
    return F.when(sign.isNotNull(), F.array_compact(names)).otherwise(bad)


def channel_offset(name: Column | str) -> Column:
    return F.element_at(_numbers({n: float(m) for n, _, _, m in ION_CHANNELS}), _col(name))


def channel_index(name: Column | str) -> Column:
    return F.element_at(_numbers({n: i for n, i, _, _ in ION_CHANNELS}), _col(name))


def is_admissible(name: Column | str, adduct: Column | str) -> Column:
    return F.array_contains(ion_channels(adduct), _col(name))


def is_decodable(counts: Column | str, precursor: Column | str) -> Column:
    """Whether a decoded formula keeps the decoder's constraints: no count above the precursor's, and not empty."""
    inside = ~F.exists(F.map_values(subtract(precursor, counts)), lambda n: n < 0)
    return inside & F.exists(F.map_values(_col(counts)), lambda n: n > 0)
