"""Quantities written as text: a number grammar, a unit grammar and dimension vectors.

A text is read in three steps. The lexer splits it into numbers, words and a few signs; any other
character makes the text invalid. The number rule wants exactly one finite number. The unit rule

    unit   := factor (("*" | "." | "/" | "per") factor)*
    factor := symbol ["^" integer]

gives a scale, an offset and a vector of exponents over the base dimensions in ``BASES``. Two units
can be converted into one another if their vectors are equal, or if the missing exponents are
supplied by *contexts*: a voltage becomes an energy by a charge, a molar energy by one molecule, a
normalised collision energy by a precursor m/z.

Everything here is plain Python and runs once per *distinct* text of an Arrow batch.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field

#: mass, length, time, current, temperature, amount, charge-number carrier, m/z normalisation
BASES = ("M", "L", "T", "I", "K", "N", "Q", "Z")
Vector = tuple[int, ...]


def vector(**exponents: int) -> Vector:
    return tuple(exponents.get(b, 0) for b in BASES)


def add(a: Vector, b: Vector, times: int = 1) -> Vector:
    return tuple(x + times * y for x, y in zip(a, b))


NONE = vector()
ENERGY = vector(M=1, L=2, T=-2)
TEMPERATURE = vector(K=1)
#: Energy per elementary charge, as a collision voltage gives it.
POTENTIAL = add(ENERGY, vector(Q=1), -1)
#: Energy per unit of m/z, as a normalised collision energy gives it.
NORMALISED = add(ENERGY, vector(Z=1), -1)

# Exact SI constants.
ELEMENTARY_CHARGE = 1.602176634e-19
AVOGADRO = 6.02214076e23


@dataclass(frozen=True)
class Unit:
    """canonical value = number * scale + offset, in SI (joule for energies)."""

    code: str
    scale: float
    dims: Vector
    offset: float = 0.0


# Unit symbols and names, decimal prefixes.
SYMBOLS = {
    "eV": Unit("eV", ELEMENTARY_CHARGE, ENERGY),
    "V": Unit("V", ELEMENTARY_CHARGE, POTENTIAL),
    "J": Unit("J", 1.0, ENERGY),
    "cal": Unit("cal", 4.184, ENERGY),
    "mol": Unit("mol", AVOGADRO, vector(N=1)),
    "K": Unit("K", 1.0, TEMPERATURE),
    "degC": Unit("degC", 1.0, TEMPERATURE, 273.15),
    "degF": Unit("degF", 5.0 / 9.0, TEMPERATURE, 459.67 * 5.0 / 9.0),
    "g": Unit("g", 1e-3, vector(M=1)),
    "m": Unit("m", 1.0, vector(L=1)),
    "s": Unit("s", 1.0, vector(T=1)),
    "min": Unit("min", 60.0, vector(T=1)),
    "h": Unit("h", 3600.0, vector(T=1)),
    "L": Unit("L", 1e-3, vector(L=3)),
    "Pa": Unit("Pa", 1.0, vector(M=1, L=-1, T=-2)),
    "bar": Unit("bar", 1e5, vector(M=1, L=-1, T=-2)),
}
NAMES = {
    "electronvolt": "eV", "electronvolts": "eV", "volt": "V", "volts": "V", "joule": "J", "joules": "J",
    "calorie": "cal", "calories": "cal", "mole": "mol", "kelvin": "K", "celsius": "degC", "fahrenheit": "degF",
    "gram": "g", "grams": "g", "metre": "m", "meter": "m", "second": "s", "seconds": "s", "minute": "min",
    "minutes": "min", "hour": "h", "hours": "h", "litre": "L", "liter": "L", "pascal": "Pa",
}
PREFIXES = {"G": 1e9, "M": 1e6, "k": 1e3, "m": 1e-3, "u": 1e-6, "µ": 1e-6, "μ": 1e-6, "n": 1e-9, "p": 1e-12}
PREFIX_NAMES = {"giga": "G", "mega": "M", "kilo": "k", "milli": "m", "micro": "µ", "nano": "n", "pico": "p"}
#: Words that name the quantity or the kind of dissociation and carry no unit.
QUANTITY_WORDS = {"ce", "collision", "energy", "voltage", "potential", "lab", "at", "of", "as"}
DISSOCIATION_WORDS = {
    "cid", "hcd", "cad", "etd", "ecd", "ethcd", "etcid", "ead", "eid", "exd", "sid", "pqd", "irmpd", "uvpd", "bird",
    "beam", "type", "trap", "resonance", "dissociation", "induced", "higher",
}
NORMALISED_WORDS = {"nce", "normalised", "normalized", "norm"}
FRACTION_WORDS = {"fraction", "fractional", "frac"}
PERCENT_WORDS = {"%", "percent", "pct"}

_TOKEN = re.compile(
    r"(?P<number>(?:[0-9]+(?:[.,][0-9]+)?|[.,][0-9]+|[0-9]+\.(?![0-9.]))(?:[eE][+-]?[0-9]+)?(?![.,]?[0-9]))"
    r"|(?P<word>[^\W\d_]+)|(?P<sign>[+\-−])|(?P<mark>[%/*·^=:(),;_])|(?P<blank>\s+)"
)
NOT_A_QUANTITY = "not_a_quantity"
VALID, BLANK = "valid", "blank"


@dataclass(frozen=True)
class Quantity:
    """status: valid, blank or not_a_quantity; unit None: a bare number."""

    status: str
    number: float | None = None
    unit: Unit | None = None


def lex(text: str) -> list[tuple[str, str, int]] | None:
    """(kind, text, start) of each token without blanks, or None if a character fits no token."""
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None:
            return None
        if m.lastgroup != "blank":
            out.append((m.lastgroup, m.group(), at))
        at = m.end()
    return out


def symbol(word: str) -> Unit | None:
    """A unit symbol or name with an optional decimal prefix; letter case decides only where it must."""
    low = word.lower()

    def find(body: str, exact: bool) -> Unit | None:
        if body in SYMBOLS:
            return SYMBOLS[body]
        if exact:
            return None
        if body.lower() in NAMES:
            return SYMBOLS[NAMES[body.lower()]]
        hits = [u for s, u in SYMBOLS.items() if s.lower() == body.lower()]
        return hits[0] if len(hits) == 1 else None

    for exact in (True, False):
        if (unit := find(word, exact)) is not None:
            return unit
        for prefix, factor in PREFIXES.items():
            starts = word.startswith(prefix) if exact else low.startswith(prefix.lower())
            if starts and len(word) > len(prefix):
                base = find(word[len(prefix) :], exact)
                if base is not None and not base.offset and base.code not in ("min", "h", "degF", "degC"):
                    return Unit(prefix + base.code, factor * base.scale, base.dims)
    for name, prefix in PREFIX_NAMES.items():
        if low.startswith(name) and low[len(name) :] in NAMES:
            base = SYMBOLS[NAMES[low[len(name) :]]]
            return Unit(prefix + base.code, PREFIXES[prefix] * base.scale, base.dims)
    return None


def unit_of(tokens: list[tuple[str, str]]) -> Unit | None:
    """The unit rule over (kind, text) tokens; None where they don't make one unit."""
    code, scale, offset, dims, sign, at, n = "", 1.0, 0.0, NONE, 1, 0, 0
    while at < len(tokens):
        kind, text = tokens[at]
        unit = symbol(text) if kind == "word" else None
        if unit is None:
            return None
        at += 1
        power = 1
        if at + 1 < len(tokens) and tokens[at][1] == "^":
            power_text = "".join(t for _, t in tokens[at + 1 : at + 3] if t in "+-" or t.isdigit())
            if not re.fullmatch(r"[+-]?[0-9]+", power_text):
                return None
            power = int(power_text)
            at += 1 + (2 if power_text[0] in "+-" else 1)
        power *= sign
        code += ("/" if sign < 0 else "*" if code else "") + unit.code + (f"^{abs(power)}" if abs(power) != 1 else "")
        scale *= unit.scale**power
        dims = add(dims, unit.dims, power)
        offset, n = unit.offset, n + 1
        if at == len(tokens):
            break
        mark = tokens[at][1].lower()
        if mark not in ("/", "per", "*", "·"):
            return None
        sign = -1 if mark in ("/", "per") else 1
        at += 1
        if at == len(tokens):
            return None
    if not n:
        return None
    return Unit(code, scale, dims, offset if n == 1 and sign == 1 else 0.0)


PERCENT_NORMALISED = Unit("NCE", ELEMENTARY_CHARGE / 500.0, NORMALISED)
FRACTION_NORMALISED = Unit("NCE_frac", ELEMENTARY_CHARGE / 5.0, NORMALISED)


def parse_quantity(text: str | None) -> Quantity:
    """Read one quantity.

    Null and blank texts are ``blank``. ``not_a_quantity``: no number or several, a negative or
    not finite one, an unknown word, two units, or signs that the grammar lacks. A comma inside a
    number is a decimal mark. A percentage without further words is a normalised energy.
    """
    if text is None or not text.strip():
        return Quantity(BLANK)
    bad = Quantity(NOT_A_QUANTITY)
    tokens = lex(text)
    if tokens is None:
        return bad
    numbers = [i for i, t in enumerate(tokens) if t[0] == "number" and not (i and tokens[i - 1][1] == "^") and not (i > 1 and tokens[i - 2][1] == "^" and tokens[i - 1][0] == "sign")]
    if len(numbers) != 1:
        return bad
    at = numbers[0]
    before, after = tokens[:at], tokens[at + 1 :]
    negative = False
    if before and before[-1][0] == "sign":
        if before[-1][2] + 1 != tokens[at][2] or (len(before) > 1 and before[-2][0] in ("number", "sign")):
            return bad
        negative = before[-1][1] != "+"
        before = before[:-1]
    number = float(tokens[at][1].replace(",", "."))
    if not math.isfinite(number) or (negative and number != 0):
        return bad
    # The words around the number: unit words on one side, the rest names the quantity.
    unit_tokens: list[tuple[str, str]] = []
    normalised = fraction = percent = False
    ended = False
    for side in (before, after):
        for i, (kind, word, _) in enumerate(side):
            low = word.lower()
            if kind == "mark" and low in "=:(),;_":
                ended = ended or bool(unit_tokens)
            elif kind == "mark" and low == "%":
                percent = True
            elif low in NORMALISED_WORDS:
                normalised, ended = True, ended or bool(unit_tokens)
            elif low in FRACTION_WORDS:
                fraction, ended = True, ended or bool(unit_tokens)
            elif low in PERCENT_WORDS:
                percent, ended = True, ended or bool(unit_tokens)
            elif low in QUANTITY_WORDS or low in DISSOCIATION_WORDS:
                ended = ended or bool(unit_tokens)
            elif kind == "sign" and not (unit_tokens and unit_tokens[-1][1] == "^"):
                return bad
            else:
                if ended:
                    return bad  # a second unit, or an unknown word after the unit
                unit_tokens.append((kind, low if kind == "mark" else word))
        ended = bool(unit_tokens)
    if normalised or percent or fraction:
        if unit_tokens or (fraction and (percent or not normalised)):
            return bad
        return Quantity(VALID, number, FRACTION_NORMALISED if fraction else PERCENT_NORMALISED)
    if not unit_tokens:
        return Quantity(VALID, number, None)
    unit = unit_of(unit_tokens)
    return bad if unit is None else Quantity(VALID, number, unit)


@dataclass
class Registry:
    """Canonical dimension and contexts that supply missing exponents.

    ``contexts`` maps a base to the SI factor that one unit of it contributes (one
    molecule counts as 1). Bases in ``per_row`` are supplied by a column of the row instead, as m/z is.
    """

    target: Unit
    contexts: dict[str, float] = field(default_factory=dict)
    per_row: dict[str, float] = field(default_factory=dict)

    def plan(self, unit: Unit) -> tuple[float, float, dict[str, int]] | None:
        """(scale, offset, exponents that the row must supply) from unit to the target, or None."""
        scale, need = unit.scale, {}
        for base, have, want in zip(BASES, unit.dims, self.target.dims):
            if have == want:
                continue
            if base in self.contexts:
                scale *= self.contexts[base] ** (want - have)
            elif base in self.per_row:
                need[base] = want - have
            else:
                return None
        return scale / self.target.scale, (unit.offset - self.target.offset) / self.target.scale, need


#: Energies in eV of one singly charged molecule; the row's precursor m/z supplies Z.
ENERGY_IN_EV = Registry(SYMBOLS["eV"], contexts={"N": 1.0, "Q": 1.0}, per_row={"Z": 1.0})


def convert(number: float, unit: Unit, registry: Registry, **row: float | None) -> float | None:
    """number in unit, in the registry's target unit; None if the dimensions or the row's values don't allow it."""
    plan = registry.plan(unit)
    if plan is None:
        return None
    scale, offset, need = plan
    value = number * scale + offset
    for base, power in need.items():
        if row.get(base) is None:
            return None
        value *= row[base] ** power
    return value
