"""Helpers of several test modules: formulas drawn at random and what follows from their counts by plain arithmetic."""

import random

VALENCE = {"C": 4, "Si": 4, "N": 3, "P": 3, "H": 1, "F": 1, "Cl": 1, "Br": 1, "I": 1, "Na": 1, "K": 1, "O": 2, "S": 2}


def draw(rng: random.Random, symbols=("C", "H", "N", "O", "S", "Cl"), most=9, repeat=0.2):
    """(text, counts) of a random formula; symbols may be repeated, in any order, with counts of 1 written or not."""
    text, counts = "", {}
    for s in rng.sample(symbols, rng.randint(1, len(symbols))) + ([rng.choice(symbols)] if rng.random() < repeat else []):
        n = rng.randint(1, most)
        counts[s] = counts.get(s, 0) + n
        text += s + ("" if n == 1 and rng.random() < 0.7 else "0" * rng.randint(0, 1) + str(n))
    return text, counts


def rings(counts):
    """Rings and double bonds as edges less vertices of the bond graph, plus one."""
    return sum(VALENCE[s] * n for s, n in counts.items()) / 2 - sum(counts.values()) + 1


def spare(counts):
    """Monovalent atoms beyond the free places of a tree of all others."""
    inner = {s: n for s, n in counts.items() if VALENCE[s] > 1}
    places = sum(VALENCE[s] * n for s, n in inner.items()) - 2 * (sum(inner.values()) - 1)
    return sum(n for s, n in counts.items() if VALENCE[s] == 1) - places


def plausible(counts):
    return rings(counts) >= 0 and spare(counts) <= 0


def hill(counts):
    first = ["C", "H"] if counts.get("C") else []
    order = [s for s in first if counts.get(s)] + sorted(s for s, n in counts.items() if n and s not in first)
    return "".join(s + (str(counts[s]) if counts[s] != 1 else "") for s in order)
