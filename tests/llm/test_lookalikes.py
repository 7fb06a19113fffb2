import itertools
import random
import unicodedata

import pytest

from peakloom.llm import lookalikes
from peakloom.llm.lookalikes import classes, fingerprints, look_alike_pairs, skeleton

ALIKE = [
    ("peak 12", "ｐｅａｋ　１２"), ("naïve", "naïve"), ("base peak", "bаse pеak"), ("sodium", "so​di­um"),
    ("0.5 Å", "0.5 Å"), ("K00-1", "K00-1"), ("µg", "μg"), ("ガス", "ｶﾞｽ"), ("HCOOH", "ΗСООН"), ("a b", "a b"), ("a b", "a b"),
    ("a\nb", "a\r\nb"), ("file", "ﬁle"), ("👩‍🔬 ok", "👩‍🔬⁠ ok"), ("й", "й"), ("[M+H]+", "［M＋H］＋"), ("﻿x", "x"), ("кг", "κг"), ("dıne",
        "dine"), ("ταu", "тαu"), ("ꭺb", "ᴀb"), ("ⲞⲚ", "ON"), ("ⲟⲥ", "oc"), ("ꓡꓲꓢꓴ", "LISU"), ("ſilm", "film"), ("γield", "yield"),
]
APART = [
    ("Peak", "peak"), ("C2", "C₂"), ("m2", "m²"), ("resume", "résumé"), ("ok.", "ok?"), ("10", "1O"), ("1l", "ll"), ("a b", "ab"), ("a  b", "a b"),
    ("👩‍🔬", "👩🔬"), ("⚠️", "⚠"), ("ü", "u"), ("½", "1/2"), ("①", "1"), ("и", "й"), ("фон", "phon"), ("α", "a"), ("'", "\""), ("–", "-"),
        ("ſo", "so"), ("Ι", "l"), ("Ζ", "2"), ("σ", "o"), ("пo", "no"), ("Ꙕ", "O"),
]


@pytest.mark.parametrize("a, b", ALIKE)
def test_alike(a, b):
    assert a != b and skeleton(a) == skeleton(b)


@pytest.mark.parametrize("a, b", APART)
def test_apart(a, b):
    assert skeleton(a) != skeleton(b)


def test_table():
    """Every prototype stands for itself, ASCII stays, and small letters follow their capitals by rule."""
    table = lookalikes.look_alikes()
    assert not any(c.isascii() or len(c) != 1 for c in table) and len(table) > 300
    for prototype in table.values():
        assert skeleton(prototype) == prototype and prototype not in table
    cherokee = {c: p for c, p in table.items() if unicodedata.name(c).startswith("CHEROKEE LETTER")}
    for capital, letter in cherokee.items():
        if letter.isupper():
            assert table[capital.lower()] == lookalikes.small_capital(letter)
    assert sum(c in table for c in map(chr, range(0xA4D0, 0xA4F8))) > 20


def test_file_of_confusables(tmp_path):
    path = tmp_path / "more.txt"
    path.write_text("\ufeff# a comment\n1F7E1 ; 25CF ; MA # two circles\n0031 ; 006C ; MA\n0430 0431 ; 0061 ; MA\n\n", encoding="utf-8")
    assert skeleton("🟡1", str(path)) == "●1" and skeleton("🟡1") == "🟡1" and skeleton("аб", str(path)) == "aб"


def test_generated_recall_of_mixed_words():
    """Words whose letters are swapped for listed look-alikes come back; swapped for others they don't meet by chance."""
    rng = random.Random(14)
    by = {}
    for c, p in lookalikes.look_alikes().items():
        by.setdefault(p, []).append(c)
    words = ["Fragment", "Collision", "spectrum", "Precursor", "YIELD", "axis"]
    for word in words * 40:
        twin = "".join(rng.choice(by.get(c, [c])) if rng.random() < 0.5 else c for c in word)
        assert skeleton(twin) == word
    assert len({skeleton(w) for w in words}) == len(words)


def test_stable_and_null():
    assert skeleton(None) is None and skeleton("") == ""
    for a, _ in ALIKE + APART:
        assert skeleton(skeleton(a)) == skeleton(a)
        for form in ("NFC", "NFD"):
            assert skeleton(unicodedata.normalize(form, a)) == skeleton(a)


def test_pairs_against_brute_force(spark):
    texts = ["peak", "pеak", "ｐeak", "peak", "Peak", None, "", " ", " ", "​", "x" * 50_000, "x" * 49_999 + "ｘ", "alone"]
    rows = list(enumerate(texts))
    df = spark.createDataFrame([(i, t, "z") for i, t in rows], "doc_id BIGINT, text STRING, class STRING").repartition(3)
    want = {
        (i, j) for (i, a), (j, b) in itertools.combinations(rows, 2)
        if a and b and a != b and skeleton(a).strip() and skeleton(a) == skeleton(b)
    }
    assert {tuple(r) for r in look_alike_pairs(df).collect()} == want and len(want) == 6
    forms = fingerprints(df, with_form=True).collect()
    assert len(forms) == len(rows) and sum(r["class"] is None for r in forms) == 5


def test_copies_and_repeated_rows(spark):
    rows = [(i, "stock") for i in range(200)] + [(200, "stоck"), (200, "stоck")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    assert {tuple(r) for r in look_alike_pairs(df).collect()} == {(i, 200) for i in range(200)}
    assert look_alike_pairs(df.limit(0)).count() == 0


def test_hot_class_is_dealt_into_blocks(spark, monkeypatch):
    """A stock text in many guises: pairs come block by block and are the same."""
    rows = [(i, "".join(rng_c if (i >> b) & 1 else "o" for b, rng_c in enumerate("оοօ"))) for i in range(8)] + [(i + 100,
        "ooo") for i in range(30)] + [(200, "other")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    want = {(min(i, j), max(i, j)) for (i, a), (j, b) in itertools.combinations(rows, 2) if a != b and skeleton(a) == skeleton(b)}
    for block in (512, 3, 1):
        monkeypatch.setattr(lookalikes, "PAIR_BLOCK", block)
        assert {tuple(r) for r in look_alike_pairs(df).collect()} == want
    sizes = {r.doc_id: (r.texts, r.members) for r in classes(df).collect()}
    assert sizes[0] == sizes[100] == (8, 38) and sizes[200] == (1, 1)
