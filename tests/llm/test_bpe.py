import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from peakloom.llm import bpe

tiktoken = pytest.importorskip("tiktoken")


@pytest.fixture(scope="module")
def own():
    return bpe.encoder(bpe.vocabulary_path())


@pytest.fixture(scope="module")
def other(own):
    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=own.ranks, special_tokens={})


def test_random_alphabets(own, other):
    rng = random.Random(2)
    for letters in ("ab", "abcdefghijklmnopqrstuvwxyz", "aаéß漢🔬", "=-_*# ", " \n\t\xa0"):
        for n in (1, 2, 9, 70, 2000):
            text = "".join(rng.choice(letters) for _ in range(n))
            assert own.encode(text) == other.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80))
def test_any_text_round_trips(text):
    own = bpe.encoder(bpe.vocabulary_path())
    assert own.decode(own.encode(text)) == text.encode()


def test_long_pretoken(own, other):
    text = "".join(random.Random(1).choice("abcdefgh") for _ in range(60_000))
    assert own.encode(text) == other.encode_ordinary(text)


def test_small_caches_change_nothing(other, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_PAIRS", 3)
    monkeypatch.setattr(bpe, "CACHE_TOKENS", 2)
    fresh = bpe.Encoder(bpe.vocabulary_path())
    text = "the fragmentation of protonated molecules, again and again: " + "abcabcaabb" * 50
    assert fresh.encode(text) == other.encode_ordinary(text)


def test_special_strings_are_text(own, other):
    assert own.encode("a<|endoftext|>b") == other.encode_ordinary("a<|endoftext|>b")


def test_queue_order():
    queue = bpe.RankQueue()
    for rank, position in ((7, 3), (40_000, 1), (7, 1), (300, 2), (301, 5)):
        queue.push(rank, position)
    out = []
    while (got := queue.pop())[0] >= 0:
        out.append(got)
    assert out == [(7, [1, 3]), (300, [2]), (301, [5]), (40_000, [1])] and queue.pop() == (-1, [])


def test_columns(spark, own):
    rows = [(1, "peak list", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "word " * 30_000, "x")]
    df = spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING")
    got = [(r.doc_id, r.ids) for r in bpe.encode_column(df, "doc_id", "text").collect()]
    assert sorted(got) == sorted((i, own.encode(t)) for i, t, _ in rows)
    counts = [(r.doc_id, r.n_tokens) for r in bpe.encode_column(df, "doc_id", "text", counts_only=True).collect()]
    assert sorted(counts) == sorted((i, len(x)) for i, x in got)
    assert bpe.encode_column(df.limit(0), "doc_id", "text").count() == 0
