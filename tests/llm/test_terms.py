import random
from collections import Counter

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from peakloom.llm import terms

SCHEMA = "uid STRING, a ARRAY<STRING>, b ARRAY<STRING>"


def brute(records, n):
    occurrences, held = Counter(), Counter()
    for record in records:
        own = Counter()
        for i in range(len(record or []) - n + 1):
            gram = tuple(record[i : i + n])
            if all(gram):
                own[gram] += 1
        occurrences.update(own)
        held.update(dict.fromkeys(own, 1))
    return {g: (c, held[g]) for g, c in occurrences.items()}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.lists(st.sampled_from(["x", "y", "z", "", None]), max_size=12)), max_size=12))
def test_block_against_brute_force(records):
    lists = pa.array(records, pa.list_(pa.string()))
    for n, (grams, occurrences, held) in zip((1, 2, 3, 5), terms.block_counts(lists, (1, 2, 3, 5))):
        assert {tuple(g): (int(o), int(h)) for g, o, h in zip(grams, occurrences, held)} == brute(records, n)


def test_suffix_array_is_sorted():
    rng = random.Random(1)
    codes = np.array([rng.randrange(2) for _ in range(300)])
    array = terms.SuffixArray(codes, np.repeat(np.arange(3), 100))
    suffixes = [codes[i : i + array.left[i]].tolist() for i in array.order]
    assert suffixes == sorted(suffixes)
    for x, y, common in zip(suffixes, suffixes[1:], array.common):
        k = next((k for k, (p, q) in enumerate(zip(x, y)) if p != q), min(len(x), len(y)))
        assert k == common


def rows(spark, data, **options):
    df = spark.createDataFrame(data, SCHEMA)
    out = terms.term_frequencies(df, "uid", ["a", "b"], (1, 2), **options).collect()
    return {(r.field_name, tuple(r.gram)): (r.occurrences, r.records) for r in out}


def test_repeated_rows_nulls_and_blocks(spark):
    data = [("1", ["p", "p", "q"], None), ("1", ["p", "p", "q"], None), ("2", ["p", None, "q", ""], []), (None, ["p"], ["r"])]
    expected = {
        ("a", ("p",)): (4, 3), ("a", ("q",)): (2, 2), ("a", ("p", "p")): (1, 1), ("a", ("p", "q")): (1, 1), ("b", ("r",)): (1, 1),
    }
    assert rows(spark, data) == expected
    assert rows(spark, data, block_terms=1) == expected
    assert rows(spark, data * 3, block_terms=2, depth=2) == expected


def test_empty_table_and_long_record(spark):
    assert rows(spark, []) == {}
    out = rows(spark, [("1", ["a", "b"] * 20_000, None)])
    assert out[("a", ("a", "b"))] == (20_000, 1) and out[("a", ("b", "a"))] == (19_999, 1)


def test_marks(spark):
    df = spark.createDataFrame([("f", ["t"], 9, n) for n in (2, 3, 5, 6)], "field_name STRING, gram ARRAY<STRING>, occurrences BIGINT, records BIGINT")
    marks = {r.records: r.mark for r in terms.mark_terms(df, 100).collect()}
    assert marks == {2: "rare", 3: None, 5: None, 6: "common"}
    assert terms.mark_terms(df, 10).where(F.col("records") == 2).first().mark == "rare"
