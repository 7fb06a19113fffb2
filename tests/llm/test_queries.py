"""The pipeline queries against their SQL on the smallest tables, and against plain checks where SQL has no say."""

import math
import os
from collections import defaultdict

import pytest

duckdb = pytest.importorskip("duckdb")
DATA = os.environ.get("PEAKLOOM_TESTDATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables aren't there")

from peakloom.llm import queries  # noqa: E402
from peakloom.llm.lookalikes import skeleton  # noqa: E402


def read(name, columns="*"):
    return duckdb.sql(f"SELECT {columns} FROM '{DATA}/{name}.parquet'").fetchall()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for file in os.listdir(DATA):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{file}'")
    df = queries.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    result = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in result.description]
    at = [names.index(c) for c in columns]
    assert sorted(names) == columns
    assert sorted(repr(tuple(r)) for r in df.select(*columns).collect()) == sorted(repr(tuple(r[i] for i in at)) for r in result.fetchall())


def test_splits_hold_groups_together(spark):
    rows = queries.QUERIES["p4_splits"](spark, DATA).collect()
    assert len(rows) == len(read("spectra_v2", "1"))
    by = defaultdict(set)
    for r in rows:
        by[r.parent_spec].add(r.split)
    assert all(len(s) == 1 for s in by.values()) and {r.split for r in rows} == {"train", "valid", "test"}


def test_containers_hold_every_token(spark):
    ids = {r.doc_id: len(r.ids) for r in queries.QUERIES["p7_ids"](spark, DATA).collect()}
    assert set(ids) == {i for (i,) in read("documents", "doc_id")}
    load, got = defaultdict(int), defaultdict(int)
    for r in queries.QUERIES["p8_containers"](spark, DATA).collect():
        load[r.container_id] += r.n_tokens
        got[r.doc_id] += r.n_tokens
    assert max(load.values()) <= 1024 and got == ids
    assert math.isclose(queries.QUERIES["p8_usage"](spark, DATA).first().tokens, sum(ids.values()))


def test_look_alikes_against_brute_force(spark):
    by = defaultdict(list)
    for i, t in read("documents", "doc_id, text"):
        if t is not None and skeleton(t).strip():
            by[skeleton(t)].append((i, t))
    want = {(min(i, j), max(i, j)) for own in by.values() for i, t in own for j, s in own if t != s}
    assert {tuple(r) for r in queries.QUERIES["p9_found"](spark, DATA).collect()} == want
    forms = {r.doc_id: r.form for r in queries.QUERIES["p9_forms"](spark, DATA).collect()}
    assert len(forms) == len(read("documents", "1")) and all(forms[i] == s for s, own in by.items() for i, _ in own)
