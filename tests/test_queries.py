import importlib
import math
import sys

import duckdb
import pytest

from recordloom import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
#: Slow to plan; the driver compares them, and the operators have tests of their own.
LONG = {"extract_records", "extracted_events", "infer_mapping", "coerce_values"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("set timezone = 'UTC'")
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def same(a, b):
    if isinstance(a, float) and isinstance(b, (float, int)):
        return a == b or (math.isnan(a) and b is None) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9)
    return a == b


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - LONG))
def test_against_sql(spark, duck, name):
    got = queries.QUERIES[name](spark, SF)
    want = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = sorted(got.columns)
    key = lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    a = sorted((tuple(r[c] for c in order) for r in got.collect()), key=key)
    at = [want.columns.index(c) for c in order]
    b = sorted((tuple(r[i] for i in at) for r in want.fetchall()), key=key)
    assert len(a) == len(b)
    assert all(same(x, y) for r, s in zip(a, b) for x, y in zip(r, s))


def test_the_rest_imports_without_the_optional_parts(monkeypatch):
    for gone in ("corpus_pipeline", "recordloom.llm", "recordloom.llm.queries"):
        monkeypatch.setitem(sys.modules, gone, None)
    import __spark_entry__

    entry = importlib.reload(__spark_entry__)
    assert set(entry.queries()) == set(queries.QUERIES) and set(entry.oracle_sql()) <= set(entry.queries())
