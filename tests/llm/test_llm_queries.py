import math
import re

import duckdb
import pytest

from recordloom.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    got, want = queries.QUERIES[name](spark, SF), c.sql(queries.ORACLE_SQL[name])
    order = sorted(got.columns)
    assert order == sorted(want.columns)
    a = sorted(tuple(r[x] for x in order) for r in got.collect())
    b = sorted(tuple(r[want.columns.index(x)] for x in order) for r in want.fetchall())
    assert len(a) == len(b)
    for r, s in zip(a, b):
        assert all(math.isclose(x, y, rel_tol=1e-12) if isinstance(x, float) else x == y for x, y in zip(r, s))


def test_chat_runs_no_python(spark):
    text = queries.QUERIES["op7_chat"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|ArrowEval|Cartesian", text)


def test_every_operator_has_one_query():
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES) == list(range(1, 14))
