import pytest
from pyspark.sql import functions as F

from recordloom import sql
from recordloom.functions import places, similarity, text, values
from recordloom.sources import formats

DOCS = [
    ("a", "", '{"rows":[{"x":1,"y":"b"},{"x":2,"z":[1,2]}]}'), ("b", "text/csv", "k,v\n1,2\n3,4"), ("c", "", "hello"), ("d", "", None), ("e", "", ""), ("f", "application/json", "{not json"),
    ("g", "", "<table><tr><th>A</th></tr><tr><td>1</td></tr></table>"), ("h", "", '{"a": {"a": ' * 70 + "1" + "}}" * 70),
]
VALUES = ["", None, "Héllo  World-42", "$1,200.50", "(3.10)", "2024-02-30", "3/4/2021", "12 Main Street Apt 4", "100 block of Main St", "P-00 12", "1e5", "0x1F", "1e400", "a@b.co", "Infinity", "it's", "back\\slash"]


@pytest.fixture(scope="module")
def session(spark):
    sql.register(spark)
    sql.register(spark)
    return spark


@pytest.mark.parametrize("name", sorted(sql.FUNCTIONS))
def test_functions_equal_the_column_expressions(session, name):
    arguments, use = sql.FUNCTIONS[name]
    rows = [tuple(VALUES[(i + 3 * j) % len(VALUES)] for j in range(len(arguments))) for i in range(len(VALUES))]
    df = session.createDataFrame(rows, ", ".join(f"{a} string" for a in arguments))
    got = session.sql(f"select {name}({', '.join(arguments)}) as x from {{df}}", df=df)
    assert got.collect() == df.select(use(*map(F.col, arguments)).alias("x")).collect()
    assert "Python" not in got._jdf.queryExecution().executedPlan().toString()


def test_jaro_winkler(session):
    assert session.sql("select jaro_winkler('martha', 'marhta') as x").first()["x"] == pytest.approx(similarity.jaro_winkler("martha", "marhta"))


def test_table_functions_equal_parse_documents(session):
    docs = session.createDataFrame(DOCS, "source_id string, content_type string, body string")
    key = lambda r: tuple((x is None, str(x)) for x in r)
    want = sorted(map(tuple, formats.parse_documents(docs).collect()), key=key)
    by_table = session.sql("select * from parse_documents(table(select source_id, detect_format(content_type, body) as format, body, 1 as more from {d}))", d=docs)
    by_row = session.sql("select d.source_id, d.format, p.* from (select *, detect_format(content_type, body) as format from {d}) d, lateral parse_document(d.format, d.body) p", d=docs)
    assert sorted(map(tuple, by_table.collect()), key=key) == want and sorted(map(tuple, by_row.collect()), key=key) == want
    assert {r[0] for r in want} == {d[0] for d in DOCS}
    empty = session.createDataFrame([], docs.schema)
    assert session.sql("select * from parse_documents(table(select source_id, content_type as format, body from {d}))", d=empty).count() == 0


def test_names_stay_apart(session):
    assert {"slug", "parse_documents"} <= {f.name for f in session.catalog.listFunctions()} and text.slug and values.parse_money and places.property_key
