"""The library from SQL: register(spark) adds its functions to a session.

Scalar functions are SQL functions whose bodies are the library's own column expressions, so they are inlined and run in the
JVM like the DataFrame forms:

    slug(text), collapse(text), parse_money(text), parse_record_date(text), normalize_address(text), parse_address(text),
    property_key(jurisdiction, parcel, address), content_id(text), detect_format(content_type, body), validate_<kind>(text)

jaro_winkler(a, b) is an Arrow function. Two table functions give the cells of documents, of one body by row or of a whole
table (Spark takes no SQL function inside a lateral call, so the format is a column first):

    select d.source_id, p.* from (select *, detect_format(content_type, body) as format from docs) d, lateral parse_document(d.format, d.body) p
    select * from parse_documents(table(select source_id, detect_format(content_type, body) as format, body from docs))
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .functions import places, similarity, text, values
from .sources import formats

#: Name: (arguments, expression over columns of these names).
FUNCTIONS: dict[str, tuple[tuple[str, ...], Callable[..., Column]]] = {
    "slug": (("value",), text.slug),
    "collapse": (("value",), text.collapse),
    "parse_money": (("value",), values.parse_money),
    "parse_record_date": (("value",), values.parse_date),
    "normalize_address": (("value",), places.normalize_address),
    "parse_address": (("value",), places.parse_address),
    "property_key": (("jurisdiction", "parcel", "address"), places.property_key),
    "content_id": (("value",), text.content_hash),
    "detect_format": (("content_type", "body"), formats.detect_format),
    **{f"validate_{kind}": (("value",), lambda c, kind=kind: values.validate(kind, c)) for kind in values.KINDS},
}


def written_out(column: Column) -> str:
    """A column's expression as SQL text: operators that it names as functions, like or(a, b), are quoted; literals stay."""
    said = column._jc.node().sql()
    parts = re.split(r"('(?:[^'\\]|\\.)*')", said, flags=re.S)
    return "".join(p if i % 2 else quoted(p) for i, p in enumerate(parts))


def quoted(said: str) -> str:
    said = re.sub(r"(?<![\w`])(or|and|in|not|[!<>=+*/%&|^~-]+)\(", r"`\1`(", said)
    return re.sub(r"\bInfinity\b", "double('Infinity')", said)


def create(spark: SparkSession, name: str, arguments: tuple[str, ...], use: Callable[..., Column]) -> None:
    body = use(*[F.col(a) for a in arguments])
    kind = spark.createDataFrame([], T.StructType([T.StructField(a, T.StringType()) for a in arguments])).select(body.alias("x")).schema["x"].dataType
    declared = ", ".join(f"{a} STRING" for a in arguments)
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {kind.simpleString()} RETURN {written_out(body)}")


class ParseDocument:
    """(format, body) to the body's cells."""

    def eval(self, format: str, body: str) -> Iterator[tuple]:
        yield from formats.cells_of(format, body)


class ParseDocuments:
    """A table of (source_id, format, body) to cells of all its rows; more columns are passed over."""

    def eval(self, row: Row) -> Iterator[tuple]:
        for cell in formats.cells_of(row["format"], row["body"]):
            yield row["source_id"], row["format"], *cell


TABLES = {
    "parse_document": (ParseDocument, formats.CELL_TYPE),
    "parse_documents": (ParseDocuments, f"source_id string, format string, {formats.CELL_TYPE}"),
}


def register(spark: SparkSession, *names: str) -> None:
    """Adds the named functions to the session, all of them if none is named; those that it has are left."""
    for name in names or [*FUNCTIONS, "jaro_winkler", *TABLES]:
        if spark.catalog.functionExists(name):
            continue
        if name in FUNCTIONS:
            create(spark, name, *FUNCTIONS[name])
        elif name in TABLES:
            spark.udtf.register(name, F.udtf(TABLES[name][0], returnType=TABLES[name][1]))
        else:
            spark.udf.register(name, similarity.similarity)
