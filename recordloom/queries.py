"""Registered queries of the library's own operators, and the SQL that says what they return."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import queries_catalogue, queries_decisions, queries_documents, queries_operations, queries_properties

Query = Callable[[SparkSession, str], DataFrame]

PARTS = (queries_properties, queries_catalogue, queries_documents, queries_operations, queries_decisions)
QUERIES: dict[str, Query] = {name: query for part in PARTS for name, query in part.QUERIES.items()}
ORACLE_SQL: dict[str, str] = {name: sql for part in PARTS for name, sql in part.ORACLE_SQL.items()}
FLAGSHIP = "lifecycle_state"
