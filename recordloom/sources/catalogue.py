"""Catalogues of open data as tables: which listed datasets are worth fetching, and examples of their columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.operations import first_by

# The fewest columns of a dataset worth mapping; values that an example of a column holds, at most.
LEAST_COLUMNS, EXAMPLE_VALUES = 4, 3


def plausible_domain(domain: Column) -> Column:
    """A host name in lower case with a dot inside and a letter: no raw address, nothing odd."""
    shape = domain.rlike(r"^[a-z0-9-][a-z0-9.-]*[a-z0-9-]$") & domain.contains(".") & domain.rlike("[a-z]")
    return F.coalesce(shape & (F.length(domain) <= 128), F.lit(False))


def plausible_dataset_id(dataset_id: Column) -> Column:
    return F.coalesce(dataset_id.rlike(r"\A[a-z0-9]{4}-[a-z0-9]{4}\z"), F.lit(False))


def discovered(listed: DataFrame) -> DataFrame:
    """Listed datasets (domain, dataset_id, columns array, ...) that are plausible and have enough columns, each once (the
    first by name)."""
    good = plausible_domain(F.col("domain")) & plausible_dataset_id(F.col("dataset_id")) & (F.size("columns") >= LEAST_COLUMNS)
    return first_by(listed.where(good), ["domain", "dataset_id"], "name")


def column_examples(cells: DataFrame) -> DataFrame:
    """(source_id, label, values): the first non-empty values of each label, in order of record."""
    order = Window.partitionBy("source_id", "label").orderBy("record")
    some = cells.where(F.trim("value") != "").withColumn("n", F.row_number().over(order)).where(F.col("n") <= EXAMPLE_VALUES)
    kept = F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: x["value"])  # EXAMPLE_VALUES at most
    return some.groupBy("source_id", "label").agg(kept.alias("values"))
