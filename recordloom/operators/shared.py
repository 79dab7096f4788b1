"""Tables between the steps of a query that several of its branches read."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Jobs within remove their shuffle files when they are done: whoever keeps their result needs these no more."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def written(df: DataFrame) -> DataFrame:
    """df as a table in spark.checkpoint.dir, which driver and executors share, so that its branches don't compute it again. Parquet
    codes repeated words, which a checkpoint of rows would write out. Without such a folder: df itself."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return df
    path = f"{folder}/recordloom-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
