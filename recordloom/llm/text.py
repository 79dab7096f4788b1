"""Small helpers the training-data operators share: words, hashes, tables in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows above which a per-key table, and one of bare identifiers, is joined by shuffle rather than broadcast.
BROADCAST_ROWS, BROADCAST_IDS = 50_000, 1_000_000

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def n_words(text: Column) -> Column:
    """Number of words of a text; 0 for a null one."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or the one set by setCheckpointDir."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("set spark.checkpoint.dir, before the session starts, to a folder that the driver and all executors share")
    return folder.rstrip("/")


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


def written(df: DataFrame, *, partition_rows: int | None = None) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/recordloom-{uuid.uuid4().hex}"
    writer = df.write.option("maxRecordsPerFile", partition_rows) if partition_rows else df.write
    with shuffles_removed(spark):
        writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_written(df: DataFrame) -> None:
    """Removes a table that written() made and nothing reads any more."""
    spark = df.sparkSession
    jvm = spark._jvm
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles() if "/recordloom-" in x}:
        path = jvm.org.apache.hadoop.fs.Path(f)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def join_small(df: DataFrame, small: DataFrame, on: Column, how: str = "left", most: int = BROADCAST_ROWS) -> DataFrame:
    """Joins a table that has one row for each key. Its rows are counted first: up to `most` they are
    broadcast, beyond that Spark picks a shuffled join (AQE splits its hot keys)."""
    rows = small.limit(most + 1).count()
    return df.join(F.broadcast(small) if rows <= most else small, on, how)


def without(df: DataFrame, *names: str) -> DataFrame:
    """df less the columns that an operator is about to add (names match as Spark resolves them: case-blind)."""
    gone = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in gone])


def spans(texts: pd.Series, most: int) -> Iterator[slice]:
    """Slices of rows of about `most` characters; a longer text is alone."""
    start = held = 0
    for i, t in enumerate(texts):
        size = len(t) if isinstance(t, str) else 0
        if held and held + size > most:
            yield slice(start, i)
            start, held = i, 0
        held += size
    if start < len(texts):
        yield slice(start, len(texts))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= M2
    x ^= x >> np.uint64(27)
    x *= M3
    x ^= x >> np.uint64(31)
    return x
