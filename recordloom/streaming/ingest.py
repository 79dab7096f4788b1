"""Continuous ingestion: idempotent event streams, per-source state, change detection, lifecycle kept up to date.

Streams read files as they arrive. Late and out-of-order events are welcome: a batch's properties are reduced again from all
their stored events, so the result doesn't depend on the order of arrival.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import lifecycle
from ..operators.operations import ALPHA, first_by


def read_events(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def distinct_events(stream: DataFrame, watermark: str = "", time_col: str = "seen_at") -> DataFrame:
    """Each content id once. With a watermark the state forgets identifiers that are older; without, it keeps all of them."""
    return stream.withWatermark(time_col, watermark).dropDuplicatesWithinWatermark(["id"]) if watermark else stream.dropDuplicates(["id"])


def county_of(rows: DataFrame) -> DataFrame:
    """rows with the county that the store has a folder for: a batch reads the folders of its own counties only."""
    return rows.withColumn("county", F.substring_index("property_key", "|", 1))


def stored_near(batch: DataFrame, store: str) -> DataFrame:
    """The stored events of the batch's counties, whose names (a few thousand at most) prune the store's folders."""
    counties = [r["county"] for r in batch.select("county").distinct().collect()]
    return batch.sparkSession.read.parquet(store).where(F.col("county").isin(counties))


def append_new(store: str, key: str = "id") -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: rows whose key isn't stored yet are appended, by county. A batch that is replayed after a failure adds
    nothing. An event's key is its content's, so it can only be stored in its own county."""

    def sink(batch: DataFrame, _: int) -> None:
        fresh = first_by(county_of(batch), [key], "recorded_at")
        if stored(batch.sparkSession, store):
            fresh = fresh.join(stored_near(county_of(batch), store).select(key), key, "left_anti")
        fresh.write.mode("append").partitionBy("county").parquet(store)

    return sink


def stored(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def keep_states(store: str, states: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: appends new events, then writes the states of the properties that the batch touches, by batch."""
    append = append_new(store)

    def sink(batch: DataFrame, number: int) -> None:
        append(batch, number)
        touched = batch.select("property_key").distinct()
        now = lifecycle.states(stored_near(county_of(batch), store).join(touched, "property_key", "left_semi"))
        now.withColumn("batch", F.lit(number)).write.mode("append").parquet(states)

    return sink


def latest_states(spark: SparkSession, states: str) -> DataFrame:
    return first_by(spark.read.parquet(states), ["property_key"], F.desc("batch")).drop("batch")


def run_available(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Processes what has arrived, then stops; to be scheduled, or replaced by a processing-time trigger for polling."""
    query = stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def source_baselines(stream: DataFrame) -> DataFrame:
    """(source_id, seq, rate, baseline, good_runs) of a stream of runs (source_id, seq, rate, repaired), with each source's
    smoothed rate kept as state between batches."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        baseline, good = state.get if state.exists else (0.0, 0)
        runs = pd.concat(list(batches)).sort_values("seq")  # a source's runs of one micro-batch
        out = []
        for r in runs.itertuples():
            good = 0 if r.repaired else good
            baseline = r.rate if good == 0 else (1 - ALPHA) * baseline + ALPHA * r.rate
            good += 1
            out.append((key[0], r.seq, r.rate, baseline, good))
        state.update((baseline, good))
        yield pd.DataFrame(out, columns=["source_id", "seq", "rate", "baseline", "good_runs"])

    schema = "source_id string, seq long, rate double, baseline double, good_runs long"
    return stream.groupBy("source_id").applyInPandasWithState(fold, schema, "baseline double, good_runs long", "append", "NoTimeout")


def changed(seen: DataFrame, fetched: DataFrame) -> DataFrame:
    """Documents (source_id, body) whose content differs from the last one seen (source_id, body_hash)."""
    f = fetched.withColumn("body_hash", F.sha2("body", 256))
    return f.join(seen.withColumnRenamed("body_hash", "last"), "source_id", "left").where(F.col("last").isNull() | (F.col("last") != F.col("body_hash"))).drop("last")
