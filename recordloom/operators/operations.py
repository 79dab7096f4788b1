"""Operating the catalogue: idempotent inserts, latest rows, set differences, freshness, baselines, drift and repairs."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The smoothing of a baseline; shares of it that count as drift, as a repair, and the confidence of one.
ALPHA, DRIFT, REPAIR_RATE, REPAIR_CONFIDENCE = 0.3, 0.6, 0.7, 0.75


def first_by(rows: DataFrame, keys: list[str], *order: Column | str) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def insert_new(existing: DataFrame, arriving: DataFrame, key: str = "id", order: str = "recorded_at") -> DataFrame:
    """Rows of arriving that aren't stored yet, each identifier once (the first by `order`). Running it again adds nothing."""
    return first_by(arriving, [key], order).join(existing.select(key), key, "left_anti")


def merged(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Union keeping the first of each key, left before right."""
    both = left.withColumn("__side", F.lit(0)).unionByName(right.withColumn("__side", F.lit(1)))
    return first_by(both, keys, "__side").drop("__side")


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right.select(key), key, "left_anti")


def enrichment(events: DataFrame, known_keys: DataFrame, known_addresses: DataFrame) -> DataFrame:
    """Events whose property is known by its key, or else by its address."""
    by_key = events.join(known_keys, "property_key", "left_semi")
    by_address = events.join(known_keys, "property_key", "left_anti").join(known_addresses, "join_key", "left_semi")
    return by_key.unionByName(by_address)


def set_changes(proposed: DataFrame, active: DataFrame, key: str) -> DataFrame:
    """(key, change): remaining, removed or added."""
    p, a = proposed.select(key).distinct().withColumn("p", F.lit(True)), active.select(key).distinct().withColumn("a", F.lit(True))
    change = F.when(F.col("p") & F.col("a"), "remaining").when(F.col("a"), "removed").otherwise("added")
    return p.join(a, key, "full").select(key, change.alias("change"))


def freshness(sources: DataFrame, runs: DataFrame, now_epoch: int, stale_hours: float = 48.0) -> DataFrame:
    """Each source's latest run against now: age_hours and ok, stale, or undated. A run in the future is ok."""
    last = runs.groupBy("source_id").agg(F.max("finished_epoch").alias("last_epoch"))
    age = (F.lit(now_epoch) - F.col("last_epoch")) / 3600.0
    return sources.join(last, "source_id", "left").select("source_id", age.alias("age_hours"), F.when(F.col("last_epoch").isNull(), "undated").when(age > stale_hours, "stale").otherwise("ok").alias("status"))


def record_ages(sources: DataFrame, runs: DataFrame, now_epoch: int, stale_hours: float = 48.0) -> DataFrame:
    """Each source's latest run (source_id, seq, ok, finished_epoch, newest_epoch) by two ages: of the fetch, and of its newest record.

    verdict: pending without a run, failed, unchanged if no record is dated, ok also for records of the future, review for rows
    older than stale_hours, which a fetch that succeeds may still bring."""
    last = first_by(runs, ["source_id"], F.desc("seq"))
    age = lambda c: (F.lit(now_epoch) - F.col(c)) / 3600.0
    verdict = F.when(F.col("ok").isNull(), "pending").when(~F.col("ok"), "failed").when(F.col("newest_epoch").isNull(), "unchanged").when(age("newest_epoch") > stale_hours, "review").otherwise("ok")
    return sources.select("source_id").join(last, "source_id", "left").select("source_id", age("finished_epoch").alias("fetch_age"), age("newest_epoch").alias("record_age"), verdict.alias("verdict"))


def baselines(runs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """(source_id, baseline, good_runs): smoothed rate of each source's runs in order of `seq`; an accepted repair starts anew.
    A source's runs are folded as an array of (seq, rate, repaired)."""
    r = F.struct("seq", "rate", "repaired")
    start = F.struct(F.lit(0.0).alias("baseline"), F.lit(0).cast("long").alias("good_runs"))

    def step(a: Column, x: Column) -> Column:
        n = F.when(x["repaired"], F.lit(0).cast("long")).otherwise(a["good_runs"])
        return F.struct(F.when(n == 0, x["rate"]).otherwise((1 - alpha) * a["baseline"] + alpha * x["rate"]).alias("baseline"), (n + 1).alias("good_runs"))

    return runs.groupBy("source_id").agg(F.aggregate(F.array_sort(F.collect_list(r)), start, step).alias("s")).select("source_id", "s.baseline", "s.good_runs")


def drifted(state: DataFrame, current: DataFrame) -> DataFrame:
    """(source_id, drift): a source with good runs whose document has no records, or a rate under the share of its baseline."""
    drift = (F.col("good_runs") > 0) & ((F.col("records") == 0) | (F.col("rate") < DRIFT * F.col("baseline")))
    return state.join(current, "source_id").select("source_id", "rate", "baseline", F.coalesce(drift, F.lit(False)).alias("drift"))


def repairs(proposals: DataFrame) -> DataFrame:
    """Proposals (source_id, mapping_confidence, rate, baseline) with confidence and resolution: auto (accepted) or pending. Without a
    baseline the rate itself is the recovery, and any rate above 0 is enough."""
    based = F.col("baseline") > 0
    gain = F.when(based, F.least(F.lit(1.0), F.col("rate") / F.col("baseline"))).otherwise(F.col("rate"))
    enough = F.when(based, F.col("rate") >= REPAIR_RATE * F.col("baseline")).otherwise(F.col("rate") > 0)
    p = proposals.withColumn("confidence", 0.5 * F.col("mapping_confidence") + 0.5 * gain)
    return p.withColumn("resolution", F.when(enough & (F.col("confidence") >= REPAIR_CONFIDENCE), "auto").otherwise("pending"))


def ranked(rows: DataFrame, name: str, *order: str | Column) -> DataFrame:
    """rows with their place in an order over all of them: partitions by range, sorted, each numbered from where the one before
    ends. The rows are checkpointed in between, so that both readings number the same ones."""
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    placed = placed.checkpoint()
    part = F.shiftright("__at", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(Window.partitionBy(F.lit(0)).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = sizes.select("__part", before.alias("__before"))  # one row for each partition
    out = placed.withColumn("__part", part).join(F.broadcast(firsts), "__part")
    return out.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)) + 1).drop("__at", "__part", "__before")


def host_budget(requests: DataFrame, per_window: int = 60, window_s: int = 60, gap_s: float = 0.0) -> DataFrame:
    """(host, at_s, id, allowed, wait_s): replay of a budget per host whose window starts on the first request after the last one
    ended. Each window's start depends on the one before, so a host's requests are walked in order of time; the walk reads
    sorted batches and holds a host's window only, never its requests. wait_s: what an allowed request waits so that it comes gap_s
    after the one before; null for others."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        host, opened, used, last = None, 0, 0, None
        for b in batches:
            out, waits = [], []
            for h, at in zip(b["host"], b["at_s"], strict=True):
                last = last if h == host else None
                if h != host or at >= opened + window_s:
                    host, opened, used = h, at, 0
                out.append(used < per_window)
                used += out[-1]
                waits.append((max(0.0, gap_s - (at - last)) if last is not None else 0.0) if out[-1] else None)
                last = at + waits[-1] if out[-1] else last
            yield b.assign(allowed=out, wait_s=pd.Series(waits, dtype="float64").to_numpy())

    rows = requests.select(F.col("host").cast("string").alias("host"), F.col("at_s").cast("long").alias("at_s"), F.col("id").cast("long").alias("id"))
    return rows.repartition("host").sortWithinPartitions("host", "at_s", "id").mapInPandas(walk, "host string, at_s long, id long, allowed boolean, wait_s double")
