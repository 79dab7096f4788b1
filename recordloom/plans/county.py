"""Whole plans: documents to events, and events to a county's compiled properties."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.places import join_key, parse_address
from ..functions.text import slug
from ..operators import compile as comp
from ..operators import lifecycle, mapping
from ..operators.shared import written
from ..sources.formats import parse_documents


def ingest(docs: DataFrame, sources: DataFrame, fields: DataFrame) -> DataFrame:
    """Property events of documents (source_id, content_type, body). Shuffles by source to infer mappings, else by record."""
    cells = parse_documents(docs).where("record is not null").select("source_id", "record", "label_ord", "label", "value")
    found = mapping.infer_mapping(cells, fields)
    return mapping.build_events(mapping.extract(cells, found, fields), fields, sources)


def in_county(events: DataFrame, county: str) -> DataFrame:
    scope = F.substring_index("property_key", "|", 1)
    return events.where((scope == county) | scope.contains(county))


def aliases(county: Column) -> Column:
    """How a county's properties may be named: its slug, without city_of_ before it, without county or city before a state."""
    c = slug(county)
    every = F.array(c, F.regexp_replace(c, "^city_of_", ""), F.regexp_replace(c, "_(?:county|city)(?=_[a-z]{2}$)", ""))
    return F.array_distinct(F.filter(every, lambda a: a != ""))


def of_counties(events: DataFrame, counties: DataFrame) -> DataFrame:
    """(county, events...) for counties (county): events whose property_key starts with an alias and a bar, holds _alias and a bar, or holds
    alias_ anywhere, whatever its case. The last is looser than it seems (norfolk_ is in city_of_norfolk_va and in north_norfolk_x), and
    stays so. Scopes of keys are compared, not events: there are few of them; a key is compared whole only where its rest could
    hold the last form. counties is configuration."""
    named = F.broadcast(counties.select("county", F.explode(aliases(F.col("county"))).alias("alias")))
    rest = F.substring("property_key", F.instr("property_key", "|") + 1, F.length("property_key"))
    keyed = events.withColumn("__unit", F.when(rest.contains("_"), F.col("property_key")).otherwise(F.concat(F.substring_index("property_key", "|", 1), F.lit("|"))))
    unit, alias = F.col("__unit"), F.col("alias")
    near = unit.startswith(F.concat(alias, F.lit("|"))) | unit.contains(F.concat(F.lit("_"), alias, F.lit("|"))) | F.lower(unit).contains(F.concat(F.lower(alias), F.lit("_")))
    hits = keyed.select("__unit").distinct().join(named, near).select("county", "__unit").distinct()
    return keyed.join(hits, "__unit").select("county", *events.columns)


#: How often a county is compiled until its events stay the same meanwhile; minutes that a running one counts, seconds
#: after which a failed one is tried again.
PASSES, RUNNING_MINUTES, RETRY_S = 3, 20, 60


def compile_until_stable(read: Callable[[], DataFrame], compiled: Callable[[DataFrame], DataFrame], path: str, key: str, passes: int = PASSES) -> dict:
    """Compiles what read() gives until its stamp (count and newest record) is the same before and after: {key, stamp, passes, stable}.

    Each pass is a version of the result of its own under path, and current() reads the one that was finished last, so that
    readers never see a half-written one. After the last pass the newest version counts, though events arrived: it isn't stable."""
    for n in range(1, passes + 1):
        events = read()
        before = stamp_of(events)
        version = f"{path}/versions/{uuid.uuid4().hex}"
        compiled(events).write.parquet(version)
        after = stamp_of(read())
        state = {"key": key, "stamp": before, "passes": n, "stable": before == after, "version": version}
        events.sparkSession.createDataFrame([(key, before, n, before == after, version, time.time())], FINISHED).coalesce(1).write.mode("append").parquet(f"{path}/finished")
        if before == after:
            break
    return state


FINISHED = "key string, stamp string, passes int, stable boolean, version string, at double"


def stamp_of(events: DataFrame) -> str:
    n, newest = events.agg(F.count("*"), F.max("recorded_at")).first()
    return f"{n}:{newest or ''}"


def current(spark: SparkSession, path: str, key: str) -> tuple[DataFrame, dict] | None:
    """The result that was finished last, and its state; None if there is none."""
    done = spark.read.schema(FINISHED).parquet(f"{path}/finished").where(F.col("key") == key).orderBy(F.desc("at")).first()
    return (spark.read.parquet(done["version"]), done.asDict()) if done else None


def reusable(state: Column, updated: Column, now: Column) -> Column:
    """Whether a county's compile that is queued or running (state, its last change) still counts."""
    return F.coalesce(state.isin("queued", "running") & (F.unix_timestamp(now) - F.unix_timestamp(updated) < RUNNING_MINUTES * 60), F.lit(False))


def retry_key(state: Column, runtime: Column, updated: Column, now: Column) -> Column:
    """What tells a new try from the one before: the minute, for one that broke off; its last change, for one that failed a minute ago or
    more; else the empty string (no new try)."""
    text = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    bucket = F.timestamp_seconds(F.floor(F.unix_timestamp(now) / RETRY_S) * RETRY_S)
    old = (state == "error") & (F.unix_timestamp(now) - F.unix_timestamp(updated) >= RETRY_S)
    return F.when(state.isNull(), "").when(runtime.isin("errored", "terminated"), text(bucket)).when(old, text(updated)).otherwise("")


def compile_county(events: DataFrame, fields: DataFrame, trust: DataFrame, now_epoch: int) -> DataFrame:
    """One row for each property: its keys, resolved fields, state and signals, ranked by what is due.

    fields: (field, kind, authority); trust: (source_id, field, confidence). Keys that name one locatable address are one
    property, unless a source lists several parcels there or directions and suffixes clash.
    """
    order = F.struct("recorded_at", "id")
    address = F.element_at("details", "address")
    keys = events.groupBy("property_key").agg(F.min_by(address, F.when(F.coalesce(address, F.lit("")) != "", order)).alias("address"))
    keys = keys.withColumn("a", parse_address(F.col("address"))).withColumn("join_key", join_key(F.col("a")))
    keys = written(keys.select("property_key", "join_key", "a.directional", "a.suffix"))
    grouped = comp.guarded(comp.with_group(keys), events.select("property_key", "source_id", F.element_at("details", "parcel_id").alias("parcel_id")))
    group = F.concat_ws("#", "group_key", F.col("bucket").cast("string"))
    split = written(comp.buckets(grouped).select("property_key", group.alias("property")))  # what is measured reads it five times
    merged = events.join(split, "property_key").withColumnRenamed("property_key", "member").withColumnRenamed("property", "property_key")
    seen = comp.observations(merged, fields, trust)
    resolved = comp.resolve(seen).groupBy("property_key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"), F.sum(F.size("conflicts")).alias("conflicts"))
    signals = comp.signals(merged, now_epoch)
    members = merged.groupBy("property_key").agg(F.array_sort(F.collect_set("member")).alias("merged_keys"))
    out = signals.join(lifecycle.states(merged), "property_key").join(members, "property_key").join(resolved, "property_key", "left")
    get = lambda f: F.element_at("fields", f)
    out = out.withColumn("assessed", get("assessed_value").try_cast("double")).withColumn("occupancy", comp.occupancy(get("mailing_address"), get("address")))
    located = (F.coalesce(get("parcel_id"), F.lit("")) != "") | F.coalesce(parse_address(get("address"))["locatable"], F.lit(False))
    return comp.ranked(out.withColumn("locatable", located))
