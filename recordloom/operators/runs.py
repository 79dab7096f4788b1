"""Sources and their runs: which are to run and when, whether their data is complete, totals of waves and sweeps, repairs and upserts."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions.places import parse_address
from ..functions.text import is_digits, slug
from .operations import first_by

# Rows that a query of a county may hold, values that a filter may list, words of streets that are no name.
EVENT_LIMIT, PROPERTY_LIMIT = 10_000, 20_000
LISTED = {"{parcels}": 150, "{streets}": 60, "{numbers}": 120}
STREET_WORDS = "ST AVE AV RD DR BLVD LN CT PL CIR TER WAY PKWY HWY TRL SQ STREET AVENUE ROAD DRIVE COURT BOULEVARD LANE PLACE CRESCENT N S E W".split()


def waves(sources: DataFrame) -> DataFrame:
    """Enabled sources (url, enabled) with their wave: those that ask for known parcels run second, all others first."""
    return sources.where("enabled").withColumn("wave", F.when(F.col("url").contains("{parcels}"), 2).otherwise(1))


def wave_totals(runs: DataFrame) -> DataFrame:
    """(wave, runs, total_ms) of runs (wave, total_ms)."""
    return runs.groupBy("wave").agg(F.count("*").alias("runs"), F.sum("total_ms").alias("total_ms"))


def stage_times(runs: DataFrame, stages: list[str]) -> DataFrame:
    """(stage, runs, mean_ms, most_ms) from a column of milliseconds for each stage; runs that didn't reach a stage have null there."""
    long = runs.select(F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.col(s).cast("double").alias("ms")) for s in stages])).alias("x")).select("x.*")
    return long.where("ms is not null").groupBy("stage").agg(F.count("*").alias("runs"), F.avg("ms").alias("mean_ms"), F.max("ms").alias("most_ms"))


MEASURED = "run_id string, place int, stage string, rows long, cells long, ms double, process_ms double"


def measured(start: DataFrame, stages: Sequence[tuple[str, Callable[[DataFrame], DataFrame]]], run_id: str) -> tuple[DataFrame, DataFrame]:
    """(result, run rows) of stages, each a function of the one before: rows and non-null cells of each stage are counted by Spark while
    the stage runs (df.observe), not by another pass; ms is its time, process_ms the driver's own CPU time in it. Each stage's result is
    checkpointed, so that its time is its own."""
    spark, df, out = start.sparkSession, start, []
    for place, (name, use) in enumerate(stages):
        began, cpu = time.perf_counter(), time.process_time()
        df = use(df)
        seen = Observation(f"{run_id}-{place}")
        cells = sum((F.count(F.col(f"`{c}`")) for c in df.columns), F.lit(0).cast("long"))
        df = df.observe(seen, F.count(F.lit(1)).alias("rows"), cells.alias("cells")).checkpoint()
        got = seen.get
        out.append((run_id, place, name, got["rows"], got["cells"], (time.perf_counter() - began) * 1000, (time.process_time() - cpu) * 1000))
    return df, spark.createDataFrame(out, MEASURED)


def data_complete(sources: DataFrame, runs: DataFrame, sizes: DataFrame) -> DataFrame:
    """(county, complete): every source's latest run wasn't truncated, and the county is within what a query may hold.

    sources: (county, source_id); runs: (source_id, seq, truncated); sizes: (county, events, properties). A source without runs
    isn't complete, nor is a county without sources.
    """
    last = runs.groupBy("source_id").agg(F.max_by("truncated", "seq").alias("truncated"))
    whole = sources.join(last, "source_id", "left").groupBy("county").agg(F.bool_and(F.coalesce(~F.col("truncated"), F.lit(False))).alias("whole"))
    fits = (F.coalesce("events", F.lit(0)) <= EVENT_LIMIT) & (F.coalesce("properties", F.lit(0)) < PROPERTY_LIMIT)
    return sizes.join(whole, "county", "left").select("county", (F.coalesce("whole", F.lit(False)) & fits).alias("complete"))


def sweeps(states: DataFrame) -> DataFrame:
    """(sweep, completed, failed, total, state) of sources' states (sweep, state): running until every one is complete or has failed."""
    failed = F.count_if(F.col("state").isin("errored", "terminated"))
    s = states.groupBy("sweep").agg(F.count_if(F.col("state") == "complete").alias("completed"), failed.alias("failed"), F.count("*").alias("total"))
    return s.withColumn("state", F.when(F.col("completed") + F.col("failed") < F.col("total"), "running").when(F.col("failed") > 0, "error").otherwise("complete"))


def outcomes(events: DataFrame) -> DataFrame:
    """(outcome, n) of crawls, harvests or pages."""
    return events.groupBy("outcome").agg(F.count("*").alias("n"))


def largest(properties: DataFrame) -> DataFrame:
    """The jurisdiction with the most properties, ties by name: one row, none without properties."""
    return properties.groupBy("jurisdiction").agg(F.count("*").alias("properties")).orderBy(F.desc("properties"), "jurisdiction").limit(1)


def latest_tenant(tenants: DataFrame, credentials: DataFrame, messages: DataFrame) -> DataFrame:
    """The tenant (tenant_id) with credentials whose last message (tenant_id, at) is the newest, those without messages last, ties by
    identifier: one row at most."""
    able = tenants.join(credentials.select("tenant_id"), "tenant_id", "left_semi")
    last = messages.groupBy("tenant_id").agg(F.max("at").alias("last_at"))
    return able.join(last, "tenant_id", "left").orderBy(F.desc_nulls_last("last_at"), "tenant_id").limit(1)


def crawl_order(found: DataFrame) -> DataFrame:
    """Results of a crawl (url, records, extraction), those that gave most records at the best rate first, ties by address."""
    return found.orderBy(F.desc(F.col("records") * F.col("extraction")), "url")


def first_matches(matches: DataFrame, limit: int | None, *order: Column | str) -> DataFrame:
    """The first matches of an answer: three unless it says otherwise, one at least."""
    return matches.orderBy(*order).limit(max(1, 3 if limit is None else limit))


def most_owed(properties: DataFrame, limit: int = PROPERTY_LIMIT) -> DataFrame:
    """A page of properties: most owed first, those that owe nothing known before all, ties by key."""
    return properties.orderBy(F.desc_nulls_first("owed"), "property_key").limit(limit)


def recent(events: DataFrame, limit: int = EVENT_LIMIT) -> DataFrame:
    """The window of recent events: newest first, undated last."""
    return events.orderBy(F.desc_nulls_last("event_date"), F.desc("recorded_at"), "id").limit(limit)


def resolved_repairs(repairs: DataFrame, decisions: DataFrame) -> DataFrame:
    """Repairs (id, source_id, resolution, mapping) with decisions (id, approved) applied: approved or rejected, and an error for
    a decision on one that isn't pending. Repairs that nobody decided on stay."""
    d = first_by(decisions, ["id"], F.desc("approved")).select("id", "approved")
    r = repairs.join(d, "id", "left")
    late = F.col("approved").isNotNull() & (F.col("resolution") != "pending")
    now = F.when(late | F.col("approved").isNull(), F.col("resolution")).when(F.col("approved"), "approved").otherwise("rejected")
    error = F.when(late, F.concat(F.lit("already resolved ("), F.col("resolution"), F.lit(")")))
    return r.select("id", "source_id", "mapping", now.alias("resolution"), error.alias("error"), (F.coalesce("approved", F.lit(False)) & ~late).alias("applied"))


def repaired_states(states: DataFrame, resolved: DataFrame) -> DataFrame:
    """(source_id, mapping, good_runs): an approved repair's mapping takes the old one's place and starts its good runs anew; the
    latest by id counts."""
    new = resolved.where("applied and resolution = 'approved' and coalesce(mapping, '') != ''").groupBy("source_id").agg(F.max_by("mapping", "id").alias("new"))
    both = states.join(new, "source_id", "full")
    return both.select("source_id", F.coalesce("new", "mapping").alias("mapping"), F.when(F.col("new").isNotNull(), F.lit(0).cast("long")).otherwise(F.col("good_runs")).alias("good_runs"))


def upserted(stored: DataFrame, arriving: DataFrame, keys: list[str]) -> DataFrame:
    """stored with arriving's rows in place of those of the same keys, and its new ones; an arriving null keeps what is stored."""
    rest = [c for c in stored.columns if c not in keys]
    old, new = stored.select(*keys, F.struct(*rest).alias("old")), arriving.select(*keys, F.struct(*rest).alias("new"))
    return old.join(new, keys, "full").select(*keys, *[F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")).alias(c) for c in rest])


def added(sources: DataFrame, arriving: DataFrame) -> DataFrame:
    """The catalogue with arriving's sources (name, url), each under its slug and six hex digits of its URL's hash; a URL that is
    there already stays as it is."""
    known = F.concat(slug(F.col("name")), F.lit("-"), F.substring(F.sha2("url", 256), 1, 6))
    new = first_by(arriving, ["url"], "name").join(sources.select("url"), "url", "left_anti")
    return sources.unionByName(new.select(known.alias("id"), "name", "url"))


def removed(rows: DataFrame, gone: DataFrame, key: str = "source_id") -> DataFrame:
    """A table of the store (sources, states, records, cached results) without what belongs to removed sources."""
    return rows.join(gone.select(F.col("source_id").alias("__gone")), F.col(key) == F.col("__gone"), "left_anti")


def quotable(c: Column) -> Column:
    return (c != "") & ~c.rlike("['\"\n]")


def known_values(keys: DataFrame) -> DataFrame:
    """(scope, token, value, first) of what sources can be asked for, from properties (property_key, address, seq): parcels, names of
    streets, and house numbers of addresses that can be located. first: the least seq that has it."""
    scope = F.substring_index("property_key", "|", 1)
    parcel = F.regexp_extract("property_key", r"^[^|]*\|p:(.*)$", 1)
    name = F.array_join(F.filter(F.split(F.translate(F.coalesce("address", F.lit("")), "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"), " ", -1), lambda w: (w != "") & ~is_digits(w) & ~w.isin(*STREET_WORDS)), " ")
    a = parse_address(F.coalesce("address", F.lit("")))
    rows = keys.select(scope.alias("scope"), "seq", parcel.alias("parcel"), F.when(F.octet_length(name) >= 3, name).otherwise("").alias("street"), F.when(a["locatable"], a["number"]).otherwise("").alias("number"))
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("token"), F.col(c).alias("value")) for t, c in (("{parcels}", "parcel"), ("{streets}", "street"), ("{numbers}", "number"))])).alias("x")
    found = rows.select("scope", "seq", each).select("scope", "x.token", "x.value", "seq").where(quotable(F.col("value")))
    return found.groupBy("scope", "token", "value").agg(F.min("seq").alias("first"))


def expanded(sources: DataFrame, keys: DataFrame) -> DataFrame:
    """sources (source_id, jurisdiction, url) with their URL's tokens filled with quoted known values of the jurisdiction, the first
    seen up to the token's limit (a URL holds no more), and an error where there are none yet."""
    w = Window.partitionBy("scope", "token").orderBy("first", "value")
    limit = F.coalesce(*[F.when(F.col("token") == t, n) for t, n in LISTED.items()])
    top = known_values(keys).withColumn("n", F.row_number().over(w)).where(F.col("n") <= limit)
    lists = top.groupBy("scope", "token").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "value"))), lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ",").alias("list"))
    lists = lists.groupBy("scope").agg(*[F.max(F.when(F.col("token") == t, F.col("list"))).alias(t.strip("{}")) for t in LISTED])
    rows = sources.withColumn("scope", slug(F.col("jurisdiction"))).join(lists, "scope", "left")
    url, wanting = F.col("url"), F.lit(False)
    for t in LISTED:
        have = F.col(t.strip("{}"))
        wanting = wanting | (F.col("url").contains(t) & have.isNull())
        at = F.instr(url, t)
        url = F.when((at > 0) & have.isNotNull(), F.concat(F.substring(url, F.lit(1), at - 1), have, F.substring(url, at + len(t), F.length(url)))).otherwise(url)
    return rows.select("source_id", F.when(~wanting, url).alias("url"), F.when(wanting, "nothing to target yet").alias("error"))
