"""Queries on saved criteria, hours of contact and compiled counties."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import schedule
from ..operators import criteria, valuation
from . import county
from .derived import FIELDS, SQL_EVENTS, property_events, table

#: When compiled counties are looked at: 2000-01-01 UTC.
NOW = 946_684_800


def graphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each supplier's criteria, some parts of them not asked for."""
    k = F.col("s_suppkey")
    s = table(spark, sf_dir, "supplier").select(
        k.alias("criteria_id"), F.when(k % 4 > 0, F.floor(F.abs("s_acctbal")) * 10).cast("double").alias("min_owed"), (k % 3 == 0).alias("require_multi_source"),
        ((k % 5) / 4.0).cast("double").alias("min_debt_to_value"), F.when(k % 7 > 0, k % 7 * 1000).cast("double").alias("max_days_since_event"),
    )
    return s.select("criteria_id", criteria.compiled().alias("graph"))


def saved_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Criteria as graphs: their description, entry and what is wrong where debt to value isn't known."""
    g = F.col("graph")
    known = [s for s in criteria.SIGNALS if s != "debtToValue"]
    return graphs(spark, sf_dir).select("criteria_id", g["entry"].alias("entry"), F.size(g["nodes"]).alias("nodes"), criteria.described(g).alias("said"), F.array_join(criteria.problems(g, known), "; ").alias("wrong"))


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's property with what is measured, under one of ten criteria. Amounts owed are added up in the order of events'
    identifiers: sums of doubles in any other order may end on the other side of half a dollar, from run to run. Events that tie
    have the same sum, that of all of them, so that any of the last will do."""
    so_far = Window.partitionBy("property_key").orderBy("id", "amount").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    events = property_events(spark, sf_dir).withColumn("owed", F.sum(F.when(F.col("kind") == "tax_delinquency", F.col("amount"))).over(so_far))
    e = events.groupBy("property_key").agg(
        F.max_by("owed", F.struct("id", "amount")).alias("owed"), F.max(F.when(F.col("kind") == "assessment_recorded", F.col("amount"))).alias("assessed"),
        F.countDistinct("source_id").alias("sources"), F.datediff(F.lit("2000-01-01"), F.max("event_date")).alias("days"),
    )
    key = F.regexp_extract("property_key", r"\|p:(\d+)$", 1).cast("long")
    pairs = [("owed", F.col("owed")), ("sources", F.when(key % 10 != 6, F.col("sources"))), ("debtToValue", F.col("owed") / F.col("assessed")), ("days_since_event", F.when(key % 10 != 4, F.col("days")))]
    signals = F.map_filter(F.create_map(*[x for n, c in pairs for x in (F.lit(n), c.cast("double"))]), lambda _, v: v.isNotNull())
    return e.select("property_key", (key % 10).alias("criteria_id"), signals.alias("signals"), F.when(key % 10 != 8, "1 Elm St").otherwise("").alias("address"), (key % 10 != 5).alias("data_complete"))


def criteria_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subjects(spark, sf_dir).join(graphs(spark, sf_dir), "criteria_id")
    w = criteria.walked(F.col("graph"), F.col("signals"))
    return rows.withColumn("w", w).select("property_key", "criteria_id", F.col("w.outcome").alias("outcome"), F.col("w.requires_approval").alias("requires_approval"), F.size("w.trace").alias("steps"), F.substring_index(criteria.told(F.col("w.trace")), "\n", 1).alias("first"))


def criteria_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = criteria.coverage(graphs(spark, sf_dir), subjects(spark, sf_dir))
    return c.select("criteria_id", "ready", F.array_join("missing", ", ").alias("missing"), "partial")


def send_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When the owner of each event could be written to."""
    zones = F.element_at(F.array(*[F.lit(z) for z in schedule.ZONES]), (F.col("user_id") % len(schedule.ZONES) + 1).cast("int"))
    kind = F.when(F.col("event_id") % 2 == 0, "business").otherwise("person")
    at = F.timestamp_seconds(F.unix_timestamp(F.col("ts").cast("timestamp")))
    w = schedule.next_window(at, kind, zones)
    return table(spark, sf_dir, "events").select("event_id", w.alias("w")).select("event_id", F.unix_timestamp("w.at").alias("at_s"), F.col("w.reason").alias("reason"))


def compiled_county(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties compiled; some have a parcel, some an address that can or can't be located, some neither."""
    e = property_events(spark, sf_dir)
    k = F.regexp_extract("property_key", r"\|p:(\d+)$", 1).cast("long")
    number = F.concat((k + 1).cast("string"), F.lit(" Elm Street"))
    shown = F.create_map(F.lit("parcel_id"), F.when(k % 3 == 0, F.concat(F.lit("P-"), k.cast("string"))).otherwise(""), F.lit("address"), F.when(k % 4 == 0, number).when(k % 4 == 1, "100 block of Main St").otherwise(""))
    fields = spark.createDataFrame([*FIELDS, ("parcel_id", "id", ""), ("address", "address", "")], "field string, kind string, authority string")
    trust = spark.createDataFrame([], "source_id string, field string, confidence double")
    c = county.compile_county(e.withColumn("details", F.map_concat("details", shown)), fields, trust, NOW)
    return c.select(F.element_at("merged_keys", 1).alias("property_key"), F.size("merged_keys").alias("keys"), "due", "violations", "sources", "locatable")


def alias_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by counties that are asked for under several spellings."""
    n = table(spark, sf_dir, "nation")
    names = n.select(F.when(F.col("n_nationkey") % 3 == 0, F.concat(F.lit("City of "), "n_name")).when(F.col("n_nationkey") % 3 == 1, F.substring_index("n_name", " ", 1)).otherwise(F.col("n_name")).alias("county"))
    return county.of_counties(property_events(spark, sf_dir), names.distinct()).groupBy("county").agg(F.count("*").alias("events"), F.countDistinct("property_key").alias("properties"))


def valuation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of order lines taken for properties, summed up by place in the vector."""
    k, q = F.col("l_orderkey"), F.col("l_quantity").cast("double")
    use = F.element_at(F.array(*[F.lit(u) for u in ("Single family", "APARTMENT", "Commercial", "industrial", "vacant land", "farm")]), (k % 6 + 1).cast("int"))
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_extendedprice").cast("double").alias("assessed"), F.when(k % 5 > 0, q * 100).otherwise(0.0).alias("improvement_value"), F.when(k % 4 > 0, q * 10).alias("land_value"), (q * 60).alias("sqft"),
        (1690 + k % 340).cast("double").alias("year_built"), F.lit(2020.0).alias("year"), (q * 50 - 100).alias("land_area"), use.alias("use"),
    )
    each = rows.select(F.posexplode(valuation.feature_vector(F.lit(1.25))).alias("feature", "x"))
    return each.groupBy("feature").agg(F.round(F.avg("x"), 6).alias("mean"), F.count_if(F.col("x") == 0).alias("zeros"))


QUERIES = {f.__name__: f for f in (saved_criteria, criteria_outcomes, criteria_coverage, send_windows, compiled_county, alias_events, valuation_features)}

SQL_GRAPHS = """
cr as (
  select s_suppkey as criteria_id, case when s_suppkey % 4 > 0 then floor(abs(s_acctbal)) * 10 else 10000 end::double as owed, s_suppkey % 3 = 0 as multi, [0, 0.25, 0.5, 0.75, 1][s_suppkey % 5 + 1]::double as ratio,
    case when s_suppkey % 7 > 0 then s_suppkey % 7 * 1000 end as days from supplier)
"""
SQL_SUBJECTS = SQL_EVENTS + """,
m as (
  select property_key, cast(split_part(property_key, '|p:', 2) as bigint) as k, sum(amount) filter (kind = 'tax_delinquency') as owed, max(amount) filter (kind = 'assessment_recorded') as assessed, count(distinct source_id) as sources,
    date '2000-01-01' - max(event_date)::date as days from pe group by property_key),
su as (select property_key, k, k % 10 as criteria_id, owed, case when k % 10 <> 6 then sources end as sources, owed / assessed as ratio, case when k % 10 <> 4 then days end as days from m)
"""

ORACLE_SQL = {
    "saved_criteria": "with " + SQL_GRAPHS + """select criteria_id, 'owed_floor' as entry, cast(4 + multi::int + (ratio > 0)::int + (days is not null)::int as integer) as nodes,
  '- amount owed at least $' || format('{:,}', owed::bigint) || case when multi then chr(10) || '- corroborating sources more than 1' else '' end || case when ratio > 0 then chr(10) || '- debt to value at least ' || case ratio when 1 then '1' else ratio::varchar end || 'x' else '' end
    || case when days is not null then chr(10) || '- days since last event at most ' || days || ' days' else '' end || chr(10) || '- outreach requires your approval' as said,
  case when ratio > 0 then 'condition "debt_ratio" uses unknown signal "debtToValue"' else '' end as wrong from cr""",
    "criteria_outcomes": "with " + SQL_SUBJECTS + "," + SQL_GRAPHS + """,
j as (select su.*, cr.owed as least_owed, multi, cr.ratio as least_ratio, cr.days as most_days, [coalesce(su.owed >= cr.owed, false), not multi or coalesce(su.sources > 1, false), cr.ratio = 0 or coalesce(su.ratio >= cr.ratio, false), cr.days is null or coalesce(su.days <= cr.days, false)] as met,
  [true, multi, cr.ratio > 0, cr.days is not null] as asked from su join cr using (criteria_id)),
f as (select *, coalesce(list_position(met, false), 5) as stop from j)
select property_key, criteria_id, case when stop = 5 then 'match' else 'discard' end as outcome, stop = 5 as requires_approval,
  cast(case when stop = 5 then len(list_filter(asked, lambda x: x)) + 2 else len(list_filter(asked[1:stop], lambda x: x)) + 1 end as integer) as steps,
  case when owed is null then '✗ amount owed is not measured for this property (needs at least $' || format('{:,}', least_owed::bigint) || ')'
    else case when met[1] then '✓' else '✗' end || ' amount owed $' || format('{:,}', floor(owed + 0.5)::bigint) || ' (needs at least $' || format('{:,}', least_owed::bigint) || ')' end as first from f""",
    "criteria_coverage": "with " + SQL_SUBJECTS + "," + SQL_GRAPHS + """,
a as (select criteria_id, count(owed) as o, max(sources) as s, count(ratio) as r, count(days) as d, bool_or(k % 10 <> 8) as addressed, bool_or(k % 10 = 5) as partial from su group by criteria_id),
g as (select cr.criteria_id, list_filter([case when coalesce(o, 0) = 0 then 'amount owed' end, case when multi and coalesce(s, 0) < 1 then 'corroborating sources' end, case when cr.ratio > 0 and coalesce(r, 0) = 0 then 'debt to value' end,
  case when cr.days is not null and coalesce(d, 0) = 0 then 'days since last event' end, case when not coalesce(addressed, false) then 'property addresses' end], lambda x: x is not null) as missing, coalesce(partial, false) as partial from cr left join a using (criteria_id))
select criteria_id, len(missing) = 0 as ready, array_to_string(missing, ', ') as missing, partial from g""",
    "send_windows": """with e as (select event_id, floor(epoch(ts))::bigint as s, case when event_id % 2 = 0 then 'business' else 'person' end as kind, ['America/New_York', 'America/Chicago', 'America/Denver', 'America/Phoenix', 'America/Los_Angeles'][user_id % 5 + 1] as zone from events),
l as (select *, timezone(zone, to_timestamp(s)) as local from e),
m as (select *, hour(local) * 60 + minute(local) as now, dayofweek(local) as today from l),
w as (select *, unnest([0, 1, 2, 3]) as offset_ from m),
o as (select *, (today + offset_) % 7 in (0, 6) as free, case when kind = 'business' then case when (today + offset_) % 7 in (0, 6) then null else 540 end when (today + offset_) % 7 in (0, 6) then 600 else 1050 end as opens, case kind when 'business' then 1020 else 1230 end as closes from w),
c as (select event_id, offset_, case when offset_ = 0 and now >= opens and now < closes then s when opens + 1440 * offset_ > now then s + (opens + 1440 * offset_ - now) * 60 end as at_s,
  case when kind = 'business' then 'business hours for a business owner' when free then 'weekend daytime for an individual owner' else 'after-work hours for an individual owner' end as reason from o)
select event_id, arg_min(at_s, offset_) filter (at_s is not null) as at_s, arg_min(reason, offset_) filter (at_s is not null) as reason from c group by event_id""",
    "compiled_county": "with " + SQL_EVENTS + """,
d as (select property_key, arg_max(amount, (event_date, recorded_at, id)) filter (kind = 'tax_delinquency') as due, count(*) filter (kind = 'code_violation') as violations, count(distinct source_id) as sources, cast(split_part(property_key, '|p:', 2) as bigint) as k from pe group by property_key)
select property_key, 1::integer as keys, coalesce(due, 0.0) as due, violations, sources, k % 3 = 0 or k % 4 = 0 as locatable from d""",
    "alias_events": "with " + SQL_EVENTS + """,
n as (select distinct case n_nationkey % 3 when 0 then 'City of ' || n_name when 1 then split_part(n_name, ' ', 1) else n_name end as county from nation),
g as (select county, regexp_replace(lower(county), '[^a-z0-9]+', '_', 'g') as s from n),
a as (select distinct county, unnest([s, regexp_replace(s, '^city_of_', '')]) as alias from g),
h as (select distinct county, property_key from (select distinct property_key from pe) k join a on starts_with(property_key, alias || '|') or contains(property_key, '_' || alias || '|') or contains(lower(property_key), alias || '_'))
select county, count(*) as events, count(distinct property_key) as properties from h join pe using (property_key) group by county""",
    "valuation_features": """with r as (
  select l_extendedprice::double as a, case when l_orderkey % 5 > 0 then l_quantity * 100 else 0 end::double as i, case when l_orderkey % 4 > 0 then l_quantity * 10 else 0 end::double as l, (l_quantity * 60)::double as s,
    1690 + l_orderkey % 340 as b, (l_quantity * 50 - 100)::double as area, l_orderkey % 6 as u from lineitem),
v as (select unnest(range(0, 18)) as feature, unnest([ln(greatest(a, 1) * 1.25), ln(greatest(a, 1)), case when i > 0 then i / greatest(a, 1) else 0 end, case when l > 0 then l / greatest(a, 1) else 0 end, case when i <= 0 then 1 else 0 end,
  ln(1 + s), case when s <= 100 then 1 else 0 end, ln(1 + case when s > 100 then greatest(a, 1) / s else 0 end), ln(1 + case when b > 1700 and b <= 2020 then 2020 - b else 0 end), case when b > 1700 and b <= 2020 then 0 else 1 end, ln(1 + greatest(area, 0)), -0.2,
  (u = 0)::int, (u = 1)::int, (u = 2)::int, (u = 3)::int, (u = 4)::int, (u = 5)::int]::double[]) as x from r)
select feature::integer as feature, round(avg(x), 6) as mean, count(*) filter (x = 0) as zeros from v group by feature""",
}
