"""Queries on property events: lifecycle, resolution, history, signals, entities, keys, decisions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import places, text
from ..operators import compile as comp
from ..operators import decisions, lifecycle
from ..operators.shared import written
from .derived import SQL_EVENTS, SQL_OBSERVATIONS, TRUST, fields, property_events, table

#: 2026-01-01T00:00:00Z
NOW = 1767225600


def observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    trust = spark.createDataFrame(TRUST, "source_id string, field string, confidence double")
    return comp.observations(property_events(spark, sf_dir), fields(spark), trust)


def lifecycle_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.states(property_events(spark, sf_dir))


def lifecycle_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lifecycle.transitions(property_events(spark, sf_dir))


def resolve_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.resolve(observed(spark, sf_dir)).select("property_key", "field", "value", "source_id", "as_of", "confidence")


def resolve_conflicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comp.resolve(observed(spark, sf_dir)).select("property_key", "field", F.explode("conflicts").alias("c"))
    return rows.select("property_key", "field", "c.kept_value", "c.kept_source_id", "c.dropped_value", "c.dropped_source_id")


def edition_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.history(observed(spark, sf_dir))


def edition_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = observed(spark, sf_dir)
    out = comp.edition_change(comp.resolve(seen), comp.history(seen), "assessed_value")
    return out.withColumn("change", F.round("change", 6))


def property_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.signals(property_events(spark, sf_dir), NOW)


def county_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All properties in the order of a county report."""
    rows = comp.signals(property_events(spark, sf_dir), NOW).select("property_key", "due", "violations", F.lit(None).cast("double").alias("assessed"))
    return comp.ranked(rows).select("property_key", "due", "violations")


def county_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = comp.signals(property_events(spark, sf_dir), NOW).withColumn("assessed", F.lit(1000.0)).withColumn("locatable", F.col("violations") > 0)
    made = comp.county_json(rows)
    return made.select("property_key", F.get_json_object("document", "$.due").cast("double").alias("due"), F.get_json_object("document", "$.auction_date").alias("auction_date"), F.round(F.get_json_object("document", "$.debt_to_value").cast("double"), 6).alias("debt_to_value"))


def addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's property with a street address; neighbours share one in pairs, with or without direction and suffix."""
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_name")
    n = F.floor(F.col("c_custkey") / 3)
    direction = F.element_at(F.array(*[F.lit(x) for x in ("", "N ", "South ")]), (F.col("c_custkey") % 3 + 1).cast("int"))
    suffix = F.element_at(F.array(*[F.lit(x) for x in ("", " Street", " Avenue", " St.")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    address = F.concat(F.lpad((n % 97 + 1).cast("string"), 4, "0"), F.lit(" "), direction, F.lit("Elm"), (n % 11).cast("string"), suffix)
    return c.select(F.concat(F.lit("n"), F.col("c_nationkey").cast("string"), F.lit("|p:"), F.col("c_custkey").cast("string")).alias("property_key"), address.alias("address"), F.concat(F.lit("s"), (F.col("c_custkey") % 13).cast("string")).alias("source_id"), F.col("c_custkey").cast("string").alias("parcel_id"))


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir).withColumn("a", places.parse_address(F.col("address")))
    return a.withColumn("join_key", places.join_key(F.col("a"))).select("property_key", "source_id", "parcel_id", "join_key", "a.directional", "a.suffix")


def parse_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = addresses(spark, sf_dir).withColumn("a", places.parse_address(F.col("address")))
    return a.select("property_key", places.normalize_address(F.col("address")).alias("normal"), "a.number", "a.street", "a.suffix", "a.directional", "a.locatable")


def entity_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.with_group(parsed(spark, sf_dir)).select("property_key", "group_key")


def uniqueness_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(parsed(spark, sf_dir))  # addresses are parsed once for the three branches that read them
    return comp.guarded(comp.with_group(p), p.select("property_key", "source_id", "parcel_id")).select("property_key", "group_key")


def compatible_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return comp.buckets(comp.with_group(parsed(spark, sf_dir)))


def property_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment")
    parcel = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("ab-"), F.col("c_custkey").cast("string")))
    return c.select("c_custkey", places.property_key(F.col("c_mktsegment"), parcel, F.col("c_name")).alias("property_key"))


def content_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_events(spark, sf_dir)
    return e.select("id", text.content_hash(F.concat_ws("|", "property_key", "kind", "event_date", "source_id")).alias("content_id"))


GRAPH = {
    "entry": "rich",
    "nodes": {
        "rich": {"kind": "condition", "signal": "owed", "op": "gte", "value": 5000.0, "then": "building", "else": "poor"},
        "building": {"kind": "condition", "signal": "orders", "op": "gt", "value": 12.0, "then": "ask", "else": "watch"},
        "poor": {"kind": "condition", "signal": "owed", "op": "lt", "value": 0.0, "then": "drop", "else": "watch"},
        "ask": {"kind": "approval", "next": "contact"},
        "contact": {"kind": "action", "name": "contact"},
        "watch": {"kind": "action", "name": "watch"},
        "drop": {"kind": "action", "name": "drop"},
    },
}


def subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.col("c_acctbal").alias("owed"))
    return c.join(n, F.col("c_custkey") == F.col("o_custkey"), "left").drop("o_custkey")


def decision_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = subjects(spark, sf_dir).withColumn("signals", decisions.subject("owed", "orders"))
    return decisions.evaluate(rows, GRAPH).select("c_custkey", "outcome", "requires_approval", F.array_join("trace", ">").alias("trace"), "valid")


def decision_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.coverage(subjects(spark, sf_dir), [("owed", "gte", 5000.0), ("orders", "gt", 12.0), ("orders", "gt", 1e6)])


def market_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the feature is the limit."""
    rows = subjects(spark, sf_dir).withColumn("strength", decisions.strength(F.col("owed"), F.col("orders"), F.lit(1), F.lit(0.0)))
    return decisions.round_robin(rows, "c_nationkey", "strength", "c_custkey", 60).select("place", "c_custkey", "c_nationkey")


def market_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (lifecycle_state, lifecycle_transitions, resolve_fields, resolve_conflicts, edition_history, edition_change, property_signals, county_ranking, county_document, parse_addresses, entity_groups, uniqueness_guard, compatible_buckets, property_keys, content_ids, decision_match, decision_coverage, market_round_robin, market_breakdown)}

SQL_SEGMENTS = "with " + SQL_EVENTS + """,
g as (select *, sum(case when rk = 0 then 1 else 0 end) over (partition by property_key order by event_date, recorded_at, id rows unbounded preceding) as seg from pe)
"""
STATE = "['NORMAL', 'TAX_DELINQUENT', 'FORECLOSURE_FILED', 'AUCTION_SCHEDULED', 'SOLD_AT_AUCTION']"

BEST = "row_number() over (partition by property_key, field order by ruling desc, as_of desc, confidence desc, event_date desc, recorded_at desc, id desc)"

SQL_SIGNALS = "with " + SQL_EVENTS + """,
l as (
  select property_key,
    coalesce(arg_max(amount, (event_date, recorded_at, id)) filter (kind = 'tax_delinquency'), 0.0) as due,
    count(*) filter (kind = 'code_violation') as violations, count(*) filter (kind = 'permit_issued') as permits_issued,
    max(event_date) filter (kind = 'permit_issued') as last_permit_date, max(event_date) filter (kind = 'auction_scheduled') as auction_date,
    max(event_date) filter (kind = 'foreclosure_filed') as foreclosure_filed_date, max(event_date) filter (kind = 'deed_transfer') as last_transfer_date,
    max(event_date) filter (kind = 'sold_at_auction') as sold_date, max(event_date) filter (kind = 'probate_opened') as probate_date,
    count(distinct source_id) as sources, count(*) as events,
    cast(floor((1767225600 - epoch(cast(max(event_date) as timestamp))) / 86400) as bigint) as days_since_event
  from pe group by property_key)
"""

SQL_ADDRESS = """
with a as (
  select 'n' || c_nationkey || '|p:' || c_custkey as property_key, 's' || (c_custkey % 13) as source_id, cast(c_custkey as varchar) as parcel_id,
    'n' || c_nationkey as scope, cast((c_custkey // 3) % 97 + 1 as varchar) as number, 'elm' || ((c_custkey // 3) % 11) as street,
    ['', 'n', 's'][c_custkey % 3 + 1] as directional, ['', 'st', 'ave', 'st'][c_custkey % 4 + 1] as suffix
  from customer),
g as (select *, scope || '|a:' || number || ' ' || street as group_key from a)
"""

HASH = "lpad(lower(to_hex(list_reduce(list_prepend(cast(1469598103934665603 as ubigint), list_transform(range(1, strlen(v) + 1), lambda i: cast(ascii(substr(v, i, 1)) as ubigint))), lambda a, x: cast((cast(xor(a, x) as uhugeint) * 1099511628211) % 18446744073709551616 as ubigint)))), 16, '0')"

ORACLE_SQL = {
    "lifecycle_state": SQL_SEGMENTS + f""", last as (select property_key, max(seg) as seg from g group by property_key)
select l.property_key, cast(coalesce(max(g.rk), 0) as integer) as state_rank, {STATE}[coalesce(max(g.rk), 0) + 1] as state
from last l join g on g.property_key = l.property_key and g.seg = l.seg group by l.property_key""",
    "lifecycle_transitions": SQL_SEGMENTS + f""",
m as (select *, max(rk) over (partition by property_key, seg order by event_date, recorded_at, id rows between unbounded preceding and 1 preceding) as before from g),
t as (select property_key, seg + 1 as seg, max(rk) as left_at from g group by property_key, seg)
select m.property_key, m.id, m.event_date, cast(m.rk as integer) as state_rank, {STATE}[m.rk + 1] as state
from m left join t on t.property_key = m.property_key and t.seg = m.seg
where (m.rk > 0 and m.rk > coalesce(m.before, 0)) or (m.rk = 0 and coalesce(t.left_at, 0) > 0)""",
    "resolve_fields": "with " + SQL_OBSERVATIONS + f"select property_key, field, value, source_id, as_of, confidence from (select *, {BEST} as n from ob) where n = 1",
    "resolve_conflicts": "with " + SQL_OBSERVATIONS + """,
r as (select *, max((ruling, as_of, confidence, event_date, recorded_at, id, value, source_id)) over (partition by property_key, field order by event_date, recorded_at, id rows between unbounded preceding and 1 preceding) as b from ob),
c as (select *, (ruling, as_of, confidence, event_date, recorded_at, id, value, source_id) > b as won from r where b is not null)
select property_key, field, case when won then value else b[7] end as kept_value, case when won then source_id else b[8] end as kept_source_id,
  case when won then b[7] else value end as dropped_value, case when won then b[8] else source_id end as dropped_source_id
from c where value <> b[7]""",
    "edition_history": "with " + SQL_OBSERVATIONS + """,
f as (select *, row_number() over (partition by property_key, field, as_of, source_id order by event_date, recorded_at, id) as n from ob)
select property_key, field, as_of, source_id, value, cast(row_number() over (partition by property_key, field order by as_of desc, event_date, recorded_at, id) as integer) as place from f where n = 1""",
    "edition_change": "with " + SQL_OBSERVATIONS + f""",
b as (select property_key, as_of, cast(substr(value, 2) as double) as current from (select *, {BEST} as n from ob where field = 'assessed_value') where n = 1),
f as (select *, row_number() over (partition by property_key, as_of, source_id order by event_date, recorded_at, id) as n from ob where field = 'assessed_value'),
h as (select *, row_number() over (partition by property_key order by as_of desc, event_date, recorded_at, id) as place from f where n = 1),
p as (select b.property_key, b.current, arg_min(cast(substr(h.value, 2) as double), h.place) as previous from b join h on h.property_key = b.property_key and h.as_of <> b.as_of and cast(substr(h.value, 2) as double) > 0 group by all)
select property_key, current, previous, round((current - previous) / previous, 6) as change from p where current > 0""",
    "property_signals": SQL_SIGNALS + "select * from l",
    "county_ranking": SQL_SIGNALS + "select property_key, due, violations from l order by due desc, violations desc, property_key",
    "county_document": SQL_SIGNALS + "select property_key, due, auction_date, case when due > 0 then round(due / 1000.0, 6) end as debt_to_value from l where violations > 0",
    "parse_addresses": SQL_ADDRESS + "select property_key, concat_ws(' ', number, nullif(directional, ''), street, nullif(suffix, '')) as normal, number, street, suffix, directional, true as locatable from a",
    "entity_groups": SQL_ADDRESS + "select property_key, group_key from g",
    "uniqueness_guard": SQL_ADDRESS + """, t as (select distinct group_key from (select group_key, source_id from g group by all having count(distinct parcel_id) > 1))
select g.property_key, case when t.group_key is not null then g.property_key else g.group_key end as group_key from g left join t on t.group_key = g.group_key""",
    "compatible_buckets": SQL_ADDRESS.replace("with ", "with recursive ", 1) + """, n as (select g.group_key, g.property_key, coalesce(directional, '') as d, coalesce(suffix, '') as s, row_number() over (partition by g.group_key order by g.property_key) as i from g),
st as (
  select distinct group_key, 0::bigint as i, []::struct(d varchar, s varchar)[] as held, null::varchar as property_key, null::integer as bucket from n
  union all
  select group_key, i + 1, case when spot > 0 then list_transform(held, lambda b, j: case when j = spot then {'d': coalesce(nullif(b.d, ''), d), 's': coalesce(nullif(b.s, ''), s)} else b end) else list_append(held, {'d': d, 's': s}) end, key, case when spot > 0 then spot - 1 else len(held) end::integer
  from (select st.group_key, st.i, st.held, n.property_key as key, n.d, n.s, coalesce(list_position(list_transform(held, lambda b: (b.d = '' or n.d = '' or b.d = n.d) and (b.s = '' or n.s = '' or b.s = n.s)), true), 0) as spot
    from st join n on n.group_key = st.group_key and n.i = st.i + 1))
select group_key, property_key, bucket from st where property_key is not null""",
    "property_keys": """select c_custkey, case when c_custkey % 2 = 0 then replace(lower(trim(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', ' ', 'g'))), ' ', '_') || '|p:AB' || c_custkey
  else replace(lower(trim(regexp_replace(c_mktsegment, '[^A-Za-z0-9]+', ' ', 'g'))), ' ', '_') || '|a:' || array_to_string(list_transform(regexp_extract_all(regexp_replace(c_name, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'),
    lambda w: case when regexp_matches(w, '^[0-9]+$') then coalesce(nullif(ltrim(w, '0'), ''), '0') else lower(w) end), ' ') end as property_key from customer""",
    "content_ids": "with " + SQL_EVENTS + f"select id, {HASH} as content_id from (select id, property_key || '|' || kind || '|' || event_date || '|' || source_id as v from pe)",
    "decision_match": """with s as (select c_custkey, c_acctbal as owed, n as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey),
d as (select *, case when owed >= 5000 then case when coalesce(orders > 12, false) then 'contact' else 'watch' end when owed < 0 then 'drop' else 'watch' end as outcome from s)
select c_custkey, outcome, outcome = 'contact' as requires_approval, case when outcome = 'contact' then 'rich>building>ask>contact' when owed >= 5000 then 'rich>building>watch' when owed < 0 then 'rich>poor>drop' else 'rich>poor>watch' end as trace, true as valid from d""",
    "decision_coverage": """with s as (select c_custkey, c_acctbal as owed, n as orders from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey)
select 'owed' as signal, 'gte' as op, 5000.0::double as value, count(owed) as present, coalesce(bool_or(owed >= 5000), false) as reachable from s
union all select 'orders', 'gt', 12.0, count(orders), coalesce(bool_or(orders > 12), false) from s union all select 'orders', 'gt', 1000000.0, count(orders), coalesce(bool_or(orders > 1000000), false) from s""",
    "market_round_robin": """with s as (select c_custkey, c_nationkey, coalesce(c_acctbal, 0.0) * 1000 + coalesce(n, 0) * 100 + 10 as strength from customer left join (select o_custkey, count(*) as n from orders group by 1) on c_custkey = o_custkey),
r as (select *, row_number() over (partition by c_nationkey order by strength desc, c_custkey) as turn, min(c_custkey) over (partition by c_nationkey) as first from s)
select cast(row_number() over (order by turn, first) as integer) as place, c_custkey, c_nationkey from r order by turn, first limit 60""",
    "market_breakdown": "select c_mktsegment, count(*) as n from customer group by 1",
}
