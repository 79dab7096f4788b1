"""Queries on running the catalogue: inserts, differences, freshness, baselines, repairs, budgets, labels, valuation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import operations as ops
from ..operators import valuation, weak_labels
from .derived import SQL_EVENTS, property_events, table

#: 1998-09-01T00:00:00Z and 2024-02-01T00:00:00Z
NOW_ORDERS, NOW_EVENTS = 904608000, 1706745600


def idempotent_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_events(spark, sf_dir).drop("details")
    stored, again = e.where(F.col("id") % 3 == 0), e.union(e)
    return ops.insert_new(stored, again).select("id", "property_key", "event_date")


def unmatched_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.unmatched(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").where("o_totalprice > 100000").select(F.col("o_custkey").alias("k")), "k")


def enrichment_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_events(spark, sf_dir).select("id", "property_key", F.substring_index("property_key", "|", 1).alias("join_key"))
    known = table(spark, sf_dir, "customer")
    keys = property_events(spark, sf_dir).where("amount > 300000").select("property_key").distinct()
    scopes = known.where("c_acctbal > 9000").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where("n_regionkey = 1").select(F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "_").alias("join_key")).distinct()
    # a row for each nation: shuffled by them, all events of one would come to one task
    return ops.enrichment(e, keys, F.broadcast(scopes)).select("id", "property_key")


def latest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.first_by(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice")


def corpus_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select("c_custkey", F.col("c_mktsegment").alias("label"))
    new = table(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select("c_custkey", F.lit("new").alias("label"))
    return ops.merged(old, new, ["c_custkey"])


def filter_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return ops.set_changes(c.where("c_acctbal > 1000"), c.where("c_mktsegment = 'BUILDING' or c_acctbal > 4000"), "c_custkey")


def recency_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the feature is the limit."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))
    return o.orderBy(F.desc_nulls_last("day"), F.desc("o_orderkey")).limit(500)


def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 40).cast("string")).alias("source_id"), F.unix_timestamp(F.col("ts").cast("timestamp")).alias("finished_epoch"))
    users = table(spark, sf_dir, "events").select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 50).cast("string")).alias("source_id")).distinct()
    return ops.freshness(users, e, NOW_EVENTS, 50.0).withColumn("age_hours", F.round("age_hours", 4))


def daily_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    day = F.date_format("ts", "yyyyMMdd").cast("int")
    runs = e.groupBy(F.concat(F.lit("h"), (F.col("user_id") % 20).cast("string")).alias("source_id"), day.alias("seq")).agg((1 - F.avg((F.col("event_type") == "error").cast("double"))).alias("rate"))
    return runs.withColumn("repaired", F.col("seq") % 10 == 0)


def ewma_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ops.baselines(daily_runs(spark, sf_dir)).withColumn("baseline", F.round("baseline", 6))


def drift_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = daily_runs(spark, sf_dir)
    now = runs.groupBy("source_id").agg((F.max_by("rate", "seq") * F.when(F.substring("source_id", 2, 5).cast("int") % 3 == 0, 0.5).otherwise(1.0)).alias("rate"), F.count("*").alias("records"))
    return ops.drifted(ops.baselines(runs), now).select("source_id", "drift")


def repair_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = ops.baselines(daily_runs(spark, sf_dir))
    n = F.substring("source_id", 2, 5).cast("int")
    return ops.repairs(runs.select("source_id", F.when(n % 4 > 0, F.col("baseline")).otherwise(0.0).alias("baseline"), ((n % 7) / 7.0 * 1.2).alias("rate"), (0.5 + (n % 5) / 10.0).alias("mapping_confidence"))).select("source_id", F.round("confidence", 6).alias("confidence"), "resolution")


def rate_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return ops.host_budget(e.select((F.col("user_id") % 25).cast("string").alias("host"), F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 10).cast("long").alias("at_s"), F.col("event_id").alias("id")), per_window=5, window_s=600).select("host", "at_s", "id", "allowed")


def counties_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = property_events(spark, sf_dir)
    return e.groupBy(F.substring_index("property_key", "|", 1).alias("county")).agg(F.count_distinct("property_key").alias("properties"), F.count("*").alias("events"), F.count_distinct("source_id").alias("sources"), F.max("recorded_at").alias("stamp"))


def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy("source").agg(F.count("*").alias("n")).withColumn("held_out", valuation.held_out(F.col("source"), 3))


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, part = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice", "l_quantity", "l_discount", "l_returnflag"), table(spark, sf_dir, "part")
    return li.join(part.select("p_partkey", "p_retailprice"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_returnflag").alias("state"), F.col("l_extendedprice").alias("price"), (F.col("p_retailprice") * F.col("l_quantity") * (1 + F.col("l_discount"))).alias("assessed"), F.col("l_quantity").alias("quantity"))


def state_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.state_ratios(valuation.plausible(sales(spark, sf_dir))).select("state", F.round("ratio", 6).alias("ratio"), F.round("pooled", 6).alias("pooled"))


def mdape(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = valuation.plausible(sales(spark, sf_dir)).withColumn("estimate", F.col("assessed") * 0.95)
    return valuation.error_measures(rows).select("state", F.round("mdape", 6).alias("mdape"), F.round("within_share", 6).alias("within_share"))


def feature_scales(spark: SparkSession, sf_dir: str) -> DataFrame:
    return valuation.feature_scales(sales(spark, sf_dir), ["price", "assessed", "quantity"]).select("feature", F.round("mean", 2).alias("mean"), F.round("std", 2).alias("std"))


LEXICON = (("customer", "owner"), ("seller", "owner"), ("price", "amount"), ("bid", "amount"), ("parcel", "id"), ("date", "date"), ("name", "owner"), ("sale_price", "amount"), ("name_customer", "owner"), ("sale_date", "date"), ("parcel_number", "id"), ("number_parcel", "owner"), ("note_seller", "date"))


def columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = ("customer", "seller", "parcel", "sale", "other"), ("name", "price", "date", "number", "note", "bid", "id")
    pick = lambda xs, n: F.element_at(F.array(*[F.lit(x) for x in xs]), (n % len(xs) + 1).cast("int"))
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("example"), F.concat(pick(a, k), F.when(k % 4 > 0, F.concat(F.lit(" "), pick(b, F.floor(k / 5)))).otherwise("")).alias("name"))


def lexicon(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(LEXICON, "term string, class string")


def labeling_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, lex = columns(spark, sf_dir), lexicon(spark)
    return weak_labels.exact_votes(c, lex).unionByName(weak_labels.token_votes(c, lex))


def label_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lexicon's votes and a third function's that guesses by number."""
    k = F.col("c_custkey")
    guess = table(spark, sf_dir, "customer").where(k % 3 > 0).select(k.alias("example"), F.lit("guess").alias("lf"), F.element_at(F.array(*[F.lit(x) for x in ("owner", "amount", "id", "date")]), (k % 4 + 1).cast("int")).alias("class"))
    return weak_labels.label_model(labeling_votes(spark, sf_dir).unionByName(guess))[0].withColumn("confidence", F.round("confidence", 6))


QUERIES = {f.__name__: f for f in (idempotent_ingest, unmatched_anti, enrichment_semi, latest_run, corpus_merge, filter_changes, recency_top, freshness, ewma_baseline, drift_flag, repair_queue, rate_budget, counties_rollup, holdout_split, state_ratio, mdape, feature_scales, labeling_votes, label_model)}

SQL_RUNS = """
r as (select 'h' || (user_id % 20) as source_id, cast(strftime(ts, '%Y%m%d') as integer) as seq, 1 - avg(case when event_type = 'error' then 1.0 else 0.0 end) as rate from events group by all),
q as (select *, row_number() over (partition by source_id order by seq) as i from r),
b as (
  select source_id, i, seq, rate as baseline, cast(1 as bigint) as good_runs from q where i = 1
  union all select q.source_id, q.i, q.seq, case when q.seq % 10 = 0 then q.rate else 0.7 * b.baseline + 0.3 * q.rate end, case when q.seq % 10 = 0 then 1 else b.good_runs + 1 end
  from b join q on q.source_id = b.source_id and q.i = b.i + 1),
s as (select source_id, arg_max(baseline, i) as baseline, arg_max(good_runs, i) as good_runs, count(*) as records from b group by source_id)
"""
SQL_SALES = "sales as (select l_returnflag as state, l_extendedprice as price, p_retailprice * l_quantity * (1 + l_discount) as assessed, l_quantity as quantity from lineitem join part on l_partkey = p_partkey), ok as (select *, price / assessed as ratio from sales where price >= 5000 and assessed > 0 and price / assessed between 0.1 and 10)"
SQL_COLUMNS = """
c as (select c_custkey as example, ['customer', 'seller', 'parcel', 'sale', 'other'][c_custkey % 5 + 1] as a, case when c_custkey % 4 > 0 then ['name', 'price', 'date', 'number', 'note', 'bid', 'id'][(c_custkey // 5) % 7 + 1] end as b from customer),
lex(term, class) as (values ('customer', 'owner'), ('seller', 'owner'), ('price', 'amount'), ('bid', 'amount'), ('parcel', 'id'), ('date', 'date'), ('name', 'owner'), ('sale_price', 'amount'), ('name_customer', 'owner'), ('sale_date', 'date'), ('parcel_number', 'id'), ('number_parcel', 'owner'), ('note_seller', 'date')),
ev as (select example, class from c join lex on lex.term = concat_ws('_', a, b)),
tv as (select example, min(class) as class from (select distinct example, class from c join (select class, string_split(term, '_') as parts from lex) on len(parts) >= 2 and list_has_all([a, coalesce(b, '')], parts)) group by example having count(*) = 1),
gv as (select example, ['owner', 'amount', 'id', 'date'][example % 4 + 1] as class from c where example % 3 > 0)
"""

ORACLE_SQL = {
    "idempotent_ingest": "with " + SQL_EVENTS + "select id, property_key, event_date from pe where cast(id as bigint) % 3 <> 0",
    "unmatched_anti": "select c_custkey as k from customer where c_custkey not in (select o_custkey from orders where o_totalprice > 100000)",
    "enrichment_semi": "with " + SQL_EVENTS + """, sc as (select distinct regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') as scope from customer join nation on c_nationkey = n_nationkey where c_acctbal > 9000 and n_regionkey = 1)
select id, property_key from pe where property_key in (select property_key from pe where amount > 300000) or split_part(property_key, '|', 1) in (select scope from sc)""",
    "latest_run": "select o_custkey, o_orderkey, o_totalprice from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as n from orders) where n = 1",
    "corpus_merge": "select c_custkey, case when c_custkey % 2 = 0 then c_mktsegment else 'new' end as label from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0",
    "filter_changes": """with p as (select c_custkey from customer where c_acctbal > 1000), a as (select c_custkey from customer where c_mktsegment = 'BUILDING' or c_acctbal > 4000)
select coalesce(p.c_custkey, a.c_custkey) as c_custkey, case when p.c_custkey is not null and a.c_custkey is not null then 'remaining' when a.c_custkey is not null then 'removed' else 'added' end as change from p full join a on p.c_custkey = a.c_custkey""",
    "recency_top": "select o_orderkey, strftime(o_orderdate, '%Y-%m-%d') as day from orders order by day desc, o_orderkey desc limit 500",
    "freshness": """with s as (select distinct event_type || '/' || (user_id % 50) as source_id from events), r as (select event_type || '/' || (user_id % 40) as source_id, max(floor(epoch(ts))) as last from events group by 1),
a as (select source_id, (1706745600 - last) / 3600.0 as age from s left join r using (source_id))
select source_id, round(age, 4) as age_hours, case when age is null then 'undated' when age > 50 then 'stale' else 'ok' end as status from a""",
    "ewma_baseline": "with recursive " + SQL_RUNS + "select source_id, round(baseline, 6) as baseline, good_runs from s",
    "drift_flag": "with recursive " + SQL_RUNS + ", n as (select source_id, arg_max(rate, seq) * case when cast(substr(source_id, 2) as integer) % 3 = 0 then 0.5 else 1.0 end as rate from r group by source_id) select source_id, coalesce(good_runs > 0 and (records = 0 or rate < 0.6 * baseline), false) as drift from s join n using (source_id)",
    "repair_queue": "with recursive " + SQL_RUNS + """, p as (select source_id, case when cast(substr(source_id, 2) as integer) % 4 > 0 then baseline else 0.0 end as baseline, (cast(substr(source_id, 2) as integer) % 7) / 7.0::double * 1.2 as rate, 0.5 + (cast(substr(source_id, 2) as integer) % 5) / 10.0::double as mc from s),
c as (select *, 0.5 * mc + 0.5 * case when baseline > 0 then least(1.0, rate / baseline) else rate end as confidence from p)
select source_id, round(confidence, 6) as confidence, case when confidence >= 0.75 and case when baseline > 0 then rate >= 0.7 * baseline else rate > 0 end then 'auto' else 'pending' end as resolution from c""",
    "counties_rollup": "with " + SQL_EVENTS + "select split_part(property_key, '|', 1) as county, count(distinct property_key) as properties, count(*) as events, count(distinct source_id) as sources, max(recorded_at) as stamp from pe group by 1",
    "holdout_split": "select source, count(*) as n, cast('0x' || substr(sha256(source), 1, 2) as integer) % 3 = 0 as held_out from documents group by source",
    "state_ratio": "with " + SQL_SALES + " select state, round(median(ratio), 6) as ratio, round((select median(ratio) from ok), 6) as pooled from ok group by state",
    "mdape": "with " + SQL_SALES + ", e as (select state, abs(assessed * 0.95 - price) / price as off from ok) select state, round(median(off), 6) as mdape, round(avg(case when off <= 0.1 then 1.0 else 0.0 end), 6) as within_share from e group by state",
    "feature_scales": "with " + SQL_SALES + " select f as feature, round(avg(x), 2) as mean, round(stddev_pop(x), 2) as std from (select unnest(['price', 'assessed', 'quantity']) as f, unnest([price, assessed, cast(quantity as double)]) as x from sales) group by f",
    "labeling_votes": "with " + SQL_COLUMNS + "select example, 'lexicon_exact' as lf, class from ev union all select example, 'lexicon_token', class from tv",
    "label_model": "with recursive " + SQL_COLUMNS + """,
vt as (select example, ev.class as e, tv.class as t, gv.class as g from c left join ev using (example) left join tv using (example) left join gv using (example)),
pt as (select e, t, g, count(*) as n from vt where coalesce(e, t, g) is not null group by all),
rd as (
  select 0 as i, [1.0::double, 1.0, 1.0] as w, false as done
  union all
  select i + 1, nw, list_bool_and(list_transform([1, 2, 3], lambda k: abs(nw[k] - w[k]) <= 1e-4 + 1e-5 * abs(w[k]))) from (
    select i, w, list_transform([re, rt, rg], lambda p: case when p is null then 0.1 else greatest(0.05, ln(greatest(p, 1e-3) / greatest(1 - p, 1e-3))) end) as nw from (
      select i, w, sum(case when e = best.c then n else 0 end) filter (e is not null and sure)::double / sum(n) filter (e is not null and sure) as re,
        sum(case when t = best.c then n else 0 end) filter (t is not null and sure)::double / sum(n) filter (t is not null and sure) as rt,
        sum(case when g = best.c then n else 0 end) filter (g is not null and sure)::double / sum(n) filter (g is not null and sure) as rg
      from (select *, -best.s / total >= 0.5 as sure from (
        select rd.i, rd.w, pt.*, list_min(list_transform(list_filter([e, t, g], lambda x: x is not null), lambda x: {'s': -(case when e = x then w[1] else 0 end + case when t = x then w[2] else 0 end + case when g = x then w[3] else 0 end), 'c': x})) as best,
          case when e is null then 0 else w[1] end + case when t is null then 0 else w[2] end + case when g is null then 0 else w[3] end as total
        from rd cross join pt where not done and i < 20))
      group by i, w))),
fw as (select w from rd order by i desc limit 1),
sc as (select example, list_min(list_transform(list_filter([e, t, g], lambda x: x is not null), lambda x: {'s': -(case when e = x then w[1] else 0 end + case when t = x then w[2] else 0 end + case when g = x then w[3] else 0 end), 'c': x})) as best,
  case when e is null then 0 else w[1] end + case when t is null then 0 else w[2] end + case when g is null then 0 else w[3] end as total from vt cross join fw where coalesce(e, t, g) is not null)
select example, best.c as class, round(-best.s / total, 6) as confidence from sc""",
    "rate_budget": """with recursive r as (select cast(user_id % 25 as varchar) as host, cast(floor(floor(epoch(ts)) / 10) as bigint) as at_s, event_id as id from events),
n as (select *, row_number() over (partition by host order by at_s, id) as i from r),
w as (
  select host, at_s, id, i, at_s as opened, 1 as used, true as allowed from n where i = 1
  union all select n.host, n.at_s, n.id, n.i, case when n.at_s >= opened + 600 then n.at_s else opened end, case when n.at_s >= opened + 600 then 1 when used < 5 then used + 1 else used end, n.at_s >= opened + 600 or used < 5
  from w join n on n.host = w.host and n.i = w.i + 1)
select host, at_s, id, allowed from w""",
}
