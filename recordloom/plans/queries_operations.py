"""Queries on sources and runs, names and links, labels, features and repairs: the operators of a running catalogue."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators import classify, mapping, runs, valuation, weak_labels
from ..sources import formats, web
from .derived import SQL_EVENTS, property_events, table

def pick(values: tuple[str, ...], at: F.Column) -> F.Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")


def same_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against its maker's words in another order, and against the next size's name."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    other = F.when(F.col("p_partkey") % 3 == 0, F.concat(F.upper(F.substring_index("p_name", " ", -1)), F.lit(", "), F.substring_index("p_name", " ", 1))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("s"))).otherwise(F.col("p_brand"))
    return p.select("p_partkey", other.alias("other"), names.same_owner(F.col("p_name"), other).alias("same"))


MARKETS = ("city_of_norfolk_va", "Elm County", "Newport  News, va", "prince_george_county_md", "of", "City of San José CA", "king_county_wa")


def markets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jurisdictions as places, markets and labels, and links to the customers' addresses there."""
    j = F.concat(pick(MARKETS, F.col("c_custkey")), F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.concat(F.lit("_"), F.lower(F.substring("c_mktsegment", 1, 2)))))
    address = F.when(F.col("c_custkey") % 11 == 0, " ").otherwise(F.concat((F.col("c_custkey") % 900).cast("string"), F.lit("  Oak (St) #"), F.col("c_nationkey").cast("string")))
    c = table(spark, sf_dir, "customer").select("c_custkey", j.alias("jurisdiction"), address.alias("address"))
    a, b = F.col("address"), F.col("jurisdiction")
    link = names.links_for(a, b)
    return c.select("c_custkey", "jurisdiction", names.place_of(b).alias("place"), names.market_of(b).alias("market"), names.market_label(b).alias("label"), link["maps"].alias("maps"), link["homes"].alias("homes"))


def service_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of feature services' rows, and encoded names."""
    k = F.col("p_partkey")
    service = F.concat(F.lit("https://gis.example.org/"), pick(("arcgis/FeatureServer", "x/featureserver/", "arcgis/FeatureServer/3//", "MapServer", "rest/12"), k))
    return table(spark, sf_dir, "part").select("p_partkey", names.rows_url(service).alias("rows"), names.url_encode(F.concat_ws("~", "p_name", "p_brand")).alias("encoded"))


def stamp_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from an order's stamp to a day after it, in forms that a stamp may have."""
    day = lambda f: F.date_format("o_orderdate", f)
    start = F.when(F.col("o_orderkey") % 4 == 0, day("yyyy-M-d")).when(F.col("o_orderkey") % 4 == 1, F.concat(day("yyyy-MM-dd"), F.lit("T05:30"))).when(F.col("o_orderkey") % 4 == 2, F.concat(day("yyyy-MM"), F.lit("-31"))).otherwise("soon")
    end = F.concat(day("yyyy-MM-dd"), F.lit("T"), F.lpad((F.col("o_orderkey") % 24).cast("string"), 2, "0"), F.lit(":00:00Z"))
    seconds = F.unix_date(F.to_date("o_orderdate")).cast("long") * 86400 + F.col("o_orderkey") % 86400
    return orders(spark, sf_dir).select("o_orderkey", names.hours_between(start, end).alias("hours"), names.iso_from_unix(seconds).alias("stamp"))


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as runs of their customers' sources."""
    return orders(spark, sf_dir).select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("source_id"), F.col("o_orderkey").alias("seq"), (F.col("o_orderkey") % 13 == 0).alias("truncated"), F.floor("o_totalprice").cast("long").alias("total_ms"), F.when(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 500)).alias("fetch_ms"), (F.col("o_orderkey") % 50).alias("parse_ms"))


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as sources of their nations' counties."""
    k = F.col("c_custkey")
    url = F.concat(F.lit("https://data.example.org/q?"), pick(("limit=5", "parcel={parcels}", "street={streets}", "n={numbers}"), k))
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"))
    return table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select(F.concat(F.lit("c"), k.cast("string")).alias("source_id"), F.col("n_name").alias("jurisdiction"), F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "_").alias("county"), url.alias("url"), (k % 10 > 0).alias("enabled"))


def wave_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = runs.waves(source_rows(spark, sf_dir)).select("source_id", "wave")
    return runs.wave_totals(run_rows(spark, sf_dir).join(w, "source_id"))


def stage_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.stage_times(run_rows(spark, sf_dir), ["fetch_ms", "parse_ms", "total_ms"]).withColumn("mean_ms", F.round("mean_ms", 6))


def measured_stages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and cells of three stages over the orders, as Spark counted them while they ran; their times aren't the same twice."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")
    stages = [
        ("large", lambda d: d.where("o_totalprice > 100000")),
        ("shown", lambda d: d.withColumn("status", F.when(F.col("o_orderstatus") == "F", F.col("o_orderstatus")))),
        ("by_customer", lambda d: d.groupBy("o_custkey").agg(F.count("status").alias("n"), F.max("status").alias("status"))),
    ]
    return runs.measured(o, stages, "r")[1].select("place", "stage", "rows", "cells")


def data_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fifty jurisdictions in each nation, so that some of them are complete."""
    part = lambda k: F.concat(F.lit("_"), (k.cast("long") % 50).cast("string"))
    e = property_events(spark, sf_dir)
    county = F.concat(F.substring_index("property_key", "|", 1), part(F.substring_index("property_key", ":", -1)))
    sizes = e.groupBy(county.alias("county")).agg(F.count("*").alias("events"), F.count_distinct("property_key").alias("properties"))
    sources = source_rows(spark, sf_dir).select(F.concat("county", part(F.substring("source_id", 2, 20))).alias("county"), "source_id")
    return runs.data_complete(sources, run_rows(spark, sf_dir), sizes)


def sweep_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    state = F.when(F.col("o_orderkey") % 10 == 0, "running").when(F.col("o_orderkey") % 97 == 0, "errored").when(F.col("o_orderkey") % 89 == 0, "terminated").otherwise("complete")
    return runs.sweeps(orders(spark, sf_dir).select(F.col("o_custkey").alias("sweep"), state.alias("state")))


def event_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.outcomes(table(spark, sf_dir, "events").select(F.col("event_type").alias("outcome")))


def largest_jurisdiction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-1 report: the feature is the limit."""
    return runs.largest(property_events(spark, sf_dir).select("property_key").distinct().select(F.substring_index("property_key", "|", 1).alias("jurisdiction")))


def latest_tenant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-1 report: the customer with a good balance whose last order is the newest."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("tenant_id"), "c_acctbal")
    return runs.latest_tenant(c.select("tenant_id"), c.where("c_acctbal > 0"), orders(spark, sf_dir).select(F.col("o_custkey").alias("tenant_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("at")))


def fetch_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each page would be taken, by content types that servers might name."""
    k = F.col("page_id")
    kind = pick(("text/html", "application/JSON", "application/pdf", "text/csv; charset=utf-8", ""), k)
    url = F.when(k % 7 == 0, F.concat(F.lit("render+"), "url")).when(k % 11 == 0, "data/page.html").otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", formats.fetch_mode(url, kind, F.col("html")).alias("mode"))


def most_owed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of 20,000 properties: the feature is the limit."""
    e = property_events(spark, sf_dir).groupBy("property_key").agg(F.max(F.when(F.col("kind") == "tax_delinquency", F.col("amount"))).alias("owed"))
    return runs.most_owed(e).select("property_key", "owed")


def recent_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The window of 10,000 events: the feature is the limit."""
    return runs.recent(property_events(spark, sf_dir).select("id", "recorded_at", F.when(F.col("id").cast("long") % 17 > 0, F.col("event_date")).alias("event_date")))


def repair_rows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    o = orders(spark, sf_dir)
    repairs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("source_id"), F.when(F.col("o_orderkey") % 5 == 0, "approved").otherwise("pending").alias("resolution"), F.when(F.col("o_orderkey") % 7 == 0, "").otherwise(F.concat(F.lit("m"), F.col("o_orderkey").cast("string"))).alias("mapping"))
    decisions = o.where(F.col("o_orderkey") % 3 < 2).select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 3 == 0).alias("approved"))
    states = table(spark, sf_dir, "customer").where("c_custkey % 4 > 0").select(F.col("c_custkey").alias("source_id"), F.lit("old").alias("mapping"), (F.col("c_custkey") % 9).alias("good_runs"))
    return repairs, decisions, states


def resolved_repairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs, decisions, _ = repair_rows(spark, sf_dir)
    return runs.resolved_repairs(repairs, decisions).select("id", "resolution", "error", "applied")


def repaired_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    repairs, decisions, states = repair_rows(spark, sf_dir)
    return runs.repaired_states(states, runs.resolved_repairs(repairs, decisions))


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("owed"))
    s = table(spark, sf_dir, "orders").groupBy((F.col("o_custkey") * 2).alias("k")).agg(F.lit(None).cast("string").alias("name"), F.max("o_totalprice").alias("owed"))
    return runs.upserted(c, s, ["k"])


def catalogue_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as sources; parts' brands are added, every tenth is removed."""
    url = lambda c: F.concat(F.lit("https://x.org/"), F.lower(c))
    have = table(spark, sf_dir, "supplier").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("name"), url("s_name").alias("url"))
    more = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_brand", "p_type").alias("name"), url(F.concat("p_brand", "p_type")).alias("url"))
    gone = table(spark, sf_dir, "supplier").where("s_suppkey % 10 = 0").select(F.concat(F.lit("s-"), F.col("s_suppkey").cast("string")).alias("source_id"))
    return runs.removed(runs.added(have, more), gone, "id")


def expanded_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources' addresses with what is known of their jurisdictions filled in; streets come from every customer's address."""
    k = F.col("c_custkey")
    n = F.broadcast(table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"))
    c = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    scope = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "_")
    address = F.concat((k % 700 + 1).cast("string"), F.lit(" "), pick(("Oak", "Elm", "Fir", "Ash", "O'Hara"), k), F.lit(" St"))
    known = c.where("n_regionkey > 0").select(F.concat(scope, F.lit("|p:"), F.lpad(k.cast("string"), 7, "0")).alias("property_key"), address.alias("address"), k.alias("seq"))
    return runs.expanded(source_rows(spark, sf_dir).select("source_id", "jurisdiction", "url"), known)


def field_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's fields as valid or not, by source."""
    each = F.explode(F.array(F.struct(F.lit("owed").alias("field"), (F.col("o_totalprice") > 50000).alias("ok")), F.struct(F.lit("status").alias("field"), (F.col("o_orderstatus") != "P").alias("ok")))).alias("x")
    cells = orders(spark, sf_dir).select(F.concat(F.lit("s"), (F.col("o_orderkey") % 14).cast("string")).alias("source_id"), F.col("o_orderkey").alias("record"), each).select("source_id", "record", "x.field", "x.ok")
    per = cells.groupBy("source_id", "record").agg(F.avg(F.col("ok").cast("double")).alias("completeness"))
    rates = mapping.field_rates(cells).unionByName(mapping.overall_rates(per).select("source_id", F.lit("all").alias("field"), "rate"))
    return rates.withColumn("rate", F.round("rate", 9))


def mapping_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored mappings of parts to brands: what is wrong with them, and the confidence of each."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("source_id"), F.concat("p_brand", F.col("p_size").cast("string")).alias("name"), F.col("p_name").alias("label"), (F.col("p_partkey") % 3 - 1).cast("int").alias("part"), ((F.col("p_partkey") % 1010) / 1000.0).cast("double").alias("confidence"))
    sure = mapping.mapping_confidence(p).select("source_id", F.lit("confidence").alias("fault"), F.round("confidence", 6).cast("string").alias("at"))
    faults = mapping.mapping_faults(p).groupBy("source_id", "fault").agg(F.count("*").cast("string").alias("at"))
    return faults.unionByName(sure)


WORDS_OF = ("customer", "seller", "parcel", "sale", "other", "customers list", "parc", "zzz")
FIELDS = (("mail", "email"), ("tel", "phone"), ("due", "money"), ("day", "date"), ("note", "text"))


def value_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as columns of two or three values of one kind."""
    k = F.col("c_custkey")
    made = lambda i: F.when(k % 6 == 0, F.concat(F.lit("a"), (k + i).cast("string"), F.lit("@mail.org"))).when(k % 6 == 1, F.concat(F.lit("("), F.lpad(((k + i) % 1000).cast("string"), 3, "0"), F.lit(") 555-0100"))).when(k % 6 == 2, F.concat(F.lit("2024-01-"), F.lpad((k % 28 + 1).cast("string"), 2, "0"))).when(k % 6 == 3, F.lit("-")).when(k % 6 == 4, F.concat(F.lit("word "), (k + i).cast("string"))).otherwise(F.when(F.lit(i) == 0, "a1@mail.org").otherwise("none here"))
    return table(spark, sf_dir, "customer").select(k.alias("example"), pick(("a.org", "b.org"), k).alias("domain"), pick(WORDS_OF, k).alias("name"), pick(WORDS_OF, F.floor(k / 3)).alias("display"), F.when(k % 7 == 0, F.array(made(0))).otherwise(F.array(made(0), made(1))).alias("values"))


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field string, kind string")


def validator_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = value_columns(spark, sf_dir)
    told = table(spark, sf_dir, "supplier").select(pick(("a.org", "b.org"), F.col("s_suppkey")).alias("domain"), pick(WORDS_OF, F.floor(F.col("s_suppkey") / 2)).alias("name"), pick(("due", "", "tel"), F.col("s_suppkey")).alias("label"), F.col("s_suppkey").alias("seq"))
    return weak_labels.unique_votes(c, fields(spark)).unionByName(weak_labels.veto_votes(c, fields(spark))).unionByName(weak_labels.told_votes(c, told))


LEXICON = (("customer", "owner"), ("seller", "owner"), ("parcel", "id"), ("sale", "amount"))


def weak_label_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.weak_labels(value_columns(spark, sf_dir).select("example", "name", "display"), spark.createDataFrame(LEXICON, "term string, class string"))


def corpus_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weak_labels.corpus_counts(value_columns(spark, sf_dir).select("domain", "name", F.when(F.col("example") % 2 == 0, F.col("name")).alias("label"), F.lit("lexicon").alias("label_source")))


def vote_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled columns that the votes speak against, by fixed weights of the functions."""
    votes = weak_labels.unique_votes(value_columns(spark, sf_dir), fields(spark)).unionByName(weak_labels.veto_votes(value_columns(spark, sf_dir), fields(spark)))
    truth = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("example"), F.when(F.col("c_custkey") % 4 == 0, "mail").otherwise("none").alias("class"))
    return weak_labels.suspects(votes, truth, {"validator_unique": 0.5, "validator_veto": 2.0}).select("example", "class", "given", "suspicion_rank")


def overall_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, guess = pick(("none", "a", "b", "c"), F.col("l_orderkey")), pick(("none", "a", "b"), F.col("l_orderkey") + F.col("l_linenumber"))
    s = classify.overall(table(spark, sf_dir, "lineitem").select(truth.alias("truth"), guess.alias("guess")))
    return s.select(F.round("macro_f1", 9).alias("macro_f1"), F.round("positive_accuracy", 9).alias("positive_accuracy"), "examples")


def page_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the pages' features: format, title, headings and URL."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("doc"), "url", formats.page_projection(F.col("html")).alias("p"))
    bag = classify.features(p.select("doc", F.lit("html").alias("format"), F.array().cast("array<string>").alias("labels"), F.col("p.title").alias("title"), F.col("p.headings").alias("headings"), F.lit("").alias("text"), "url"))
    return bag.groupBy("token").agg(F.sum("n").alias("n"), F.count("*").alias("docs"))


def nb_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Smoothing constants for telling a document's source by its words, left one out."""
    d = table(spark, sf_dir, "documents").where("doc_id is not null").select(F.col("doc_id").alias("doc"), F.col("source").alias("class"), "text")
    texts, labels = classify.text_blocks(d, "doc", F.col("text"), "class", limit=None), d.select("doc", "class")
    return classify.sweep(labels, texts, *classify.train(texts, labels)).withColumn("accuracy", F.round("accuracy", 9))


def use_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat_ws(" ", "p_name", pick(("Residential", "town home", "Apartments", "LAND", "commercial lot", "condominium", "Industrial", "agric", "exempt"), F.col("p_partkey")))
    return table(spark, sf_dir, "part").select("p_partkey", valuation.use_group(text).alias("use"), valuation.use_group_of_states(text).alias("use_of_states"))


def value_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_returnflag").alias("state"), F.col("l_extendedprice").alias("estimate"))
    errors = table(spark, sf_dir, "lineitem").where("l_returnflag != 'N'").groupBy(F.col("l_returnflag").alias("state")).agg((F.max("l_discount") * 2).alias("mdape"))
    r = valuation.ranged(e, errors)
    return r.select("l_orderkey", "l_linenumber", *[F.round(c, 2).alias(c) for c in ("estimate", "low", "high")])


def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages' links: pagination before others, each target once, 40 a page at most (a crawl's limit)."""
    return web.ordered_links(table(spark, sf_dir, "pages").select("page_id", "url", "html"), 40).select("page_id", "place", "target")


QUERIES = {f.__name__: f for f in (same_owners, markets, service_rows, stamp_hours, wave_totals, stage_times, measured_stages, data_complete, sweep_states, event_outcomes, largest_jurisdiction, latest_tenant, fetch_modes, most_owed, recent_events, resolved_repairs, repaired_states, upserted, catalogue_changes, expanded_urls, field_rates, mapping_checks, validator_votes, weak_label_masks, corpus_counts, vote_suspects, overall_scores, page_features, nb_sweep, use_groups, value_ranges, page_links)}

WORDS = "list_transform(regexp_extract_all(regexp_replace({}, '([a-z])([A-Z])', '\\1 \\2', 'g'), '[A-Za-z0-9]+'), lambda w: lower(w))"
CAPITAL = "list_transform({}, lambda p: upper(substr(p, 1, 1)) || substr(p, 2))"
STOP = ", ".join(f"'{w}'" for w in classify.STOP)
KEPT = "list_filter({}, lambda w: length(w) >= 2 and not list_contains([" + STOP + "], w) and not regexp_matches(w, '^[0-9]+$'))"
MARKET_NAMES = ", ".join(f"'{m}'" for m in MARKETS)
ESCAPED = "replace(replace(replace(replace(replace(url_encode({}), '%21', '!'), '%27', ''''), '%28', '('), '%29', ')'), '%2A', '*')"
SQL_SOURCES = """
src as (select 'c' || c_custkey as source_id, n_name as jurisdiction, regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') as county, c_custkey as k, c_custkey % 10 > 0 as enabled, n_regionkey,
  'https://data.example.org/q?' || ['limit=5', 'parcel={parcels}', 'street={streets}', 'n={numbers}'][c_custkey % 4 + 1] as url from customer join nation on c_nationkey = n_nationkey)
"""
SQL_REPAIRS = """
r as (select o_orderkey as id, o_custkey as source_id, case when o_orderkey % 5 = 0 then 'approved' else 'pending' end as was, case when o_orderkey % 7 = 0 then '' else 'm' || o_orderkey end as mapping, case when o_orderkey % 3 < 2 then o_orderkey % 3 = 0 end as approved from orders),
n as (select *, approved is not null and was <> 'pending' as late from r),
d as (select id, source_id, mapping, case when late or approved is null then was when approved then 'approved' else 'rejected' end as resolution, case when late then 'already resolved (' || was || ')' end as error, coalesce(approved, false) and not late as applied from n)
"""
SQL_VALUES = """
vc as (select c_custkey as example, c_custkey as k, ['a.org', 'b.org'][c_custkey % 2 + 1] as domain, ['customer', 'seller', 'parcel', 'sale', 'other', 'customers list', 'parc', 'zzz'][c_custkey % 8 + 1] as name,
  ['customer', 'seller', 'parcel', 'sale', 'other', 'customers list', 'parc', 'zzz'][(c_custkey // 3) % 8 + 1] as display from customer),
uv as (select example, 'validator_unique' as lf, case k % 6 when 0 then 'mail' when 1 then 'tel' when 2 then 'day' end as class from vc where k % 7 > 0 and k % 6 < 3),
vv as (select example, 'validator_veto' as lf, 'none' as class from vc where k % 7 > 0 and k % 6 = 3)
"""

ORACLE_SQL = {
    "same_owners": f"""with p as (select p_partkey, p_name, case p_partkey % 3 when 0 then upper(split_part(p_name, ' ', -1)) || ', ' || split_part(p_name, ' ', 1) when 1 then p_name || 's' else p_brand end as other from part),
s as (select *, array_to_string(list_sort({WORDS.format('p_name')}), ' ') as x, array_to_string(list_sort({WORDS.format('other')}), ' ') as y from p)
select p_partkey, other, x <> '' and y <> '' and (x = y or jaro_winkler_similarity(x, y) >= 0.93) as same from s""",
    "markets": f"""with c as (select c_custkey, [{MARKET_NAMES}][c_custkey % 7 + 1] || case when c_custkey % 2 = 0 then '' else '_' || lower(substr(c_mktsegment, 1, 2)) end as j, case when c_custkey % 11 = 0 then ' ' else (c_custkey % 900) || '  Oak (St) #' || c_nationkey end as address from customer),
p as (select *, trim(array_to_string(list_transform(list_filter(string_split(j, '_'), lambda x: x not in ('city', 'of', 'county')), lambda x: case when length(x) = 2 then upper(x) else upper(substr(x, 1, 1)) || substr(x, 2) end), ' ')) as place,
  list_filter(string_split(regexp_replace(regexp_replace(lower(trim(j)), '[^a-z0-9_]', '_', 'g'), '^_+|_+$', '', 'g'), '_'), lambda x: x <> '') as w, regexp_replace(lower(j), '[^a-z0-9]+', '_', 'g') as k from c),
m as (select *, len(w) > 0 and length(w[-1]) = 2 as stated from p),
n as (select *, array_to_string(list_transform(case when stated then w[1:-2] else w end, lambda x, i: case when x = 'of' and i > 1 then x else upper(substr(x, 1, 1)) || substr(x, 2) end), ' ') as named, upper(regexp_extract(k, '_([a-z]{{2}})$', 1)) as st,
  array_to_string({CAPITAL.format("list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(k, '_[a-z]{2}$', ''), '^city_of_', ''), '_county$', ''), '_'), lambda x: x <> '')")}, ' ') as bare,
  case when trim(address) <> '' then trim(address) || case when place = '' then '' else ', ' || place end end as full_address from m)
select c_custkey, j as jurisdiction, place, case when regexp_matches(trim(j), '(?i)^(.+?),\\s*([a-z]{{2}})$') then trim(regexp_extract(trim(j), '(?i)^(.+?),\\s*([a-z]{{2}})$', 1)) || ', ' || upper(regexp_extract(trim(j), '(?i)^(.+?),\\s*([a-z]{{2}})$', 2))
  when stated and named <> '' then named || ', ' || upper(w[-1]) else named end as market, case when st = '' then bare else bare || ', ' || st end as label,
  'https://www.google.com/maps/search/?api=1&query=' || {ESCAPED.format("regexp_replace(full_address, '\\s+', ' ', 'g')")} as maps,
  'https://www.zillow.com/homes/' || regexp_replace(regexp_replace(full_address, '\\s+', '-', 'g'), '[^A-Za-z0-9-]', '', 'g') || '_rb/' as homes from n""",
    "service_rows": """select p_partkey, 'https://gis.example.org/' || ['arcgis/FeatureServer/0', 'x/featureserver/0', 'arcgis/FeatureServer/3', null, 'rest/12'][p_partkey % 5 + 1] || '/query?where=1%3D1&outFields=*&f=json&resultRecordCount=50' as rows,
  replace(url_encode(p_name || '~' || p_brand), '~', '%7E') as encoded from part""",
    "stamp_hours": """with o as (select o_orderkey, cast(o_orderdate as date) as d, o_orderkey % 4 as k, case when o_orderkey % 4 = 0 then epoch(cast(cast(o_orderdate as date) as timestamp)) when o_orderkey % 4 = 1 then epoch(cast(cast(o_orderdate as date) as timestamp)) + 19800
  when o_orderkey % 4 = 2 then epoch(cast(date_trunc('month', o_orderdate) as timestamp)) + 30 * 86400 end as a, epoch(cast(cast(o_orderdate as date) as timestamp)) + (o_orderkey % 24) * 3600 as b from orders)
select o_orderkey, coalesce((b - a) / 3600.0, -1.0) as hours, strftime(cast(d as timestamp) + to_seconds(o_orderkey % 86400), '%Y-%m-%dT%H:%M:%SZ') as stamp from o""",
    "wave_totals": "with " + SQL_SOURCES + "select case when contains(url, '{parcels}') then 2 else 1 end as wave, count(*) as runs, cast(sum(cast(floor(o_totalprice) as bigint)) as bigint) as total_ms from orders join src on src.k = o_custkey where enabled group by 1",
    "stage_times": """with r as (select unnest(['fetch_ms', 'parse_ms', 'total_ms']) as stage, unnest([case when o_orderkey % 3 > 0 then o_orderkey % 500 end, o_orderkey % 50, cast(floor(o_totalprice) as bigint)])::double as ms from orders)
select stage, count(*) as runs, round(avg(ms), 6) as mean_ms, max(ms) as most_ms from r where ms is not null group by stage""",
    "measured_stages": """with l as (select o_custkey, case when o_orderstatus = 'F' then 'F' end as status from orders where o_totalprice > 100000),
c as (select o_custkey, count(status) as n, max(status) as status from l group by o_custkey)
select 0 as place, 'large' as stage, count(*) as rows, 4 * count(*) as cells from l union all select 1, 'shown', count(*), 4 * count(*) + count(status) from l union all select 2, 'by_customer', count(*), 2 * count(*) + count(status) from c""",
    "data_complete": "with " + SQL_EVENTS + ", " + SQL_SOURCES + """, l as (select o_custkey as k, arg_max(o_orderkey % 13 = 0, o_orderkey) as truncated from orders group by 1),
w as (select county || '_' || (k % 50) as county, bool_and(coalesce(not truncated, false)) as whole from src left join l using (k) group by 1),
z as (select split_part(property_key, '|', 1) || '_' || (cast(split_part(property_key, ':', 2) as bigint) % 50) as county, count(*) as events, count(distinct property_key) as properties from pe group by 1)
select county, coalesce(whole, false) and events <= 10000 and properties < 20000 as complete from z left join w using (county)""",
    "sweep_states": """with s as (select o_custkey as sweep, case when o_orderkey % 10 = 0 then 'running' when o_orderkey % 97 = 0 or o_orderkey % 89 = 0 then 'failed' else 'complete' end as state from orders),
n as (select sweep, count(*) filter (state = 'complete') as completed, count(*) filter (state = 'failed') as failed, count(*) as total from s group by sweep)
select sweep, completed, failed, total, case when completed + failed < total then 'running' when failed > 0 then 'error' else 'complete' end as state from n""",
    "event_outcomes": "select event_type as outcome, count(*) as n from events group by 1",
    "largest_jurisdiction": "with " + SQL_EVENTS + "select split_part(property_key, '|', 1) as jurisdiction, count(distinct property_key) as properties from pe group by 1 order by 2 desc, 1 limit 1",
    "latest_tenant": """select c_custkey as tenant_id, max(strftime(o_orderdate, '%Y-%m-%d')) as last_at from customer left join orders on o_custkey = c_custkey where c_acctbal > 0 group by 1 order by 2 desc nulls last, 1 limit 1""",
    "fetch_modes": r"""with p as (select page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?s)<[^>]*>', '', 'g') as bare,
  array_to_string(regexp_extract_all(html, '(?is)<script\b[^>]*>(.*?)</script\s*>', 1), '') as script, lower(html) as low from pages),
s as (select *, regexp_matches(low, 'id="(root|app|__next)"\s*>\s*</div>|data-reactroot|ng-app') or strlen(trim(bare)) * 4 < strlen(script) as shell from p)
select page_id, case when page_id % 7 = 0 then 'rendered' when page_id % 5 in (1, 3) then 'api' when page_id % 5 = 2 then 'document' when shell and page_id % 11 > 0 then 'shell' else 'html' end as mode from s""",
    "most_owed": "with " + SQL_EVENTS + "select property_key, max(case when kind = 'tax_delinquency' then amount end) as owed from pe group by 1 order by owed desc nulls first, property_key limit 20000",
    "recent_events": "with " + SQL_EVENTS + "select id, recorded_at, case when cast(id as bigint) % 17 > 0 then event_date end as event_date from pe order by 3 desc nulls last, recorded_at desc, id limit 10000",
    "resolved_repairs": "with " + SQL_REPAIRS + "select id, resolution, error, applied from d",
    "repaired_states": "with " + SQL_REPAIRS + """, s as (select c_custkey as source_id, 'old' as mapping, c_custkey % 9 as good_runs from customer where c_custkey % 4 > 0), m as (select source_id, arg_max(mapping, id) as new from d where applied and mapping <> '' group by 1)
select coalesce(s.source_id, m.source_id) as source_id, coalesce(new, s.mapping) as mapping, case when new is not null then 0 else good_runs end as good_runs from s full join m on s.source_id = m.source_id""",
    "upserted": """with n as (select o_custkey * 2 as k, max(o_totalprice) as owed from orders group by 1) select coalesce(c_custkey, k) as k, c_name as name, coalesce(owed, c_acctbal) as owed from customer full join n on k = c_custkey""",
    "catalogue_changes": f"""with p as (select distinct p_brand || ' ' || p_type as name, 'https://x.org/' || lower(p_brand || p_type) as url from part)
select 's-' || s_suppkey as id, s_name as name, 'https://x.org/' || lower(s_name) as url from supplier where s_suppkey % 10 > 0
union all select array_to_string({WORDS.format('name')}, '_') || '-' || substr(sha256(url), 1, 6), name, url from (select min(name) as name, url from p group by url)""",
    "expanded_urls": "with " + SQL_SOURCES + """,
known as (select county, k, lpad(cast(k as varchar), 7, '0') as parcel, ['OAK', 'ELM', 'FIR', 'ASH', null][k % 5 + 1] as street, cast(k % 700 + 1 as varchar) as number from src where n_regionkey > 0),
v as (select county, unnest(['parcels', 'streets', 'numbers']) as token, unnest([parcel, street, number]) as value, k from known),
f as (select county, token, value, min(k) as first from v where value is not null group by all),
r as (select *, row_number() over (partition by county, token order by first, value) as n from f),
l as (select county, token, string_agg('''' || value || '''', ',' order by n) as list from r where n <= case token when 'parcels' then 150 when 'streets' then 60 else 120 end group by all),
t as (select *, case k % 4 when 1 then 'parcels' when 2 then 'streets' when 3 then 'numbers' end as token from src)
select source_id, case when t.token is null then url else replace(url, '{' || t.token || '}', list) end as url, case when t.token is not null and list is null then 'nothing to target yet' end as error from t left join l on l.county = t.county and l.token = t.token""",
    "field_rates": """with c as (select 's' || (o_orderkey % 14) as source_id, (o_totalprice > 50000)::int as a, (o_orderstatus <> 'P')::int as b from orders)
select source_id, unnest(['owed', 'status', 'all']) as field, round(unnest([avg(a), avg(b), avg((a + b) / 2.0)]), 9) as rate from c group by source_id""",
    "mapping_checks": """with p as (select p_type as source_id, p_brand || p_size as name, p_name as label, p_partkey % 3 - 1 as part, (p_partkey % 1010) / 1000.0::double as confidence from part),
f as (select source_id, 'score' as fault from p where confidence > 1 union all select source_id, 'field twice' from (select source_id, name from p group by all having count(*) > 1) union all select source_id, 'part twice' from (select source_id, label, part from p group by all having count(*) > 1))
select source_id, fault, cast(count(*) as varchar) as at from f group by all union all select source_id, 'confidence', cast(round(avg(confidence), 6) as varchar) from p group by 1""",
    "validator_votes": "with " + SQL_VALUES + """, t as (select ['a.org', 'b.org'][s_suppkey % 2 + 1] as domain, ['customer', 'seller', 'parcel', 'sale', 'other', 'customers list', 'parc', 'zzz'][(s_suppkey // 2) % 8 + 1] as name, ['due', '', 'tel'][s_suppkey % 3 + 1] as label, s_suppkey as seq from supplier),
l as (select domain, name, arg_max(label, seq) as class from t where label <> '' group by all)
select * from uv union all select * from vv union all select example, 'llm', class from vc join l using (domain, name)""",
    "weak_label_masks": "with " + SQL_VALUES + """, x as (select example, map {'customer': 'owner', 'seller': 'owner', 'parcel': 'id', 'sale': 'amount'}[name] as a, map {'customer': 'owner', 'seller': 'owner', 'parcel': 'id', 'sale': 'amount'}[display] as b, name in ('customers list', 'parc') or display in ('customers list', 'parc') as near from vc)
select example, case when a <> b then null else coalesce(a, b) end as class, coalesce(a <> b, false) or (coalesce(a, b) is null and near) as masked from x""",
    "corpus_counts": "with " + SQL_VALUES + """, x as (select unnest(['columns', 'domain', 'label', 'label_source']) as what, unnest(['', domain, case when example % 2 = 0 then name else '' end, 'lexicon']) as value from vc) select what, value, count(*) as n from x group by all""",
    "vote_suspects": "with " + SQL_VALUES + """, v as (select * from uv union all select * from vv), t as (select v.example, v.class as said, case when v.example % 4 = 0 then 'mail' else 'none' end as class from v)
select example, class, 0.0::double as given, row_number() over (order by example) as suspicion_rank from t where said <> class""",
    "overall_scores": """with p as (select ['none', 'a', 'b', 'c'][l_orderkey % 4 + 1] as truth, ['none', 'a', 'b'][(l_orderkey + l_linenumber) % 3 + 1] as guess from lineitem), c as (select unnest(['a', 'b', 'c']) as class),
s as (select class, (select count(*) from p where truth = class) as t, (select count(*) from p where guess = class) as g, (select count(*) from p where truth = class and guess = class) as tp from c)
select round(avg(case when t + g > 0 then 2.0 * tp / (t + g) else 0 end) filter (t > 0), 9) as macro_f1, (select round(avg(case when truth = guess then 1.0 else 0.0 end), 9) from p where truth <> 'none') as positive_accuracy, (select count(*) from p) as examples from s""",
    "page_features": rf"""with p as (select page_id, url, trim(regexp_replace(regexp_replace(regexp_extract(html, '(?is)<title\b[^>]*>(.*?)</title>', 1), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) as title,
  list_transform(regexp_extract_all(html, '(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>', 1), lambda h: trim(regexp_replace(regexp_replace(h, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as heads from pages),
t as (select page_id, 'fmt:html' as token from p union all select page_id, 'title:' || unnest({KEPT.format(WORDS.format('title'))}) from p union all select page_id, 'url:' || unnest({KEPT.format(WORDS.format('url'))}) from p
  union all select page_id, 'h:' || unnest({KEPT.format(WORDS.format('h'))}) from (select page_id, unnest(heads) as h from p)),
b as (select page_id, token, count(*) as n from t group by all)
select token, cast(sum(n) as bigint) as n, count(*) as docs from b group by token""",
    "use_groups": """with p as (select p_partkey, lower(p_name || ' ' || ['Residential', 'town home', 'Apartments', 'LAND', 'commercial lot', 'condominium', 'Industrial', 'agric', 'exempt'][p_partkey % 9 + 1]) as u from part)
select p_partkey, case when regexp_matches(u, 'resid|condo|single|town home') then 'residential' when contains(u, 'apart') then 'apartments' when contains(u, 'commerc') then 'commercial' when contains(u, 'industr') then 'industrial' when contains(u, 'vacant') or contains(u, 'land') then 'vacant' else 'other' end as use,
  case when contains(u, 'reside') then 'residential' when contains(u, 'commer') then 'commercial' when contains(u, 'agricu') then 'agricultural' when contains(u, 'indust') then 'industrial' when contains(u, 'exempt') then 'exempt' when contains(u, 'town home') or contains(u, 'condominium') or contains(u, 'apartment') then 'residential' else 'other' end as use_of_states from p""",
    "value_ranges": """with e as (select l_returnflag as state, max(l_discount) * 2 as mdape from lineitem where l_returnflag <> 'N' group by 1)
select l_orderkey, l_linenumber, case when mdape is not null then round(l_extendedprice, 2) end as estimate, round(l_extendedprice * (1 - mdape), 2) as low, round(l_extendedprice * (1 + mdape), 2) as high from lineitem left join e on state = l_returnflag""",
    "nb_sweep": f"""with tk as (select doc_id as doc, source as class, {KEPT.format(WORDS.format("coalesce(text, '')"))} as ts from documents where doc_id is not null),
bag as (select doc, class, token, count(*) as n from (select doc, class, unnest(ts) as token from tk) group by all),
h as (select class, token, sum(n) as hits from bag group by all), t as (select class, sum(hits) as tokens from h group by class), d as (select class, count(*) as docs from tk group by class),
f as (select token, count(distinct doc) as df from bag group by token), v as (select count(*) as v from f), a as (select count(*) as all_docs from tk), al as (select unnest([0.1, 0.3, 0.5, 1.0, 2.0])::double as alpha, unnest([0, 1, 2, 3, 4]) as turn),
o as (select tk.doc, tk.class as truth, coalesce(sum(n), 0) as own, coalesce(sum(case when df = 1 then 1 else 0 end), 0) as lone from tk left join bag b on b.doc = tk.doc left join f on f.token = b.token group by all),
k as (select b.doc, b.class as truth, b.token, b.n from bag b join f using (token) where df > 1), z as (select doc, sum(n) as known from k group by doc),
c as (select o.doc, o.truth, d.class, alpha, turn, d.docs - (d.class = o.truth)::int as docs, t.tokens - case when d.class = o.truth then own else 0 end + alpha * ((select v from v) - lone) as den from o cross join d cross join al join t on t.class = d.class),
l as (select k.doc, h.class, alpha, sum(k.n * ln((h.hits - case when h.class = k.truth then k.n else 0 end + alpha) / alpha)) as lift from k join h on h.token = k.token cross join al group by all),
s as (select c.*, ln(c.docs / ((select all_docs from a) - 1)) + coalesce(z.known, 0) * ln(alpha / den) + coalesce(l.lift, 0) as score from c left join z using (doc) left join l using (doc, class, alpha) where c.docs > 0),
g as (select *, row_number() over (partition by doc, alpha order by score desc, class) as n from s),
r as (select alpha, turn, count(*) as examples, round(avg(case when class = truth then 1.0 else 0.0 end), 9) as accuracy from g where n = 1 group by all)
select alpha, examples, accuracy, row_number() over (order by accuracy desc, turn) = 1 as best, accuracy >= 0.8 and examples >= 8 as passes from r""",
    "page_links": r"""with a as (select page_id, url, unnest(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?(?:</a\s*>|\z)')) as x, generate_subscripts(regexp_extract_all(html, '(?is)<a\b[^>]*>.*?(?:</a\s*>|\z)'), 1) as i from pages),
b as (select *, regexp_replace(trim(regexp_extract(x, '(?is)^<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1)), '#.*$', '') as h,
  lower(trim(regexp_replace(regexp_replace(x, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'))) as said, lower(regexp_extract(x, '(?is)^<a\b[^>]*?\brel\s*=\s*["'']([^"'']*)["'']', 1)) as rel,
  regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) as site, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?', 1) as p from a),
d as (select page_id, i, not (said in ('next', 'next page', '>', '&gt;', '»', '&raquo;') or rel = 'next' or regexp_matches(said, '^[0-9]{1,3}$')) as later,
  case when regexp_matches(h, '(?i)^https?://') then h when h = '' or regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') then null when starts_with(h, '//') then regexp_extract(site, '^[^:]*:') || h when starts_with(h, '/') then site || h
  else site || regexp_extract(case when p = '' then '/' else p end, '^(.*/)', 1) || h end as target from b),
e as (select page_id, target, min(later::int * 1000000 + i) as pos from d where target is not null group by all),
f as (select page_id, cast(row_number() over (partition by page_id order by pos) - 1 as integer) as place, target from e)
select page_id, place, target from f where place < 40""",
}
