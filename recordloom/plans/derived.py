"""The library's own tables as views of the star schema, for queries on it: property events, observations, addresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Label of a source and kind of its events, by order key modulo 9.
KINDS = (
    ("tax_delinquency", "tax_delinquency"), ("foreclosure_filing", "foreclosure_filed"), ("trustee_auction", "auction_scheduled"),
    ("trustee_auction", "sold_at_auction"), ("deed_transfer", "deed_transfer"), ("code_violation", "code_violation"),
    ("building_permit", "permit_issued"), ("assessor_roll", "assessment_recorded"), ("probate_case", "probate_opened"),
)

#: Canonical fields of the observations: name, kind, authority.
FIELDS = (("owner", "name", "deed_transfer"), ("assessed_value", "money", "assessor_roll"), ("status", "status", ""))

#: How far sources are trusted in a field, whatever their events' own confidence.
TRUST = (("s1", "owner", 0.95), ("s3", "assessed_value", 0.05), ("s5", "status", 0.65))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def property_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order as an event of its customer's property."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    k, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in KINDS]), (k % 9 + 1).cast("int"))
    text = lambda c: F.date_format(c, "yyyy-MM-dd")
    scope = F.regexp_replace(F.lower("n_name"), "[^a-z0-9]+", "_")
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(nation), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.select(
        F.concat(scope, F.lit("|p:"), F.lpad(F.col("o_custkey").cast("string"), 7, "0")).alias("property_key"),
        pick(1).alias("kind"),
        text(day).alias("event_date"),
        F.concat(text(F.date_add(day, (k % 3).cast("int"))), F.lit("T00:00:00Z")).alias("recorded_at"),
        F.lpad(k.cast("string"), 12, "0").alias("id"),
        F.concat(F.lit("s"), (k % 7).cast("string")).alias("source_id"),
        pick(0).alias("source_label"),
        F.date_format(day, "yyyy").alias("as_of"),
        F.col("o_totalprice").alias("amount"),
        ((k % 10) / 10.0).cast("double").alias("confidence"),
        F.create_map(F.lit("owner"), F.concat(F.lit("owner "), (k % 5).cast("string")), F.lit("assessed_value"), F.concat(F.lit("$"), F.floor("o_totalprice").cast("string")), F.lit("status"), F.col("o_orderstatus")).alias("details"),
    )


def fields(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FIELDS, "field string, kind string, authority string")


SQL_EVENTS = """
pe as (
  select regexp_replace(lower(n_name), '[^a-z0-9]+', '_', 'g') || '|p:' || lpad(cast(o_custkey as varchar), 7, '0') as property_key,
    ['tax_delinquency', 'foreclosure_filed', 'auction_scheduled', 'sold_at_auction', 'deed_transfer', 'code_violation', 'permit_issued', 'assessment_recorded', 'probate_opened'][o_orderkey % 9 + 1] as kind,
    strftime(o_orderdate, '%Y-%m-%d') as event_date,
    strftime(cast(o_orderdate as date) + cast(o_orderkey % 3 as integer), '%Y-%m-%d') || 'T00:00:00Z' as recorded_at,
    lpad(cast(o_orderkey as varchar), 12, '0') as id,
    's' || cast(o_orderkey % 7 as varchar) as source_id,
    ['tax_delinquency', 'foreclosure_filing', 'trustee_auction', 'trustee_auction', 'deed_transfer', 'code_violation', 'building_permit', 'assessor_roll', 'probate_case'][o_orderkey % 9 + 1] as source_label,
    strftime(o_orderdate, '%Y') as as_of, o_totalprice as amount, cast((o_orderkey % 10) / 10.0 as double) as confidence,
    'owner ' || cast(o_orderkey % 5 as varchar) as owner, '$' || cast(cast(floor(o_totalprice) as bigint) as varchar) as assessed_value, o_orderstatus as status,
    case o_orderkey % 9 when 4 then 0 when 0 then 1 when 1 then 2 when 2 then 3 when 3 then 4 end as rk
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey)
"""

SQL_OBSERVATIONS = SQL_EVENTS + """,
ob as (
  select property_key, event_date, recorded_at, id, source_id, source_label, as_of, coalesce(t.confidence, pe.confidence) as confidence, f.field, f.authority,
    case f.field when 'owner' then owner when 'assessed_value' then assessed_value else status end as value,
    case when source_label = f.authority and f.authority <> '' then 1 else 0 end as ruling
  from pe cross join (values ('owner', 'deed_transfer'), ('assessed_value', 'assessor_roll'), ('status', '')) f(field, authority)
  left join (values ('s1', 'owner', 0.95::double), ('s3', 'assessed_value', 0.05::double), ('s5', 'status', 0.65::double)) t(source, of_field, confidence) on t.source = source_id and t.of_field = f.field)
"""
