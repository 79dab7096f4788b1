"""Compiling events into properties: entity groups, resolved fields, history, signals, ranking, the county document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.places import normalize_address
from ..functions.text import lower
from ..functions.values import normalize, parse_date

ORDER = ("event_date", "recorded_at", "id")


def with_group(keys: DataFrame) -> DataFrame:
    """(property_key, join_key) with group_key: keys at one locatable address form a group, others are alone.

    join_key is null where the address can't be located; scope is the key's part before the bar.
    """
    scope = F.substring_index("property_key", "|", 1)
    return keys.withColumn("group_key", F.coalesce(F.concat(scope, F.lit("|a:"), F.col("join_key")), F.col("property_key")))


def guarded(grouped: DataFrame, parcels: DataFrame) -> DataFrame:
    """Groups in which one source lists several parcels fall apart into single keys. parcels: (property_key, source_id, parcel_id)."""
    seen = parcels.where(F.coalesce("parcel_id", F.lit("")) != "").join(grouped.select("property_key", "group_key"), "property_key")
    several = seen.groupBy("group_key", "source_id").agg(F.countDistinct("parcel_id").alias("n")).where("n > 1").select("group_key").distinct()
    return grouped.join(several.withColumn("torn", F.lit(True)), "group_key", "left").withColumn("group_key", F.when(F.col("torn"), F.col("property_key")).otherwise(F.col("group_key"))).drop("torn")


def buckets(grouped: DataFrame) -> DataFrame:
    """(group_key, property_key, bucket): keys of a group by first fit, in key order, into buckets whose directions and
    suffixes don't clash. A bucket is known by its one direction and suffix, and only gets narrower, so keys with equal ones
    share their first one's bucket: the fold runs over a group's distinct directions and suffixes, however many keys it has."""
    keys = grouped.select("group_key", "property_key", F.coalesce("directional", F.lit("")).alias("directional"), F.coalesce("suffix", F.lit("")).alias("suffix"))
    kinds = keys.groupBy("group_key", "directional", "suffix").agg(F.min("property_key").alias("first"))
    kinds = kinds.groupBy("group_key").agg(F.array_sort(F.collect_list(F.struct("first", "directional", "suffix"))).alias("kinds"))
    fits = lambda a, b: (a == "") | (b == "") | (a == b)

    def step(held: Column, k: Column) -> Column:
        open_ = F.transform(held, lambda b: fits(b["directional"], k["directional"]) & fits(b["suffix"], k["suffix"]))
        at = F.array_position(open_, True)
        own = F.struct(k["directional"].alias("directional"), k["suffix"].alias("suffix"))
        put = F.transform(held, lambda b, i: F.when(F.lit(i + 1) == at, F.struct(F.when(b["directional"] == "", k["directional"]).otherwise(b["directional"]).alias("directional"), F.when(b["suffix"] == "", k["suffix"]).otherwise(b["suffix"]).alias("suffix"), F.concat(b["members"], F.array(own)).alias("members"))).otherwise(b))
        new = F.array(F.struct(k["directional"], k["suffix"], F.array(own).alias("members")))
        return F.when(at > 0, put).otherwise(F.concat(held, new))

    start = F.array().cast("array<struct<directional:string,suffix:string,members:array<struct<directional:string,suffix:string>>>>")
    found = kinds.select("group_key", F.posexplode(F.aggregate("kinds", start, step)).alias("bucket", "b")).select("group_key", F.explode("b.members").alias("m"), "bucket")
    return keys.join(found.select("group_key", "m.directional", "m.suffix", "bucket"), ["group_key", "directional", "suffix"]).select("group_key", "property_key", "bucket")


def same_key(kind: Column, value: Column) -> Column:
    """What two values of a field must share to count as the same."""
    out = F.when(kind == "address", normalize_address(value))
    for k in ("money", "date", "id"):
        out = out.when(kind == k, lower(normalize(k, value)))
    return out.otherwise(lower(normalize("text", value)))


def observations(events: DataFrame, fields: DataFrame, trust: DataFrame) -> DataFrame:
    """events (with details map) as one row for each known field with a value: field's kind and authority, and the source's trust
    in that field, or else the event's own confidence. fields and trust are configuration."""
    long = events.select("property_key", *ORDER, "source_id", "source_label", "as_of", "confidence", F.explode("details").alias("field", "value")).where("value != ''")
    long = long.join(F.broadcast(fields.select("field", "kind", "authority")), "field")
    return long.join(trust.withColumnRenamed("confidence", "trusted"), ["source_id", "field"], "left").withColumn("confidence", F.coalesce("trusted", "confidence")).drop("trusted")


def resolve(seen: DataFrame) -> DataFrame:
    """One row for each property and field: the resolved value and the conflicts on the way.

    seen: property_key, field, kind, authority (null or '' for none), source_label, event_date, recorded_at, id, as_of
    ('' if undated), value, source_id, confidence. Observations are folded in chronological order: an authoritative source
    beats others, then the newer edition if both are dated, then the higher confidence, then the later event. The
    relation isn't transitive where dated and undated editions mix, hence a fold and no maximum.
    """
    o = F.struct(*ORDER, F.col("value"), same_key(F.col("kind"), F.col("value")).alias("same"), "source_id", F.coalesce("as_of", F.lit("")).alias("as_of"), "confidence", (F.coalesce("authority", F.lit("")) != "").alias("ruled"), F.coalesce(F.col("source_label") == F.col("authority"), F.lit(False)).alias("ruling"))
    kept = seen.groupBy("property_key", "field").agg(F.array_sort(F.collect_list(o)).alias("seen"))

    def wins(e: Column, b: Column) -> Column:
        tie = (e["confidence"] > b["confidence"]) | ((e["confidence"] == b["confidence"]) & (e["event_date"] >= b["event_date"]))
        return F.when(e["ruled"] & (e["ruling"] != b["ruling"]), e["ruling"]).when((e["as_of"] != "") & (b["as_of"] != "") & (e["as_of"] != b["as_of"]), e["as_of"] > b["as_of"]).otherwise(tie)

    def clash(keep: Column, drop: Column) -> Column:
        parts = [x[c].alias(f"{n}_{c}") for n, x in (("kept", keep), ("dropped", drop)) for c in ("value", "source_id", "confidence")]
        return F.array(F.struct(*parts))

    def step(a: Column, e: Column) -> Column:
        b, won = a["best"], wins(e, a["best"])
        told = F.when(e["same"] != b["same"], F.when(won, clash(e, b)).otherwise(clash(b, e))).otherwise(F.array().cast("array<struct<kept_value:string,kept_source_id:string,kept_confidence:double,dropped_value:string,dropped_source_id:string,dropped_confidence:double>>"))
        return F.struct(F.when(won, e).otherwise(b).alias("best"), F.concat(a["conflicts"], told).alias("conflicts"))

    none = F.array().cast("array<struct<kept_value:string,kept_source_id:string,kept_confidence:double,dropped_value:string,dropped_source_id:string,dropped_confidence:double>>")
    folded = F.aggregate(F.slice("seen", 2, F.size("seen")), F.struct(F.col("seen")[0].alias("best"), none.alias("conflicts")), step)
    return kept.select("property_key", "field", folded.alias("r")).select("property_key", "field", "r.best.value", "r.best.source_id", "r.best.event_date", "r.best.as_of", "r.best.confidence", "r.best.recorded_at", "r.conflicts")


def history(seen: DataFrame) -> DataFrame:
    """First value of each edition and source, newest edition first: property_key, field, as_of, source_id, value, place."""
    first = Window.partitionBy("property_key", "field", "as_of", "source_id").orderBy(*ORDER)
    newest = Window.partitionBy("property_key", "field").orderBy(F.desc("as_of"), *ORDER)
    rows = seen.withColumn("n", F.row_number().over(first)).where("n = 1")
    return rows.withColumn("place", F.row_number().over(newest)).select("property_key", "field", "as_of", "source_id", "value", "place")


def edition_change(resolved: DataFrame, editions: DataFrame, field: str) -> DataFrame:
    """Change of a money field against the first edition in history that isn't the resolved one and has a value above 0."""
    money = lambda c: F.regexp_replace(c, "[$, ]", "").try_cast("double")
    now = resolved.where(F.col("field") == field).select("property_key", F.col("as_of").alias("now_as_of"), money(F.col("value")).alias("current"))
    past = editions.where(F.col("field") == field).select("property_key", "as_of", "place", money(F.col("value")).alias("amount"))
    found = now.join(past, "property_key").where((F.col("as_of") != F.col("now_as_of")) & (F.col("amount") > 0)).groupBy("property_key", "current").agg(F.min_by("amount", "place").alias("previous"))
    return found.where("current > 0").select("property_key", "current", "previous", ((F.col("current") - F.col("previous")) / F.col("previous")).alias("change"))


def signals(events: DataFrame, now_epoch: int) -> DataFrame:
    """Signals of each property: the last value of each kind in chronological order (not the greatest), counts, sources, and
    whole days since the newest datable event."""
    held = lambda kind, value, name: F.max(F.when(F.col("kind") == kind, F.struct(*ORDER, F.col(value).alias("v")))).getField("v").alias(name)
    day = F.unix_timestamp(F.try_to_timestamp(parse_date(F.col("event_date")), F.lit("yyyy-MM-dd")))
    newest = F.max(F.when(F.substring("event_date", 1, 4) >= "1900", day))
    return events.groupBy("property_key").agg(
        F.coalesce(held("tax_delinquency", "amount", "x"), F.lit(0.0)).alias("due"),
        F.count_if(F.col("kind") == "code_violation").alias("violations"),
        F.count_if(F.col("kind") == "permit_issued").alias("permits_issued"),
        held("permit_issued", "event_date", "last_permit_date"),
        held("auction_scheduled", "event_date", "auction_date"),
        held("foreclosure_filed", "event_date", "foreclosure_filed_date"),
        held("deed_transfer", "event_date", "last_transfer_date"),
        held("sold_at_auction", "event_date", "sold_date"),
        held("probate_opened", "event_date", "probate_date"),
        F.countDistinct("source_id").alias("sources"),
        F.count("*").alias("events"),
        F.floor((F.lit(now_epoch) - newest) / 86400).cast("long").alias("days_since_event"),
    )


def occupancy(mailing: Column, address: Column) -> Column:
    known = (F.coalesce(mailing, F.lit("")) != "") & (F.coalesce(address, F.lit("")) != "")
    return F.when(~known, "unknown").when(normalize_address(mailing) == normalize_address(address), "owner_occupied").otherwise("absentee_owned")


def ranked(properties: DataFrame) -> DataFrame:
    """County order: most due, then violations, then assessed; ties by key."""
    return properties.orderBy(F.desc("due"), F.desc("violations"), F.desc_nulls_last("assessed"), "property_key")


def county_json(properties: DataFrame) -> DataFrame:
    """(property_key, document): the canonical JSON of each property that can be located; absent values are left out."""
    fields = [c for c in properties.columns if c != "locatable"]
    ratio = F.when((F.col("assessed") > 0) & (F.col("due") > 0), F.col("due") / F.col("assessed"))
    return properties.where("locatable").withColumn("debt_to_value", ratio).select("property_key", F.to_json(F.struct(*fields, "debt_to_value")).alias("document"))
