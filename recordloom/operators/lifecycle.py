"""Lifecycle of a property from its events: ranks only rise, a reset returns to normal, other kinds are evidence only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# States by rank, and what each kind of event does (absent: evidence only).
STATES = ("NORMAL", "TAX_DELINQUENT", "FORECLOSURE_FILED", "AUCTION_SCHEDULED", "SOLD_AT_AUCTION")
RANKS = {"deed_transfer": 0, "tax_delinquency": 1, "foreclosure_filed": 2, "auction_scheduled": 3, "sold_at_auction": 4}
KIND_OF_LABEL = {
    "tax_delinquency": "tax_delinquency", "foreclosure_filing": "foreclosure_filed", "deed_transfer": "deed_transfer", "code_violation": "code_violation",
    "building_permit": "permit_issued", "assessor_roll": "assessment_recorded", "probate_case": "probate_opened",
}
ORDER = ("event_date", "recorded_at", "id")


def kind_of(label: Column, status: Column) -> Column:
    """The kind of event that a source's class and a record's status give."""
    out = F.when(label == "trustee_auction", F.when(F.lower(F.coalesce(status, F.lit(""))).contains("sold"), "sold_at_auction").otherwise("auction_scheduled"))
    for name, kind in KIND_OF_LABEL.items():
        out = out.when(label == name, kind)
    return out.otherwise("assessment_recorded")


def rank_of(kind: Column) -> Column:
    return F.coalesce(*[F.when(kind == k, r) for k, r in RANKS.items()])


def state_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in STATES]), rank + 1)


def states(events: DataFrame) -> DataFrame:
    """(property_key, state_rank, state): the highest rank after the last reset, in chronological order.

    One aggregation with map-side combining finds the last event of each rank, which is all that counts, so a property with very
    many events needs neither an ordering nor a join of them.
    """
    e = events.select("property_key", F.struct(*ORDER).alias("at"), rank_of(F.col("kind")).alias("rank"))
    last = e.groupBy("property_key").agg(*[F.max(F.when(F.col("rank") == r, F.col("at"))).alias(f"last_{r}") for r in range(len(STATES))])
    after = lambda r: F.col(f"last_{r}").isNotNull() & (F.col("last_0").isNull() | (F.col(f"last_{r}") > F.col("last_0")))
    rank = F.coalesce(*[F.when(after(r), r) for r in range(len(STATES) - 1, 0, -1)], F.lit(0)).cast("int")
    return last.select("property_key", rank.alias("state_rank"), state_name(rank).alias("state"))


def transitions(events: DataFrame) -> DataFrame:
    """(property_key, id, event_date, state_rank, state) for each event that changes the state, chronologically."""
    w = Window.partitionBy("property_key").orderBy(*ORDER)
    e = events.select("property_key", *ORDER, rank_of(F.col("kind")).alias("rank"))
    e = e.withColumn("part", F.sum(F.when(F.col("rank") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    inside = Window.partitionBy("property_key", "part").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    e = e.withColumn("before", F.coalesce(F.max("rank").over(inside), F.lit(0)))
    tops = e.groupBy("property_key", (F.col("part") + 1).alias("part")).agg(F.max("rank").alias("left_at"))
    e = e.join(tops, ["property_key", "part"], "left")
    moved = ((F.col("rank") > 0) & (F.col("rank") > F.col("before"))) | ((F.col("rank") == 0) & (F.coalesce("left_at", F.lit(0)) > 0))
    rank = F.col("rank").cast("int")
    return e.where(moved).select("property_key", "id", "event_date", rank.alias("state_rank"), state_name(rank).alias("state"))
