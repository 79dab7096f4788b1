"""What people look for: profiles that updates complete, the next question, identities of messages and of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .operations import first_by

# What a profile has unless it is told otherwise, and the order of questions.
DEFAULTS = {"min_owed": 10_000.0, "min_assessed": 0.0, "evidence": "multiple_sources", "recency_answered": True, "require_approval": True}
PROFILE = "markets array<string>, county string, min_owed double, min_assessed double, evidence string, max_days long, recency_answered boolean, require_approval boolean"
TITLE = 60


def updated(current: DataFrame, updates: DataFrame, key: str, defaults: bool = False) -> DataFrame:
    """Profiles (key and the columns of PROFILE) with one update each: what it says counts, else what was known, else the default,
    if these are wanted. any_event_age takes an age limit back. A county alone names the markets; the first market is the county."""
    fields = [f.strip().split(" ")[0] for f in PROFILE.split(",")]
    old, new = current.select(key, F.struct(*fields).alias("old")), updates.select(key, F.struct(*fields, "any_event_age").alias("new"))
    both = old.join(new, key, "full")
    was = lambda c: F.coalesce(F.col(f"old.{c}"), F.lit(DEFAULTS[c])) if defaults and c in DEFAULTS else F.col(f"old.{c}")
    said = lambda c: F.coalesce(F.col(f"new.{c}"), was(c))
    anytime = F.coalesce(F.col("new.any_event_age"), F.lit(False))
    markets = F.coalesce("new.markets", F.when(F.col("new.county").isNotNull(), F.array("new.county")), "old.markets")
    out = {
        "markets": markets, "county": F.coalesce(F.get(markets, F.lit(0)), "new.county", "old.county"), "min_owed": said("min_owed"), "min_assessed": said("min_assessed"), "evidence": said("evidence"),
        "max_days": F.when(~anytime, said("max_days")), "recency_answered": F.when(anytime | F.col("new.max_days").isNotNull(), True).otherwise(was("recency_answered")), "require_approval": said("require_approval"),
    }
    return both.select(key, *[c.alias(n) for n, c in out.items()])


def next_field() -> Column:
    """The first question that a profile leaves open, of its columns; null if none."""
    placed = (F.coalesce(F.size("markets"), F.lit(0)) > 0) | F.col("county").isNotNull()
    out = F.when(~placed, "county")
    for c in ("min_owed", "min_assessed", "evidence"):
        out = out.when(F.col(c).isNull(), c)
    return out.when(~F.coalesce("recency_answered", F.lit(False)), "recency").when(F.col("require_approval").isNull(), "require_approval")


def inbound(messages: DataFrame) -> DataFrame:
    """Each message's handle once, the first to arrive (seq)."""
    return first_by(messages, ["handle"], "seq")


def workflow_id(county: Column, stamp: Column, abi: Column, retry: Column, coverage: Column, recipient: Column) -> Column:
    """The identity of a county's compilation: the same for the same stamp, so that it isn't started twice. Empty parts are left out."""
    empty = lambda c: F.coalesce(c, F.lit(""))
    part = lambda prefix, c: F.when(empty(c) == "", "").otherwise(F.concat(F.lit(prefix), c))
    identity = F.concat(county, F.lit(":"), stamp, F.lit(":"), abi.cast("string"), part(":", retry), part(":coverage:", coverage), part(":notify:", recipient))
    return F.concat(F.lit("county-"), F.substring(county, 1, TITLE), F.lit("-"), F.substring(F.sha2(identity, 256), 1, 20))
