"""Who an owner is and when to write to them, and whether compiled results may be reused."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import let

# Words that mark a business, why a moment is right, short names of zones, time zones of states.
BUSINESS = (
    "llc", "inc", "corp", "corporation", "company", "co", "ltd", "lp", "llp", "trust", "trustee", "trustees", "holdings", "properties", "investments", "enterprises", "partners", "partnership",
    "bank", "association", "hoa", "church", "ministries", "authority", "realty", "development", "group", "city of", "county of", "commonwealth of", "school board",
)
REASONS = ("business hours for a business owner", "after-work hours for an individual owner", "weekend daytime for an individual owner")
SHORT = {
    "America/New_York": {-5: "EST", -4: "EDT"}, "America/Chicago": {-6: "CST", -5: "CDT"}, "America/Denver": {-7: "MST", -6: "MDT"}, "America/Phoenix": {-7: "MST"}, "America/Los_Angeles": {-8: "PST", -7: "PDT"},
}
ZONES = {"America/New_York": "va nc md dc fl ga", "America/Chicago": "tx il", "America/Denver": "co", "America/Phoenix": "az", "America/Los_Angeles": "ca wa or"}


def owner_type(owner: Column) -> Column:
    """business, person, or unknown; an estate is a person's. Words count whole, between spaces; . , & ( ) are spaces."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(owner, F.lit(""))), "[.,&()]", " "), r"\s+", " ")
    return let(F.trim(spaced), lambda o: F.when(o == "", "unknown").when(o.rlike("(^| )estate of( |$)"), "person").when(o.rlike(f"(^| )({'|'.join(BUSINESS)})( |$)"), "business").otherwise("person"))


def zone_of(jurisdiction: Column) -> Column:
    """The time zone of a jurisdiction whose name ends in _ and a state's two small letters; New York's for others."""
    state = F.regexp_extract(F.coalesce(jurisdiction, F.lit("")), r"_([a-z]{2})\z", 1)
    found = [F.when(state.isin(*names.split()), zone) for zone, names in ZONES.items()]
    return F.coalesce(*found, F.lit("America/New_York"))


def may_send(at_utc: Column, owner_kind: Column, zone: Column) -> Column:
    """Whether a moment is in the hours of contact there: weekdays 9 to 17 for a business, evenings and weekends for a person."""
    local = F.from_utc_timestamp(at_utc, zone)
    minute, weekend = F.hour(local) * 60 + F.minute(local), F.dayofweek(local).isin(1, 7)
    business = ~weekend & minute.between(9 * 60, 17 * 60 - 1)
    person = F.when(weekend, minute.between(10 * 60, 20 * 60 + 29)).otherwise(minute.between(17 * 60 + 30, 20 * 60 + 29))
    return F.when(owner_kind == "business", business).otherwise(person)


def next_window(at_utc: Column, owner_kind: Column, zone: Column) -> Column:
    """struct<at, reason>: the moment itself within the hours of contact, else their next start there. Minutes are added in UTC, so the
    start is an hour off where the clocks change in between."""
    local = F.from_utc_timestamp(at_utc, zone)
    now, today = F.hour(local) * 60 + F.minute(local), F.dayofweek(local) - 1  # from Sunday
    free = lambda day: day.isin(0, 6)
    opens = lambda day: F.when(owner_kind == "business", F.when(~free(day), 540)).otherwise(F.when(free(day), 600).otherwise(1050))
    closes = F.when(owner_kind == "business", 1020).otherwise(1230)
    text = lambda day: F.when(owner_kind == "business", REASONS[0]).when(free(day), REASONS[2]).otherwise(REASONS[1])

    def of(offset: int) -> Column:
        day = (today + offset) % 7
        late = opens(day) + 1440 * offset - now
        return F.when(late > 0, F.struct((at_utc + F.make_dt_interval(F.lit(0), F.lit(0), late)).alias("at"), text(day).alias("reason")))

    inside = F.when((now >= opens(today)) & (now < closes), F.struct(at_utc.alias("at"), text(today).alias("reason")))
    return F.coalesce(inside, *[of(k) for k in range(4)])  # a weekend is two days


def next_send(at_utc: Column, owner_kind: Column, zone: Column) -> Column:
    """The next moment, this one included, within the hours of contact there."""
    return next_window(at_utc, owner_kind, zone)["at"]


def in_zone(at_utc: Column, zone: Column) -> Column:
    """A moment as people write it there: Mon, Nov 28, 5:30 PM EST."""
    local = F.from_utc_timestamp(at_utc, zone)
    ahead = (F.unix_timestamp(local) - F.unix_timestamp(at_utc)) / 3600
    short = F.coalesce(*[F.when((zone == z) & (ahead == h), name) for z, names in SHORT.items() for h, name in names.items()], F.lit(""))
    return F.concat(F.date_format(local, "EEE, MMM d, h:mm a "), short)


def stamp(events: DataFrame, key: str) -> DataFrame:
    """(key, stamp): count and newest record of what a compiled result is made of."""
    return events.groupBy(key).agg(F.concat(F.count("*").cast("string"), F.lit(":"), F.coalesce(F.max("recorded_at"), F.lit(""))).alias("stamp"))


def cache_valid(stamp: Column, current: Column, written_epoch: Column, now_epoch: int, minutes: int = 20) -> Column:
    """Compiled results hold while the events' stamp (count and newest record) is theirs, and warm ones for some minutes."""
    return (stamp == current) & (F.lit(now_epoch) - written_epoch < minutes * 60)
