"""Names and links of places, owners and services, stamps of time, and numbers as people read them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .similarity import similarity
from .text import let, lower, words

# The least similarity of one owner's names; where links lead.
SAME_OWNER = 0.93
MAP_LINK, HOME_LINK = "https://www.google.com/maps/search/?api=1&query=", "https://www.zillow.com/homes/"
ROWS_QUERY = "/query?where=1%3D1&outFields=*&f=json&resultRecordCount=50"


def capital(c: Column) -> Column:
    """The first letter large, the rest as it is."""
    return F.concat(F.upper(F.substring(c, 1, 1)), F.substring(c, 2, 1 << 20))


def same_owner(a: Column, b: Column) -> Column:
    """Whether two names have the same words in any order, or nearly the same once their words are sorted. Names without words match none."""
    x, y = (F.array_join(F.array_sort(words(F.coalesce(c, F.lit("")))), " ") for c in (a, b))
    return (x != "") & (y != "") & ((x == y) | (similarity(x, y) >= SAME_OWNER))


def place_of(jurisdiction: Column) -> Column:
    """city_of_norfolk_va as Norfolk VA: what a search for a place wants."""
    parts = F.filter(F.split(F.coalesce(jurisdiction, F.lit("")), "_", -1), lambda p: ~p.isin("city", "of", "county"))
    return F.trim(F.array_join(F.transform(parts, lambda p: F.when(F.length(p) == 2, F.upper(p)).otherwise(capital(p))), " "))


def component(c: Column) -> Column:
    """Percent-encoding as in a URI's component: letters, digits and -_.!~*'() stay."""
    out = F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("%7E"), F.lit("~"))
    for code, mark in (("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")")):
        out = F.replace(out, F.lit(code), F.lit(mark))
    return out


def url_encode(c: Column) -> Column:
    """Percent-encoding that leaves letters, digits and -_. alone."""
    return F.replace(F.replace(F.url_encode(c), F.lit("+"), F.lit("%20")), F.lit("*"), F.lit("%2A"))


def links_for(address: Column, jurisdiction: Column) -> Column:
    """struct<maps, homes> of an address; null for an empty one."""
    squeezed = lambda c, by: F.regexp_replace(F.trim(c), r"\s+", by)

    def of(full: Column) -> Column:
        slug = F.regexp_replace(squeezed(full, "-"), "[^A-Za-z0-9-]", "")
        return F.struct(F.concat(F.lit(MAP_LINK), component(squeezed(full, " "))).alias("maps"), F.concat(F.lit(HOME_LINK), slug, F.lit("_rb/")).alias("homes"))

    plain = F.trim(F.coalesce(address, F.lit("")))
    full = let(place_of(jurisdiction), lambda p: F.when(p == "", plain).otherwise(F.concat(plain, F.lit(", "), p)))
    return F.when(plain != "", let(full, of))


def slug_id(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9_]", "_"), "^_+|_+$", "")


def market_of(jurisdiction: Column) -> Column:
    """A market's name: 'Norfolk, va' as it is with a large state, city_of_norfolk_va as City of Norfolk, VA."""
    raw = F.trim(F.coalesce(jurisdiction, F.lit("")))
    given = r"(?i)^(.+?),\s*([a-z]{2})$"

    def of(w: Column) -> Column:
        last = F.element_at(w, -1)
        stated = (F.size(w) > 0) & (F.length(last) == 2)
        kept = F.when(stated, F.slice(w, 1, F.size(w) - 1)).otherwise(w)
        place = F.array_join(F.transform(kept, lambda p, i: F.when((p == "of") & (i > 0), p).otherwise(capital(p))), " ")
        return F.when(stated & (place != ""), F.concat(place, F.lit(", "), F.upper(last))).otherwise(place)

    named = let(F.filter(F.split(slug_id(raw), "_", -1), lambda p: p != ""), of)
    return F.when(raw.rlike(given), F.concat(F.trim(F.regexp_extract(raw, given, 1)), F.lit(", "), F.upper(F.regexp_extract(raw, given, 2)))).otherwise(named)


def market_label(key: Column) -> Column:
    """How a market is shown: without city of and county, the state after a comma."""

    def of(k: Column) -> Column:
        state = F.upper(F.regexp_extract(k, "_([a-z]{2})$", 1))
        bare = F.regexp_replace(F.regexp_replace(F.regexp_replace(k, "_[a-z]{2}$", ""), "^city_of_", ""), "_county$", "")
        place = F.array_join(F.transform(F.filter(F.split(bare, "_", -1), lambda p: p != ""), capital), " ")
        return F.when(state == "", place).otherwise(F.concat(place, F.lit(", "), state))

    return let(F.regexp_replace(F.lower(F.coalesce(key, F.lit(""))), "[^a-z0-9]+", "_"), of)


def rows_url(service: Column) -> Column:
    """The address of a feature service's rows: its layer's, the first one's if none is named; null if it is no such service."""

    def of(base: Column) -> Column:
        layered = base.rlike(r"/[0-9]+\z")
        return F.when(F.octet_length(base) >= 8, F.when(layered, F.concat(base, F.lit(ROWS_QUERY))).when(lower(base).contains("featureserver"), F.concat(base, F.lit("/0" + ROWS_QUERY))))

    return let(F.regexp_replace(F.coalesce(service, F.lit("")), r"/+\z", ""), of)


STAMP = r"^\s*([0-9]{1,4})-([0-9]{1,2})-([0-9]{1,2})(?:T([0-9]{1,2})(?::([0-9]{1,2})(?::([0-9]{1,2}))?)?)?"


def epoch_seconds(stamp: Column) -> Column:
    """Seconds of a UTC stamp or day since 1970; null before 1900 and for what isn't one. Days past a month's end run into the next."""
    part = lambda i: F.coalesce(F.regexp_extract(stamp, STAMP, i).try_cast("int"), F.lit(0))
    good = stamp.rlike(STAMP) & (part(1) >= 1900) & part(2).between(1, 12) & part(3).between(1, 31)
    month = F.make_date(F.when(good, part(1)), F.when(good, part(2)), F.lit(1))
    return (F.unix_date(month).cast("long") + part(3) - 1) * 86400 + part(4) * 3600 + part(5) * 60 + part(6)


def hours_between(earlier: Column, later: Column) -> Column:
    """-1 if either isn't a stamp."""
    return F.coalesce((epoch_seconds(later) - epoch_seconds(earlier)) / 3600.0, F.lit(-1.0))


def iso_from_unix(seconds: Column) -> Column:
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    rest = F.pmod(seconds, F.lit(86400))
    day = F.date_format(F.date_from_unix_date(F.floor(seconds / 86400).cast("int")), "yyyy-MM-dd")
    return F.concat(day, F.lit("T"), two(F.floor(rest / 3600)), F.lit(":"), two(F.floor(rest / 60) % 60), F.lit(":"), two(rest % 60), F.lit("Z"))


def plain_number(value: Column) -> Column:
    """A number without a needless fraction."""
    return F.when((value == F.floor(value)) & (F.abs(value) < 1e15), value.cast("long").cast("string")).otherwise(value.cast("string"))


def shown(kind: str, value: Column) -> Column:
    """A signal as text: money in whole dollars, a ratio with x, days with their unit, others plainly."""
    if kind == "money":
        return F.concat(F.lit("$"), F.format_number(F.floor(value + 0.5), 0))
    if kind == "days":
        return F.concat(plain_number(value), F.when(value == 1, " day").otherwise(" days"))
    return F.concat(plain_number(value), F.lit("x")) if kind == "ratio" else plain_number(value)


# How comparisons read.
READS = {"gte": "at least", "gt": "more than", "lte": "at most", "lt": "less than", "eq": "exactly"}


def explained(label: str, kind: str, op: str, needed: float, actual: Column) -> Column:
    """Why a property meets a condition or not."""
    need = F.concat(F.lit(f"(needs {READS[op]} "), shown(kind, F.lit(float(needed))), F.lit(")"))
    met = {"gte": actual >= needed, "gt": actual > needed, "lte": actual <= needed, "lt": actual < needed, "eq": actual == needed}[op]
    told = F.concat(F.when(met, "\u2713 ").otherwise("\u2717 "), F.lit(f"{label} "), shown(kind, actual), F.lit(" "), need)
    return F.when(actual.isNull(), F.concat(F.lit(f"\u2717 {label} is not measured for this property "), need)).otherwise(told)
