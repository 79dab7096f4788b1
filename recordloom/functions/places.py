"""Parcels, addresses and property keys, as native column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import alphanumeric, is_digits, let, slug, upper, words

# Postal abbreviations, directions, street suffixes, unit markers.
ABBREVIATIONS = {
    "street": "st", "avenue": "ave", "av": "ave", "road": "rd", "lane": "ln", "drive": "dr", "court": "ct", "place": "pl",
    "boulevard": "blvd", "parkway": "pkwy", "highway": "hwy", "circle": "cir", "terrace": "ter", "trail": "trl", "square": "sq",
    "crescent": "cres", "north": "n", "south": "s", "east": "e", "west": "w", "apartment": "apt", "suite": "ste", "number": "no",
}
DIRECTIONS = ("n", "s", "e", "w", "ne", "nw", "se", "sw")
SUFFIXES = ("st", "ave", "rd", "ln", "dr", "ct", "pl", "blvd", "pkwy", "hwy", "cir", "ter", "trl", "sq", "way", "cres", "run", "loop", "pt", "walk")
UNITS = ("apt", "ste", "unit", "no")


def normalize_parcel(c: Column) -> Column:
    return upper(alphanumeric(F.coalesce(c, F.lit(""))))


def address_words(c: Column) -> Column:
    short = F.create_map(*[F.lit(x) for x in chain(*ABBREVIATIONS.items())])

    stripped = lambda w: F.when(is_digits(w), F.regexp_replace(w, "^0+(?=[0-9])", "")).otherwise(w)
    return F.transform(F.transform(words(F.coalesce(c, F.lit(""))), lambda w: F.coalesce(F.element_at(short, w), w)), stripped)


def normalize_address(c: Column) -> Column:
    return F.array_join(address_words(c), " ")


def parse_address(c: Column) -> Column:
    """struct<number, street, suffix, directional, unit, locatable>; empty strings where a part is missing.

    A fold over the words: after a unit marker the next word is the unit, the first direction and the last suffix count,
    the rest is the street. A single letter that ends a longer street is the unit. "Block of" can't be located.
    """
    return let(address_words(c), parsed_words)


def parsed_words(w: Column) -> Column:
    size = F.size(w)
    block = F.exists(F.transform(w, lambda x, i: F.coalesce(x.isin("block", "blk") & (F.get(w, i + 1) == "of"), F.lit(False))), lambda hit: hit)
    first = F.coalesce(F.get(w, F.lit(0)), F.lit(""))
    numbered = is_digits(first) | first.rlike("^[0-9].")
    rest = F.slice(w, F.when(numbered, 2).otherwise(1), F.greatest(size, F.lit(1)))
    empty = F.lit("")
    start = F.struct(F.array().cast("array<string>").alias("street"), empty.alias("suffix"), empty.alias("directional"), empty.alias("unit"), F.lit(False).alias("marked"), F.lit(0).alias("at"))

    def step(a: Column, x: Column) -> Column:
        at = a["at"] + 1
        marker = ~a["marked"] & x.isin(*UNITS) & (at < F.size(rest))
        direction = ~a["marked"] & ~marker & x.isin(*DIRECTIONS)
        suffix = ~a["marked"] & ~marker & ~direction & x.isin(*SUFFIXES)
        street = ~a["marked"] & ~marker & ~direction & ~suffix
        return F.struct(
            F.when(street, F.concat(a["street"], F.array(x))).otherwise(a["street"]).alias("street"),
            F.when(suffix, x).otherwise(a["suffix"]).alias("suffix"),
            F.when(direction & (a["directional"] == ""), x).otherwise(a["directional"]).alias("directional"),
            F.when(a["marked"], x).otherwise(a["unit"]).alias("unit"),
            marker.alias("marked"),
            at.alias("at"),
        )

    def finish(a: Column) -> Column:
        last = F.coalesce(F.get(a["street"], F.size(a["street"]) - 1), empty)
        lone = (a["unit"] == "") & (F.size(a["street"]) > 1) & last.rlike("^[a-z]\\z")
        street = F.array_join(F.when(lone, F.slice(a["street"], 1, F.size(a["street"]) - 1)).otherwise(a["street"]), " ")
        number = F.when(numbered, first).otherwise(empty)
        gone = lambda x: F.when(block, empty).otherwise(x)
        return F.struct(
            gone(number).alias("number"), gone(street).alias("street"), gone(a["suffix"]).alias("suffix"), gone(a["directional"]).alias("directional"),
            gone(F.when(lone, last).otherwise(a["unit"])).alias("unit"), (~block & (number != "") & (number != "0") & (street != "")).alias("locatable"),
        )

    return F.aggregate(rest, start, step, finish)


def join_key(address: Column) -> Column:
    """number street[ #unit] of a parsed address; null if it can't be located."""
    return F.when(address["locatable"], F.concat(address["number"], F.lit(" "), address["street"], F.when(address["unit"] != "", F.concat(F.lit(" #"), address["unit"])).otherwise("")))


def property_key(jurisdiction: Column, parcel: Column, address: Column) -> Column:
    """slug|p:PARCEL, else slug|a:address, else null."""
    p, a = normalize_parcel(parcel), normalize_address(address)
    return F.when(p != "", F.concat(slug(jurisdiction), F.lit("|p:"), p)).when(a != "", F.concat(slug(jurisdiction), F.lit("|a:"), a))
