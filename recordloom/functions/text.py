"""String functions with C-locale (ASCII) semantics, as native column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = r"[ \t\n\x0B\f\r]"

#: The content hash is FNV-1a shaped with this start; its identifiers must stay stable.
HASH_START, LOW_32 = 1469598103934665603, 0xFFFFFFFF


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: expressions that name an operand many times would otherwise repeat it in the
    plan, and nest such repeats."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, rf"^{BLANKS}+|{BLANKS}+$", "")


def lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def upper(c: Column) -> Column:
    return F.translate(c, LOWER, UPPER)


def collapse(c: Column) -> Column:
    """Trimmed, inner white space as one space."""
    return F.regexp_replace(trim(c), rf"{BLANKS}+", " ")


def words(c: Column) -> Column:
    """ASCII alphanumeric runs, also split where a capital follows a small letter, in small letters."""
    return F.transform(F.regexp_extract_all(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), F.lit("[A-Za-z0-9]+"), 0), lower)


def slug(c: Column) -> Column:
    return F.array_join(words(c), "_")


def alphanumeric(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9]", "")


def is_digits(c: Column) -> Column:
    return c.rlike("^[0-9]+\\z")


def digits_in(c: Column) -> Column:
    return F.length(F.regexp_replace(c, "[^0-9]", ""))


def content_hash(c: Column) -> Column:
    """64-bit hash of the UTF-8 bytes as 16 hex digits. A fold on two 32-bit halves, so nothing overflows in ANSI mode."""
    start = F.struct(F.lit(HASH_START >> 32).cast("long").alias("hi"), F.lit(HASH_START & LOW_32).cast("long").alias("lo"))
    # times 2^40 + 435, modulo 2^64
    mixed = lambda hi, x: F.struct((hi * 435 + F.shiftright(x * 435, 32) + F.shiftleft(x, 8)).bitwiseAND(F.lit(LOW_32)).alias("hi"), (x * 435).bitwiseAND(F.lit(LOW_32)).alias("lo"))
    half = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")

    # as ISO-8859-1 each byte is a character, and its code the byte
    codes = F.transform(F.split(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1"), ""), lambda x: F.ascii(x).cast("long"))
    return F.when(c == "", F.concat(half(start["hi"]), half(start["lo"]))).otherwise(F.aggregate(codes, start, lambda a, x: mixed(a["hi"], a["lo"].bitwiseXOR(x)), lambda a: F.concat(half(a["hi"]), half(a["lo"]))))


def split_parts(c: Column) -> Column:
    """Trimmed parts of a composite value: at the first of , ; | and tab that leaves two or more, none empty. Else empty."""

    def cut(t: Column, sep: str) -> Column:
        return let(F.transform(F.split(t, sep, -1), trim), lambda p: F.when((F.size(p) >= 2) & ~F.exists(p, lambda x: x == ""), p))

    return let(trim(c), lambda t: F.coalesce(*[cut(t, sep) for sep in (",", ";", r"\|", "\t")], F.array().cast("array<string>")))
