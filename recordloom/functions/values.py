"""Parsing, validation, normalisation and coercion of canonical values by kind.

Kinds: id, name, address, money, date, status, text, email, phone, number. Lengths are in bytes. All native.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse, digits_in, is_digits, let, lower, split_parts, trim, upper, words

KINDS = ("id", "name", "address", "money", "date", "status", "text", "email", "phone", "number")
COERCIBLE = ("id", "money", "date")
WEAK = ("name", "address", "status", "text")

MONEY = r"^(?=[^.]*\.?[^.]*$)(?=[^$]*\$?[^$]*$)(?:[., $-]*[0-9][0-9., $]*|[., $-]*\([., $-]*[0-9][0-9., $]*\)[0-9., $]*)\z"
NUMBER = r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"
HEX = r"^([+-]?)0[xX]([0-9a-fA-F]*)\.?([0-9a-fA-F]*)(?:[pP]([+-]?[0-9]+))?\z"
TWO = r"[ ]*(\+[0-9]|[0-9]{1,2}+)"
YEAR_FIRST = rf"^([0-9]{{1,4}}+)([-/]){TWO}\2{TWO}(?:\z|[T ]([ ]*[0-9]{{1,2}}+:[ ]*[0-9]{{1,2}}+))"
YEAR_LAST = rf"^([0-9]{{1,2}}+)([-/]){TWO}\2[ ]*([0-9]{{1,4}}+)(?:\z|[T ]([ ]*[0-9]{{1,2}}+:[ ]*[0-9]{{1,2}}+))"

# Month names.
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def parse_money(c: Column) -> Column:
    """Dollar amounts with thousands and accounting negatives; null otherwise."""
    digits = F.regexp_replace(c, "[^0-9.]", "")
    amount = digits.try_cast("double")
    return F.when(c.rlike(MONEY) & (F.length(digits) <= 18), F.when(c.rlike(r"[-(]"), -amount).otherwise(amount))


def iso(year: Column, month: Column, day: Column) -> Column:
    """YYYY-MM-DD if these name a day between 1800 and 2200, else null. Null and odd parts give null."""
    y, m, d = (x.try_cast("int") for x in (year, month, day))
    text = F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0"))
    able = y.between(1800, 2200) & m.between(1, 12) & d.between(1, 31)
    return F.when(able, F.date_format(F.try_to_date(F.when(able, text), "yyyy-MM-dd"), "yyyy-MM-dd"))


def month_number(word: Column) -> Column:
    found = [F.when((F.length(word) >= 3) & F.lit(name).startswith(word), i) for i, name in enumerate(MONTHS, 1)]
    return F.coalesce(*found)


def parse_date(c: Column) -> Column:
    """ISO date of a day in year-first, year-last or spelt-month form, with an optional clock; null otherwise."""
    return let(trim(c), lambda t: F.when((F.octet_length(t) > 0) & (F.octet_length(t) <= 40), F.coalesce(numeric_date(t, YEAR_FIRST, 1, 3, 4), numeric_date(t, YEAR_LAST, 4, 1, 3), spelt_date(t))))


def numeric_date(t: Column, pattern: str, y: int, m: int, d: int) -> Column:
    part = lambda g: F.replace(F.regexp_extract(t, pattern, g), F.lit("+"), F.lit(""))
    clock = lambda i: F.trim(F.split_part(F.regexp_extract(t, pattern, 5), F.lit(":"), F.lit(i))).try_cast("int")
    timed = F.regexp_extract(t, pattern, 5)
    good = t.rlike(pattern) & ((timed == "") | ((F.length(timed) >= 4) & (clock(1) < 24) & (clock(2) < 60)))
    return F.when(good, iso(part(y), part(m), part(d)))


def spelt_date(t: Column) -> Column:
    def of(w: Column) -> Column:
        word = lambda i: F.get(w, F.lit(i))
        form = lambda m, d: F.when(month_number(word(m)).isNotNull() & is_digits(word(d)) & is_digits(word(2)) & (F.length(word(d)) <= 2) & (F.length(word(2)) == 4), iso(word(2), month_number(word(m)), word(d)))
        return F.when(F.size(w) == 3, F.coalesce(form(0, 1), form(1, 0)))

    return let(words(t), of)


def validate(kind: str, c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Whether a value is plausible for a kind; null counts as empty."""
    return let(trim(F.coalesce(c, F.lit(""))), lambda v: plausible(kind, v, low, high))


def hexadecimal(v: Column) -> Column:
    """The value of a hexadecimal number, which may have a fraction and a power of two."""
    part = lambda i: F.regexp_extract(v, HEX, i)
    digits = F.conv(F.concat(F.lit("0"), part(2), part(3)), 16, 10).try_cast("double")
    scale = F.pow(F.lit(2.0), F.coalesce(part(4).try_cast("double"), F.lit(0.0)) - 4 * F.length(part(3)))
    return digits * scale * F.when(part(1) == "-", -1).otherwise(1)


def plausible(kind: str, v: Column, low: float | None, high: float | None) -> Column:
    n, digits, alpha = F.octet_length(v), digits_in(v), v.rlike("[A-Za-z]")
    if kind == "id":
        good = n.between(3, 30) & parse_date(v).isNull() & ~v.contains("$") & (digits >= 2) & (digits * 10 >= n * 4)
    elif kind == "name":
        good = n.between(2, 80) & alpha & ~v.contains("$") & (digits * 2 <= n)
    elif kind == "address":
        good = n.between(5, 120) & alpha & (lower(v).contains("po box") | ((digits >= 1) & (digits * 2 <= n)))
    elif kind == "money":
        good = F.coalesce(parse_money(v).between(0, 1e10) & (parse_money(v) < 1e10), F.lit(False))
    elif kind == "date":
        good = parse_date(v).isNotNull()
    elif kind == "status":
        good = (n <= 60) & alpha
    elif kind == "text":
        good = n >= 3
    elif kind == "email":
        domain = F.substring_index(v, "@", -1)
        good = n.between(6, 254) & v.rlike(r"^[^@ ]+@[^@ ]*\z") & domain.rlike(r"^.+\.[^.]{2,}\z")
    elif kind == "number":
        good = (n <= 40) & (v.rlike(NUMBER) | (v.rlike(HEX) & v.rlike("[xX]\\.?[0-9a-fA-F]")))
        x = F.when(v.rlike(NUMBER), v.try_cast("double")).when(good, hexadecimal(v))
        good = good & (F.abs(x) < float("inf")) & ((x >= low) if low is not None else F.lit(True)) & ((x <= high) if high is not None else F.lit(True))
    elif kind == "phone":
        good = digits.between(10, 15) & v.rlike(r"^[-0-9() +.xX]*\z")
    else:
        raise ValueError(f"unknown kind {kind}")
    return F.when(n == 0, F.lit(False)).otherwise(F.coalesce(good, F.lit(False)))


def money_text(amount: Column) -> Column:
    """Two decimals, rounded by the amount's binary value as C's printf does: cents are exact of the fraction, and the product
    with 1000 that is held against their midpoint is exact with its error term (Dekker, 1971). Null stays null."""

    def of(x: Column) -> Column:
        whole = F.floor(F.abs(x)).cast("long")
        return let(F.abs(x) - whole.cast("double"), lambda f: F.concat(F.when(x < 0, "-").otherwise(""), parts(whole, f)))

    def parts(whole: Column, f: Column) -> Column:
        high = lambda v: v * 134217729.0 - (v * 134217729.0 - v)
        below = F.floor(f * 100).cast("long")
        beyond = (f * 1000.0 - (below * 10 + 5).cast("double")) + ((high(f) * 1000.0 - f * 1000.0) + (f - high(f)) * 1000.0)
        cents = below + F.when((beyond > 0) | ((beyond == 0) & (below % 2 == 1)), 1).otherwise(0)
        return let(cents, lambda c: F.concat((whole + F.when(c == 100, 1).otherwise(0)).cast("string"), F.lit("."), F.lpad((c % 100).cast("string"), 2, "0")))

    return F.when(amount.isNotNull() & ~F.isnan(amount), let(amount, of))


def normalize(kind: str, c: Column) -> Column:
    v = trim(F.coalesce(c, F.lit("")))
    if kind == "money":
        return let(v, lambda x: F.coalesce(let(parse_money(x), money_text), x))
    if kind == "date":
        return let(v, lambda x: F.coalesce(parse_date(x), x))
    return upper(collapse(v)) if kind == "id" else lower(collapse(v)) if kind == "email" else collapse(v)


def chosen(kind: str, c: Column, low: float | None = None, high: float | None = None) -> Column:
    """struct<value, reformatted>: the value itself if it is valid, else the first valid part inside it (id, money, date); null if none."""

    def of(v: Column) -> Column:
        own = F.when(plausible(kind, v, low, high) & (v != ""), F.struct(v.alias("value"), F.lit(False).alias("reformatted")))
        if kind not in COERCIBLE:
            return own
        after = F.when(v.contains(":"), trim(F.substring(v, F.instr(v, ":") + 1, F.length(v))))
        tokens = F.transform(F.split(v, " ", -1), lambda t: F.regexp_replace(t, r"^[:;,#()\[\]]+|[:;,#()\[\]]+\z", ""))
        found = F.get(F.filter(F.concat(F.array(after), tokens), lambda t: F.coalesce(t != "", F.lit(False)) & validate(kind, t)), F.lit(0))
        return F.coalesce(own, let(found, lambda x: F.when(x.isNotNull(), F.struct(x.alias("value"), F.lit(True).alias("reformatted")))))

    return let(trim(F.coalesce(c, F.lit(""))), of)


def coerce(kind: str, c: Column, low: float | None = None, high: float | None = None) -> Column:
    """struct<ok, value, reformatted>: the normal form of what chosen() finds."""
    return let(chosen(kind, c, low, high), lambda x: F.struct(x.isNotNull().alias("ok"), normalize(kind, F.coalesce(x["value"], F.lit(""))).alias("value"), F.coalesce(x["reformatted"], F.lit(False)).alias("reformatted")))


__all__ = ["KINDS", "coerce", "normalize", "parse_date", "parse_money", "split_parts", "validate"]
