import random

import pytest
from pyspark.sql import functions as F

from recordloom.functions import places, similarity, text, values


def one(spark, column, value):
    return spark.createDataFrame([(value,)], "v string").select(column(F.col("v")).alias("x")).first()["x"]


def all_of(spark, column, rows):
    frame = spark.createDataFrame(list(enumerate(rows)), "i int, v string").select("i", column(F.col("v")).alias("x"))
    return [r["x"] for r in sorted(frame.collect(), key=lambda r: r["i"])]


def fnv(s):
    h = text.HASH_START
    for b in s.encode():
        h = ((h ^ b) * 0x100000001B3) % 2**64
    return f"{h:016x}"


def test_content_hash(spark):
    rng = random.Random(1)
    rows = ["", "a", "é北", "x|y|2024-01-01"] + ["".join(chr(rng.choice([65, 122, 233, 0x4E2D, 0x1F600])) for _ in range(rng.randint(1, 30))) for _ in range(40)]
    assert all_of(spark, text.content_hash, rows) == [fnv(r) for r in rows]


def test_words_and_slug(spark):
    assert one(spark, text.words, "ParcelID-Number 12é3") == ["parcel", "id", "number", "12", "3"]
    assert one(spark, text.slug, "Total  Assessed_Value") == "total_assessed_value"
    assert one(spark, text.collapse, " a\t\n b ") == "a b"
    assert one(spark, text.split_parts, "41.5, -87.6") == ["41.5", "-87.6"]
    assert one(spark, text.split_parts, "a,,b") == [] and one(spark, text.split_parts, "plain") == [] and one(spark, text.split_parts, "a,;b") == ["a", ";b"]
    assert one(spark, text.split_parts, "a,,b|c") == ["a,,b", "c"]


MONEY = {"$1,234.50": 1234.5, "(1,000)": -1000.0, "-5": -5.0, "1 000": 1000.0, "$$5": None, "5)": None, "(5": None, "1-5": None, "": None, "abc": None, "1.2.3": None, "12345678901234567890": None, "$ 7": 7.0}


def test_money(spark):
    assert all_of(spark, values.parse_money, list(MONEY)) == list(MONEY.values())


DATES = {
    "2026-02-11": "2026-02-11", "2026/2/1": "2026-02-01", "2/11/2026": "2026-02-11", "12-31-1999": "1999-12-31", "February 11, 2026": "2026-02-11", "11 Feb 2026": "2026-02-11", "Sept 5, 2024": "2024-09-05",
    "2026-02-11T10:00:00Z": "2026-02-11", "2026-02-11 09:30": "2026-02-11", "2026-02-11 garbage": None, "2026-02-30": None, "2024-02-29": "2024-02-29", "2023-02-29": None, "1700-01-01": None, "": None, "2026-02-11 25:00": None,
    "2026- 6-8": "2026-06-08", "13/40/2020": None, "Fe 1, 2020": None, "x" * 50: None,
}


def test_dates(spark):
    assert all_of(spark, values.parse_date, list(DATES)) == list(DATES.values())


@pytest.mark.parametrize(
    ("kind", "good", "bad"),
    [
        ("id", ["AB-1234", "12-34-567"], ["ab", "2024-01-01", "$1234", "abcdefgh12", ""]),
        ("name", ["Ann Lee", "J2"], ["1", "12345a", "$Ann"]),
        ("address", ["12 Elm St", "PO Box 9", "po box x"], ["Elm Street", "12345678 a", "1 a"]),
        ("money", ["$5", "0"], ["-5", "(5)", "99999999999"]),
        ("email", ["a@b.co"], ["@b.co", "a@@b.co", "a b@c.de", "a@b.c"]),
        ("number", ["1e5", "-3.5", ".5"], ["1d", "abc", "1 2", ""]),
        ("phone", ["(555) 123-4567", "+1 555 123 4567 x1"], ["555-1234", "555a1234567"]),
        ("status", ["Open"], ["123", "x" * 61]),
        ("text", ["abc"], ["ab", " a "]),
    ],
)
def test_validators(spark, kind, good, bad):
    assert all_of(spark, lambda c: values.validate(kind, c), good + bad) == [True] * len(good) + [False] * len(bad)


def test_normal_forms_and_coercion(spark):
    assert one(spark, lambda c: values.normalize("money", c), "2.675") == "2.67"
    assert one(spark, lambda c: values.normalize("money", c), "$1,000") == "1000.00"
    assert one(spark, lambda c: values.normalize("id", c), " ab  12 ") == "AB 12"
    got = one(spark, lambda c: values.coerce("id", c), "Parcel: (12-345),")
    assert (got["ok"], got["reformatted"]) == (True, True) and got["value"] in ("12-345", "(12-345),")
    assert one(spark, lambda c: values.coerce("date", c), "filed on 2024-05-06;").asDict() == {"ok": True, "value": "2024-05-06", "reformatted": True}
    assert not one(spark, lambda c: values.coerce("name", c), "12345")["ok"]
    assert values.validate("number", F.lit("91"), -90.0, 90.0) is not None


def test_addresses(spark):
    got = one(spark, places.parse_address, "0012 North Elm Street Apt 4").asDict()
    assert got == {"number": "12", "street": "elm", "suffix": "st", "directional": "n", "unit": "4", "locatable": True}
    assert one(spark, places.parse_address, "100 Block of Elm St")["locatable"] is False
    assert one(spark, places.parse_address, "7 Oak Hill B")["unit"] == "b"
    assert one(spark, places.parse_address, "0 Elm St")["locatable"] is False and one(spark, places.parse_address, None)["locatable"] is False
    assert one(spark, lambda c: places.join_key(places.parse_address(c)), "12 Elm Ave Unit 3") == "12 elm #3"
    assert one(spark, lambda c: places.property_key(F.lit("Elm County"), c, F.lit("1 A St")), "a-1 b") == "elm_county|p:A1B"
    assert one(spark, lambda c: places.property_key(F.lit("Elm"), c, F.lit("1 Main Street")), " - ") == "elm|a:1 main st"


def test_similarity():
    assert similarity.jaro_winkler("", "") == 1.0 and similarity.jaro_winkler("a", "") == 0.0
    assert similarity.jaro_winkler("martha", "marhta") == pytest.approx(0.9611, abs=1e-4)
    assert similarity.jaro_winkler("dixon", "dicksonx") == pytest.approx(0.8133, abs=1e-4)
