import datetime as dt
import zoneinfo

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.functions import schedule, values
from recordloom.operators import columns


def test_column_tokens_and_forward(spark):
    assert columns.tokens("Ab", ["1é"]) == [columns.CLS, 4 + 33, 4 + 66, columns.SEP, 4 + 17, columns.OTHER, columns.OTHER]
    w = columns.random_weights(3)
    a = columns.forward(np.array([columns.tokens("owner", ["Ann"])]), w)
    padded = np.full((1, 40), columns.PAD)
    padded[0, : len(columns.tokens("owner", ["Ann"]))] = columns.tokens("owner", ["Ann"])
    assert np.allclose(a, columns.forward(padded, w)) and np.isclose(a.sum(), 1)
    rows = spark.createDataFrame([(1, "owner", ["Ann"]), (2, "due", None), (3, None, ["$5", None])], "example long, name string, values array<string>")
    got = {r["example"]: r for r in columns.tag(rows, w, ["x", "y", "z"]).collect()}
    assert set(got) == {1, 2, 3} and np.isclose(got[1]["probability"], a.max())


def test_owners_and_windows(spark):
    owners = spark.createDataFrame([("ACME LLC",), ("Estate of Ann Trust",), ("Ann Lee",), (None,), ("Incline Corpus",)], "o string")
    assert [r[0] for r in owners.select(schedule.owner_type(F.col("o"))).collect()] == ["business", "person", "person", "unknown", "person"]
    at = spark.createDataFrame([(dt.datetime(2024, 3, 8, 23, 1),)], "t timestamp")  # Friday, 18:01 in New York
    r = at.select(schedule.may_send(F.col("t"), F.lit("person"), F.lit("America/New_York")).alias("p"), schedule.may_send(F.col("t"), F.lit("business"), F.lit("America/New_York")).alias("b"), schedule.next_send(F.col("t"), F.lit("business"), F.lit("America/New_York")).alias("n")).first()
    assert r["p"] and not r["b"]
    assert r["n"] == dt.datetime(2024, 3, 11, 14, 0)  # Monday 9:00 by Friday's clocks: minutes are added in UTC


def windows(now, kind, zone):
    """As a loop over days."""
    local = now.replace(tzinfo=dt.timezone.utc).astimezone(zoneinfo.ZoneInfo(zone))
    minutes, today = local.hour * 60 + local.minute, (local.weekday() + 1) % 7
    for offset in range(8):
        day = (today + offset) % 7
        work = 1 <= day <= 5
        start, end, why = ((540, 1020, 0) if work else (0, 0, None)) if kind == "business" else (1050, 1230, 1) if work else (600, 1230, 2)
        if why is None:
            continue
        if offset == 0 and start <= minutes < end:
            return now, schedule.REASONS[why]
        if (late := offset * 1440 + start - minutes) > 0:
            return now + dt.timedelta(minutes=late), schedule.REASONS[why]


def test_every_hour_of_some_weeks(spark):
    start = dt.datetime(2024, 3, 7, 0, 7, 31)
    rows = [(start + dt.timedelta(minutes=37 * i), kind, zone) for i in range(400) for kind in ("business", "person") for zone in ("America/New_York", "America/Phoenix")]
    df = spark.createDataFrame(rows, "t timestamp, kind string, zone string")
    got = {(r["t"], r["kind"], r["zone"]): (r["w"]["at"], r["w"]["reason"]) for r in df.withColumn("w", schedule.next_window(F.col("t"), F.col("kind"), F.col("zone"))).collect()}
    assert all(got[r] == windows(*r) for r in rows)


def test_moments_in_a_zone(spark):
    rows = [(dt.datetime(2024, 11, 25, 22, 30), "America/New_York"), (dt.datetime(2024, 7, 4, 16, 5), "America/Los_Angeles"), (dt.datetime(2024, 7, 4, 7, 5), "America/Phoenix")]
    got = [r[0] for r in spark.createDataFrame(rows, "t timestamp, z string").select(schedule.in_zone(F.col("t"), F.col("z"))).collect()]
    assert got == ["Mon, Nov 25, 5:30 PM EST", "Thu, Jul 4, 9:05 AM PDT", "Thu, Jul 4, 12:05 AM MST"]


def test_zones_of_jurisdictions(spark):
    rows = spark.createDataFrame([("richmond_va",), ("phoenix_az",), ("king_wa",), ("cook_il",), ("denver_co",), ("elm_zz",), ("va",), (None,)], "j string")
    want = ["America/New_York", "America/Phoenix", "America/Los_Angeles", "America/Chicago", "America/Denver", *["America/New_York"] * 3]
    assert [r[0] for r in rows.select(schedule.zone_of(F.col("j"))).collect()] == want
    owners = spark.createDataFrame([("City of Elm",), ("Ann City",), ("A.B. Trustees",), ("Bank&Sons (hoa)",), ("  ",)], "o string")
    assert [r[0] for r in owners.select(schedule.owner_type(F.col("o"))).collect()] == ["business", "person", "business", "business", "unknown"]


def test_money_text_rounds_as_printf(spark):
    rng = np.random.default_rng(4)
    cents = rng.integers(0, 10**9, 2000) / 1000
    some = [0.0, 0.125, 0.375, 0.005, 0.015, 1.005, 2.675, 0.995, 0.9950000001, 9.999, 99.995, 1e17, 123456789012345.675, -0.125, -1.005, -3.0, *cents, *(-cents[:100]), *(rng.random(2000) * 10.0 ** rng.integers(-3, 14, 2000))]
    rows = spark.createDataFrame([(float(x),) for x in some] + [(None,)], "x double")
    got = [r[0] for r in rows.select(values.money_text(F.col("x"))).collect()]
    assert got == [f"{x:.2f}" for x in some] + [None]


def test_saved_weights_give_the_same_answers(spark, tmp_path):
    w = columns.random_weights(3)
    columns.save_weights(spark, w, str(tmp_path / "w"))
    back = columns.load_weights(spark, str(tmp_path / "w"), {k: v.shape for k, v in w.items()})
    ids = np.array([columns.tokens("owner", ["Ann"])])
    assert np.abs(columns.forward(ids, w) - columns.forward(ids, back)).max() < 1e-12
    for broken in ([("b", [2], [1.0])], [("b", [1], [float("nan")])], [("b", [1], [1.0])] * 2):
        spark.createDataFrame(broken, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(str(tmp_path / "bad"))
        with pytest.raises(ValueError, match="add up"):
            columns.load_weights(spark, str(tmp_path / "bad"))
    with pytest.raises(ValueError, match="this model"):
        columns.load_weights(spark, str(tmp_path / "w"), {"b": (3,)})
