"""Aliases of counties, compiling until stable, stages that measure themselves, the column gate, valuations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import columns, conversations, mapping, runs, valuation
from recordloom.plans import county


def test_aliases(spark):
    rows = ["City of Norfolk VA", "Elm County TX", "norfolk", "", "Fairfax_city_va"]
    got = [r[0] for r in spark.createDataFrame([(r,) for r in rows], "c string").select(county.aliases(F.col("c"))).collect()]
    assert got == [["city_of_norfolk_va", "norfolk_va"], ["elm_county_tx", "elm_tx"], ["norfolk"], [], ["fairfax_city_va", "fairfax_va"]]


def test_events_of_counties(spark):
    keys = ["norfolk|p:1", "city_of_norfolk|p:2", "Norfolk_VA|p:3", "suffolk|a:12 norfolk_ st", "suffolk|p:4", "norfolkx|p:5", "north_norfolk|p:6", "norfolk_county|p:7"]
    names = ["norfolk", "suffolk", "none"]
    events = spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "property_key string, id int")
    got = {(r["county"], r["property_key"]) for r in county.of_counties(events, spark.createDataFrame([(n,) for n in names], "county string")).collect()}
    assert got == {(n, k) for n in names for k in keys if k.startswith(n + "|") or f"_{n}|" in k or f"{n}_" in k.lower()}


def test_compiling_goes_on_while_events_arrive(spark, tmp_path):
    rows = [("p", "2024-01-01")]
    seen = []

    def read():
        return spark.createDataFrame(rows, "property_key string, recorded_at string")

    def compiled(events):
        seen.append(events.count())
        if len(seen) == 1:
            rows.append(("q", "2024-01-02"))  # arrives during the first pass
        return events.groupBy("property_key").count()

    state = county.compile_until_stable(read, compiled, str(tmp_path), "elm")
    assert (state["passes"], state["stable"], state["stamp"]) == (2, True, "2:2024-01-02") and seen == [1, 2]
    result, last = county.current(spark, str(tmp_path), "elm")
    assert result.count() == 2 and last["stable"] and county.current(spark, str(tmp_path), "oak") is None

    def restless(events):
        rows.append(("r", f"2024-02-{len(rows):02d}"))
        return events

    state = county.compile_until_stable(read, restless, str(tmp_path), "elm")
    assert (state["passes"], state["stable"]) == (3, False) and county.current(spark, str(tmp_path), "elm")[0].count() == len(rows) - 1


def test_warm_results_and_retries(spark):
    now = dt.datetime(2024, 1, 1, 12, 0, 30)
    ago = lambda s: now - dt.timedelta(seconds=s)
    rows = [("running", None, ago(1199)), ("running", None, ago(1200)), ("error", None, ago(59)), ("error", None, ago(60)), ("running", "errored", ago(5)), (None, None, None), ("complete", "terminated", ago(9))]
    df = spark.createDataFrame(rows, "state string, runtime string, updated timestamp").withColumn("now", F.lit(now))
    got = [tuple(r) for r in df.select(county.reusable(F.col("state"), F.col("updated"), F.col("now")), county.retry_key(F.col("state"), F.col("runtime"), F.col("updated"), F.col("now"))).collect()]
    assert got == [(True, ""), (False, ""), (False, ""), (False, "2024-01-01T11:59:30.000Z"), (True, "2024-01-01T12:00:00.000Z"), (False, ""), (False, "2024-01-01T12:00:00.000Z")]


def test_stages_measure_themselves(spark):
    start = spark.range(100).withColumn("x", F.when(F.col("id") % 4 > 0, F.col("id")))
    result, rows = runs.measured(start, [("keep", lambda d: d.where("id < 60")), ("sum", lambda d: d.groupBy((F.col("id") % 7).alias("k")).agg(F.sum("x").alias("s"))), ("none", lambda d: d.where("k > 99"))], "r1")
    got = [tuple(r)[:5] for r in rows.orderBy("place").collect()]
    assert got == [("r1", 0, "keep", 60, 105), ("r1", 1, "sum", 7, 14), ("r1", 2, "none", 0, 0)] and result.count() == 0
    assert all(r["ms"] > 0 for r in rows.collect())
    long = rows.groupBy("run_id").pivot("stage", ["keep", "sum"]).agg(F.first("ms"))
    assert runs.stage_times(long, ["keep", "sum"]).count() == 2


def test_a_sure_tagger_names_columns(spark):
    fields = mapping.schema_fields(spark)
    classes = [f[0] for f in mapping.SCHEMA] + ["none"]
    weights = columns.random_weights(len(classes), seed=5)
    weights["head"] = weights["head"] * 40
    labels = {"qqx": "$12.50", "Parcel Number": "P-00123", "zz9": "2024-01-02", "vvv": "Ann Lee", "lat lon": "12.5, -70.25", "uuu": ""}
    cells = spark.createDataFrame([("s", r, i, k, v) for r in range(5) for i, (k, v) in enumerate(labels.items())], "source_id string, record long, label_ord int, label string, value string")
    want = {}
    for k, v in labels.items():
        t = columns.tokens(k, [v] * 3 if v else [], len(weights["position"]))
        p = columns.forward(np.array([t]), weights)[0]
        if p.max() >= 0.7 and classes[p.argmax()] != "none":
            want[k] = (classes[p.argmax()], p.max())
    got = mapping.candidates(cells, fields, (weights, classes, 4)).collect()
    assert want and any(r["neural"] > 0 for r in got)
    for r in got:
        name, p = want.get(r["label"], ("", 0.0))
        neural = p if r["name"] == name else 0.0
        assert r["neural"] == pytest.approx(neural)
        evidence = max(r["similarity"], neural) if r["part"] < 0 else r["similarity"]
        assert r["confidence"] == pytest.approx(0.55 * evidence + 0.45 * r["pass_rate"])
        if r["part"] >= 0:  # each part by its own word
            assert r["similarity"] == pytest.approx(max(mapping.label_similarity([["lat", "lon"][r["part"]]], s.split()) for f in mapping.SCHEMA if f[0] == r["name"] for s in (*f[5], f[0].replace("_", " "))))
    plain = {(r["name"], r["label"], r["part"]) for r in mapping.infer_mapping(cells, fields).collect()}
    assert ("latitude", "lat lon", 0) in plain and ("longitude", "lat lon", 1) in plain


def test_flat_weights_and_parity():
    w = columns.random_weights(5, seed=1)
    shapes = {k: v.shape for k, v in w.items()}
    back = columns.from_flat(columns.flat_weights(w), shapes)
    assert all(np.array_equal(w[k], back[k]) for k in w)
    rows = [("owner name", ["Ann", "Bo"]), ("", []), ("Betrag €", ["12,50"])]
    assert columns.parity(w, back, rows) == (0.0, 0) and columns.parity(w, columns.random_weights(5, seed=2), rows)[0] > 0
    with pytest.raises(ValueError, match="values for a model"):
        columns.from_flat(columns.flat_weights(w)[:-1], shapes)


def test_valuations(spark):
    r = np.random.default_rng(3)
    n = 12 + len(valuation.USES)
    layers = [(r.standard_normal((n, 7)), r.standard_normal(7)), (r.standard_normal((7, 4)), r.standard_normal(4)), (r.standard_normal((4, 1)) * 3, r.standard_normal(1))]
    mean, std = r.standard_normal(n), r.uniform(0.5, 2, n)
    rows = [
        ("va", 200_000.0, 120_000.0, 50_000.0, 1800.0, 1990.0, 2024.0, 5000.0, "Single family"), ("VA", 0.0, 1.0, 1.0, 500.0, 1990.0, 2024.0, 1.0, "x"), ("zz", 100.0, 0.0, 0.0, 0.0, 0.0, 2020.0, 0.0, None),
        ("md", 5e6, None, None, None, None, 2024.0, None, "VACANT land"), ("md", 9e4, 5e4, 1e4, 100.0, 2030.0, 2024.0, -5.0, "Apartment"), (None, 5.0, 1.0, 1.0, 1.0, 1.0, 1.0, 1.0, "y"),
    ]
    schema = "state string, assessed double, improvement_value double, land_value double, sqft double, year_built double, year double, land_area double, use string"
    ratios = {"VA": 1.1, "MD": 0.9}
    got = valuation.valued(spark.createDataFrame(rows, schema), spark.createDataFrame([("va", 1.1), ("md", 0.9)], "state string, ratio double"), layers, mean.tolist(), std.tolist(), 0.2).collect()

    def by_hand(row):
        state, assessed, imp, land, sqft, built, year, area, use = [x if i in (0, 8) else (x or 0.0) for i, x in enumerate(row)]
        if (state or "").upper() not in ratios or assessed <= 0:
            return None
        ratio, a, low = ratios[state.upper()], max(assessed, 1), (use or "").lower()
        age = year - built if 1700 < built <= year else -1
        group = "residential" if any(w in low for w in ("resid", "condo", "single", "town home")) else "apartments" if "apart" in low else "vacant" if "vacant" in low or "land" in low else "other"
        x = [math.log(a * ratio), math.log(a), imp / a if imp > 0 else 0, land / a if land > 0 else 0, float(imp <= 0), math.log1p(sqft), float(sqft <= 100), math.log1p(a / sqft if sqft > 100 else 0), math.log1p(max(age, 0)), float(age < 0), math.log1p(max(area, 0)), (year - 2021) / 5]
        h = (np.array(x + [float(group == g) for g in valuation.USES]) - mean) / std
        for i, (w, b) in enumerate(layers):
            h = h @ w + b
            h = np.maximum(h, 0) if i < 2 else h
        return assessed * ratio * math.exp(min(3, max(-3, h[0])))

    want = {(x[0], x[1]): by_hand(x) for x in rows}
    assert len(got) == len(rows) and sum(v is not None for v in want.values()) == 3
    for g in got:
        v = want[(g["state"], g["assessed"])]
        assert (g["estimate"], g["low"], g["high"]) == ((None,) * 3 if v is None else (pytest.approx(v), pytest.approx(v * 0.8), pytest.approx(v * 1.2)))


def test_long_conversations_are_folded(spark):
    rows = [("a", i, "user" if i % 2 else "assistant", f"turn {i} " + "x" * 200) for i in range(30)] + [("b", i, "user", str(i)) for i in range(24)] + [("c", None, None, None)]
    got = {r["conv_id"]: (r["kept"], r["summary"]) for r in conversations.compacted(spark.createDataFrame(rows, "conv_id string, turn int, role string, text string")).collect()}
    whole = "\n".join(f"{r}: {t}" for _, _, r, t in rows[:22])
    assert got == {"a": (8, whole[-2400:]), "b": (24, ""), "c": (1, "")}
