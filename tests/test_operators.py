import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recordloom.operators import classify, decisions, lifecycle, mapping, operations, valuation, weak_labels
from recordloom.operators import compile as comp


def test_lifecycle_against_a_walk(spark):
    rng = random.Random(7)
    kinds = [*lifecycle.RANKS, "code_violation"]
    rows = [(f"p{rng.randint(0, 20)}", rng.choice(kinds), rng.choice(["", "2024-01-01", "2024-02-02", "2023-05-05"]), "r", f"{i:04d}") for i in range(600)]
    events = spark.createDataFrame(rows, "property_key string, kind string, event_date string, recorded_at string, id string")
    state, moves = {}, []
    for key, kind, day, _, i in sorted(rows, key=lambda r: (r[0], r[2], r[3], r[4])):
        rank, now = lifecycle.RANKS.get(kind), state.setdefault(key, 0)
        if rank is not None and (rank > now or (rank == 0 and now > 0)):
            state[key] = rank
            moves.append((key, i, rank))
    assert {r["property_key"]: r["state_rank"] for r in lifecycle.states(events).collect()} == state
    assert sorted((r["property_key"], r["id"], r["state_rank"]) for r in lifecycle.transitions(events).collect()) == sorted(moves)


def fold(seen):
    best, clashes = None, 0
    for o in seen:
        if best is None:
            best = o
            continue
        ruled = o["authority"] != ""
        a, b = (x["source_label"] == o["authority"] for x in (o, best))
        if ruled and a != b:
            won = a
        elif o["as_of"] and best["as_of"] and o["as_of"] != best["as_of"]:
            won = o["as_of"] > best["as_of"]
        else:
            won = o["confidence"] > best["confidence"] or (o["confidence"] == best["confidence"] and o["event_date"] >= best["event_date"])
        clashes += o["value"] != best["value"]
        best = o if won else best
    return best["value"], clashes


def test_resolution_with_mixed_editions(spark):
    rng = random.Random(9)
    names = "property_key field kind authority source_label event_date recorded_at id as_of value source_id confidence".split()
    rows = [("p%d" % (i % 40), "owner", "name", rng.choice(["deed"] * 1) if (i % 40) % 2 else "", rng.choice(["deed", "tax"]), f"2024-01-{rng.randint(1, 28):02d}", "r", f"{i:05d}", rng.choice(["", "2023", "2024"]), rng.choice("abc"), "s%d" % rng.randint(1, 3), rng.choice([0.5, 0.9])) for i in range(800)]
    got = comp.resolve(spark.createDataFrame(rows, ", ".join(f"{n} {'double' if n == 'confidence' else 'string'}" for n in names)))
    by = {}
    for r in sorted((dict(zip(names, r)) for r in rows), key=lambda r: (r["property_key"], r["event_date"], r["recorded_at"], r["id"])):
        by.setdefault(r["property_key"], []).append(r)
    want = {k: fold(v) for k, v in by.items()}
    assert {r["property_key"]: (r["value"], len(r["conflicts"])) for r in got.collect()} == want


def test_buckets_by_first_fit(spark):
    rows = [("g", "a", "n", "st"), ("g", "b", "s", "st"), ("g", "c", "", "st"), ("g", "d", "s", ""), ("g", "e", "n", "ave"), ("h", "x", "", "")]
    got = comp.buckets(spark.createDataFrame(rows, "group_key string, property_key string, directional string, suffix string"))
    assert {r["property_key"]: r["bucket"] for r in got.collect()} == {"a": 0, "b": 1, "c": 0, "d": 1, "e": 2, "x": 0}


def test_leave_one_out_equals_refits(spark):
    rng = random.Random(3)
    docs = [(i, "ab"[i % 2], " ".join(rng.choice(["tax", "roll", "deed", "court", "bid", "x%d" % i, "permit"]) for _ in range(rng.randint(0, 9)))) for i in range(14)]
    frame = spark.createDataFrame(docs, "doc long, class string, text string")
    bag = classify.bags(frame, "doc", F.col("text"), "class").cache()
    hits, totals = classify.train(bag, frame)
    loo = {(r["doc"], r["class"]): r["probability"] for r in classify.leave_one_out(frame.select("doc", "class"), bag, hits, totals).collect()}
    for held in (0, 5, 9):
        h, t = classify.train(bag.where(F.col("doc") != held), frame.where(F.col("doc") != held))
        for r in classify.predict(frame.where(F.col("doc") == held), bag.where(F.col("doc") == held).drop("class"), h, t).collect():
            assert abs(loo[held, r["class"]] - r["probability"]) < 1e-9


def test_inserts_are_idempotent(spark):
    a = spark.createDataFrame([("1", "r1"), ("2", "r1"), ("2", "r0")], "id string, recorded_at string")
    first = operations.insert_new(a.limit(0), a)
    assert sorted((r["id"], r["recorded_at"]) for r in first.collect()) == [("1", "r1"), ("2", "r0")]
    assert operations.insert_new(first, a).count() == 0


def test_budget_replay(spark):
    rows = [("h", t, i) for i, t in enumerate([0, 1, 2, 3, 59, 60, 61, 62, 200])]
    got = operations.host_budget(spark.createDataFrame(rows, "host string, at_s long, id long"), per_window=3, window_s=60).collect()
    assert [r["allowed"] for r in sorted(got, key=lambda r: r["id"])] == [True, True, True, False, False, True, True, True, True]


def test_graph_walk_cycle_and_missing(spark):
    node = lambda t, e: {"kind": "condition", "signal": "x", "op": "gte", "value": 1.0, "then": t, "else": e}
    graph = {"entry": "a", "nodes": {"a": node("b", "a2"), "a2": node("a", "a"), "b": {"kind": "approval", "next": "c"}, "c": {"kind": "action", "name": "match"}}}
    rows = spark.createDataFrame([(1, {"x": 2.0}), (2, {"x": 0.0}), (3, {})], "i int, signals map<string,double>")
    got = {r["i"]: (r["outcome"], r["requires_approval"], r["valid"]) for r in decisions.evaluate(rows, graph).collect()}
    assert got == {1: ("match", True, True), 2: (None, False, False), 3: (None, False, False)}
    assert decisions.validate_graph(graph) == [] and decisions.validate_graph({"entry": "z", "nodes": graph["nodes"]})
    assert decisions.validate_graph(graph, ["y"]) == ["a: unknown signal x", "a2: unknown signal x"]
    assert decisions.validate_graph({"entry": "c", "nodes": {"c": {"kind": "action", "name": "discard"}}}) == ["no match action: nothing can ever qualify"]


def cells(rows):
    return [("s", i, j, label, v) for i, r in enumerate(rows) for j, (label, v) in enumerate(r)]


def test_mapping_from_labels_and_values(spark):
    rows = [[("Parcel Number", f"12-{i:04d}"), ("Owner Name", "Ann Lee"), ("Amount Due", f"${i}.50"), ("Sale Date", "1/2/2024"), ("latitude_longitude", f"41.{i}, -87.{i}")] for i in range(4)]
    frame = spark.createDataFrame(cells(rows), "source_id string, record long, label_ord int, label string, value string")
    schema = tuple((*f[:5], (*f[5], f"{f[0]} pair", "latitude longitude"), *f[6:]) if f[0] in ("latitude", "longitude") else f for f in mapping.SCHEMA)
    fields = mapping.schema_fields(spark, schema)
    found = mapping.infer_mapping(frame, fields).collect()
    got = {r["name"]: (r["label"], r["part"]) for r in found}
    assert {k: got[k] for k in ("parcel_id", "owner", "amount_due", "auction_date")} == {"parcel_id": ("Parcel Number", -1), "owner": ("Owner Name", -1), "amount_due": ("Amount Due", -1), "auction_date": ("Sale Date", -1)}
    assert got["latitude"] == ("latitude_longitude", 0) and got["longitude"] == ("latitude_longitude", 1)
    none = frame.where("label in ('Amount Due', 'Sale Date')")
    assert mapping.infer_mapping(none, fields).count() == 0


def test_mapping_scores(spark):
    golden = spark.createDataFrame([("s", "owner", ["Owner"]), ("s", "zip", ["Zip", ""]), ("s", "status", ["Status"])], "source_id string, name string, labels array<string>")
    inferred = spark.createDataFrame([("s", "owner", "Owner"), ("s", "buyer", "X")], "source_id string, name string, label string")
    r = mapping.mapping_scores(golden, inferred).first()
    assert (r["tp"], r["spurious"], r["missing"]) == (1, 1, 1) and r["precision"] == 0.5


def label_model_by_hand(votes, rounds=20):
    by = {}
    for e, f, c in votes:
        by.setdefault(e, {})[f] = c
    names = sorted({f for _, f, _ in votes})
    w = dict.fromkeys(names, 1.0)

    def shares(v):
        out = {}
        for f, c in v.items():
            out[c] = out.get(c, 0.0) + w[f]
        total = sum(out.values())
        return min((-x / total, c) for c, x in out.items())

    for _ in range(rounds):
        best = {e: shares(v) for e, v in by.items()}
        new = {}
        for f in names:
            fired = [e for e, v in by.items() if f in v and -best[e][0] >= 0.5]
            rate = sum(by[e][f] == best[e][1] for e in fired) / len(fired) if fired else None
            new[f] = 0.1 if rate is None else max(0.05, math.log(max(rate, 1e-3) / max(1 - rate, 1e-3)))
        done = all(abs(new[f] - w[f]) <= 1e-4 + 1e-5 * abs(w[f]) for f in names)
        w.update(new)
        if done:
            break
    return {e: (shares(v)[1], -shares(v)[0]) for e, v in by.items()}, w


def test_label_model(spark):
    r = random.Random(3)
    votes = [(e, f, r.choice("abc") if r.random() < p else "abc"[e % 3]) for e in range(120) for f, p in (("good", 0.1), ("fair", 0.4), ("bad", 0.9)) if r.random() < 0.8]
    out, weights = weak_labels.label_model(spark.createDataFrame(votes + votes[:3], "example long, lf string, class string"))
    want, w = label_model_by_hand(votes)
    assert weights == pytest.approx(w) and weights["good"] > weights["bad"] >= weak_labels.FLOOR
    assert {x["example"]: (x["class"], pytest.approx(x["confidence"])) for x in out.collect()} == want
    agreed = weak_labels.label_model(spark.createDataFrame([(1, "f", "a"), (2, "f", "b")], "example long, lf string, class string"))[1]
    assert agreed["f"] == pytest.approx(math.log(1 / 1e-3))  # never wrong: log odds at the least rate


def test_suspects_are_ranked_without_one_task(spark):
    votes = [(e, f, c) for e, cs in enumerate(["aab", "bbb", "abb", "cab"]) for f, c in zip("xyz", cs)]
    truth = spark.createDataFrame([(0, "b"), (1, "b"), (2, "a"), (3, "d"), (9, "a")], "example long, class string")
    v = spark.createDataFrame(votes, "example long, lf string, class string")
    got = weak_labels.suspects(v, truth, {"x": 1.0, "y": 2.0, "z": 0.5})
    assert {tuple(r) for r in got.collect()} == {(3, "d", 0.0, 1), (0, "b", 0.5 / 3.5, 2), (2, "a", 1.0 / 3.5, 3)}
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString().split("Join")[0]
    a = weak_labels.audit(v, truth, {"x": 1.0, "y": 2.0, "z": 0.5}).first()
    assert (a["examples"], a["covered"], a["agree"], a["suspects"]) == (5, 4, 1, 3) and a["coverage"] == 0.8


def test_names_that_hold_all_words_of_a_term(spark):
    columns = spark.createDataFrame([(1, "sale price total"), (2, "priceSale"), (3, "price"), (4, "sale_date price"), (5, None)], "example long, name string")
    lexicon = spark.createDataFrame([("sale_price", "amount"), ("price", "amount"), ("sale date", "day"), ("price_price", "other")], "term string, class string")
    got = {r["example"]: r["class"] for r in weak_labels.token_votes(columns, lexicon.where("class != 'other'")).collect()}
    assert got == {1: "amount", 2: "amount"}  # 4 has two classes
    assert {r["example"]: r["class"] for r in weak_labels.token_votes(columns, lexicon).collect()} == {3: "other"}  # a word twice is two words


def test_network_estimate(spark):
    rows = spark.createDataFrame([(100.0, 1.0, 2.0), (50.0, -1.0, 0.5)], "assessed double, a double, b double")
    w = [(np.array([[1.0, 0.0], [0.0, 1.0]]), np.zeros(2)), (np.array([[0.1], [0.2]]), np.array([0.05]))]
    got = [r["estimate"] for r in valuation.estimate(rows, ["a", "b"], w).collect()]
    assert np.allclose(got, [100 * np.exp(0.1 + 0.4 + 0.05), 50 * np.exp(0.1 + 0.05)])


def test_medians_hold_no_group_in_one_task(spark):
    import random
    import statistics

    from pyspark.sql import functions as F

    from recordloom.operators import valuation

    rng = random.Random(3)
    values = {"a": [rng.random() for _ in range(5000)], "b": [rng.choice([1.0, 2.0, 3.0]) for _ in range(3001)], "c": [2.0, 1.0], None: [7.0]}
    rows = [(s, x) for s, xs in values.items() for x in xs] + [("a", None), ("d", None)]
    df = spark.createDataFrame(rows, "state string, x double")
    got = {r["state"]: r["median"] for r in valuation.medians(df, ["state"], F.col("x")).collect()}
    assert got == {s: statistics.median(xs) for s, xs in values.items()} | {"d": None}
    sales = df.where("x is not null").select("state", F.col("x").alias("price"), F.lit(1.0).alias("assessed"))
    ratios = valuation.state_ratios(sales)
    assert {r["state"]: (r["ratio"], r["pooled"]) for r in ratios.collect()} == {s: (statistics.median(xs), statistics.median(sum(values.values(), []))) for s, xs in values.items()}
    for out in (ratios, valuation.error_measures(sales.withColumn("estimate", F.lit(1.0)))):
        assert "median(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_scored_where_their_documents_lie(spark, monkeypatch):
    from pyspark.sql import functions as F

    from recordloom.operators import classify

    texts = ["red apple apple pear", "red plum pear", "blue sky sky cloud", "blue cloud rain apple", "rain sky sun", ""]
    docs = spark.createDataFrame([(i, "ab"[i > 1 and i < 5], t) for i, t in enumerate(texts)], "doc long, class string, text string")
    bag, labels = classify.bags(docs, "doc", F.col("text"), "class"), docs.select("doc", "class")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(doc" in plan(bag) and "token" not in "".join(x for x in plan(bag).splitlines() if "hashpartitioning" in x)
    model = classify.train(bag, labels)
    want = None
    for most in (20_000, 2, 1):  # all words broadcast, or some shuffled
        monkeypatch.setattr(classify, "COMMON", most)
        p = {(r["doc"], r["class"]): round(r["probability"], 9) for r in classify.predict(labels, bag.drop("class"), *model).collect()}
        loo = {(r["doc"], r["class"]): round(r["probability"], 9) for r in classify.leave_one_out(labels, bag, *model).collect()}
        sweep = [tuple(r) for r in classify.sweep(labels, bag, *model).orderBy("alpha").collect()]
        want = want or (p, loo, sweep)
        assert (p, loo, sweep) == want and len(p) == len(loo) == 12
    # all constants share one pass: the words are joined as often for five as for one
    joins = lambda alphas: plan(classify.sweep(labels, bag, *model, alphas)).count("Join")
    assert joins(classify.ALPHAS) == joins((1.0,))


def test_extract_reads_cells_once(spark, tmp_path):
    from recordloom.operators import mapping

    rows = [("s", 1, 0, "apn", "P-0001"), ("s", 1, 1, "note", "x"), ("s", 2, 1, "note", "y"), ("t", 1, 0, "apn", "P-0002")]
    spark.createDataFrame(rows, "source_id string, record long, label_ord int, label string, value string").write.parquet(f"{tmp_path}/cells")
    found = spark.createDataFrame([("s", 0, "parcel_id", "apn", -1, 1.0), ("s", 1, "owner", "name", -1, 1.0)], "source_id string, field_ord int, name string, label string, part int, confidence double")
    out = mapping.extract(spark.read.parquet(f"{tmp_path}/cells"), found, mapping.schema_fields(spark))
    assert out._jdf.queryExecution().executedPlan().toString().count("FileScan parquet") == 1
    got = {(r["source_id"], r["record"]): (r["canonical"], r["completeness"]) for r in out.collect()}
    assert got == {("s", 1): ({"parcel_id": "P-0001"}, 0.5), ("s", 2): ({}, 0.0)}  # a record without mapped cells stays, a source without mapping doesn't
