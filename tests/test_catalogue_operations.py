import datetime as dt

import pytest
from pyspark.sql import functions as F

from recordloom.functions import names
from recordloom.operators import classify, compile as comp, mapping, runs, valuation, weak_labels
from recordloom.sources import web


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(f(F.col("v"))).collect()]


def test_owners_with_the_same_words(spark):
    rows = spark.createDataFrame([("SMITH, JOHN A", "John A Smith"), ("Jon Smith", "John Smith"), ("Ann Lee", "Bob Ray"), ("", ""), (None, "x"), ("...", "...")], "a string, b string")
    assert [r[0] for r in rows.select(names.same_owner(F.col("a"), F.col("b"))).collect()] == [True, True, False, False, False, False]


def test_stamps(spark):
    assert column(spark, [0, 86399, -1, 951868800], names.iso_from_unix, "long") == ["1970-01-01T00:00:00Z", "1970-01-01T23:59:59Z", "1969-12-31T23:59:59Z", "2000-03-01T00:00:00Z"]
    got = column(spark, ["1970-01-02", "2023-02-31", "1899-01-01", "2024-13-01", "2024-01-02T03", "soon", None, "2024-02-29T23:59:59Z"], names.epoch_seconds)
    utc = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp())
    assert got == [86400, utc(2023, 3, 3), None, None, utc(2024, 1, 2, 3), None, None, utc(2024, 2, 29, 23, 59, 59)]


def test_shown_values(spark):
    assert column(spark, [1234567.5, None], lambda c: names.shown("money", c), "double") == ["$1,234,568", None]
    assert column(spark, [0.25, 2.0], lambda c: names.shown("ratio", c), "double") == ["0.25x", "2x"]
    assert column(spark, [30.0, 1.0], lambda c: names.shown("days", c), "double") == ["30 days", "1 day"]
    assert column(spark, [3.0, None, 1.0], lambda c: names.explained("violations", "count", "gte", 2, c), "double") == ["\u2713 violations 3 (needs at least 2)", "\u2717 violations is not measured for this property (needs at least 2)", "\u2717 violations 1 (needs at least 2)"]


def test_paths_and_links(spark):
    assert column(spark, ["/a/b/../c", "/../x", "/a/./b/", "", "/a//b", "/a/b/.."], web.normalized) == ["/a/c", "/x", "/a/b/", "/", "/a/b", "/a/"]
    base = F.lit("https://Ex.org/list/page?x=1")
    got = column(spark, ["next?p=2", "../up.html#top", "/root/./a", "//cdn.org/x", "mailto:a@b.org", "#here", "?p=3", "http://other.org/z#q", "  spaced "], lambda c: web.resolved(base, c))
    assert got == ["https://Ex.org/list/next?p=2", "https://Ex.org/up.html", "https://Ex.org/root/a", "https://cdn.org/x", None, None, "https://Ex.org/list/page?p=3", "http://other.org/z", "https://Ex.org/list/spaced"]
    page = """<a href="/b">Record</a><A class='x' HREF='/p2'>2</a><a name=x>none</a><a href="/b#again"><b>again</b></a><a rel="next" href="/p3">more</a><a href="/c">Next page</a><a href="javascript:go()">go</a>"""
    rows = spark.createDataFrame([(1, "https://e.org/", page), (2, "https://e.org/", ""), (3, "https://e.org/", None)], "page_id long, url string, html string")
    want = ["https://e.org/p2", "https://e.org/p3", "https://e.org/c", "https://e.org/b"]
    assert [r["target"] for r in web.ordered_links(rows, 10).orderBy("place").collect()] == want
    assert [r["target"] for r in web.ordered_links(rows, 2).orderBy("place").collect()] == want[:2]


def test_expanded_urls_say_what_is_missing(spark):
    keys = spark.createDataFrame([("elm_county|p:12", "5 N Oak St", 1), ("elm_county|p:1'2", "7 Oak Avenue", 2), ("elm_county|a:x", None, 3)], "property_key string, address string, seq long")
    sources = spark.createDataFrame([("a", "Elm County", "u?p in ({parcels})"), ("b", "Elm County", "u?s={streets}&n={numbers}"), ("c", "Ash", "u?p={parcels}"), ("d", "Ash", "u")], "source_id string, jurisdiction string, url string")
    got = {r["source_id"]: (r["url"], r["error"]) for r in runs.expanded(sources, keys).collect()}
    assert got == {"a": ("u?p in ('12')", None), "b": ("u?s='OAK'&n='5','7'", None), "c": (None, "nothing to target yet"), "d": ("u", None)}


def test_a_county_without_sources_or_runs_is_not_complete(spark):
    sources = spark.createDataFrame([("a", "s1"), ("b", "s2"), ("c", "s3")], "county string, source_id string")
    done = spark.createDataFrame([("s1", 1, True), ("s1", 2, False), ("s2", 1, True)], "source_id string, seq long, truncated boolean")
    sizes = spark.createDataFrame([("a", 5, 2), ("b", 5, 2), ("c", 5, 2), ("d", 5, 2)], "county string, events long, properties long")
    assert {r["county"]: r["complete"] for r in runs.data_complete(sources, done, sizes).collect()} == {"a": True, "b": False, "c": False, "d": False}


def test_repairs_are_decided_once(spark):
    repairs = spark.createDataFrame([(1, "s", "pending", "m1"), (2, "s", "pending", "m2"), (3, "t", "rejected", "m3"), (4, "u", "pending", "")], "id long, source_id string, resolution string, mapping string")
    decisions = spark.createDataFrame([(1, True), (2, True), (3, True), (4, True)], "id long, approved boolean")
    got = runs.resolved_repairs(repairs, decisions)
    assert {r["id"]: (r["resolution"], r["error"]) for r in got.collect()} == {1: ("approved", None), 2: ("approved", None), 3: ("rejected", "already resolved (rejected)"), 4: ("approved", None)}
    states = spark.createDataFrame([("s", "old", 7), ("u", "kept", 3)], "source_id string, mapping string, good_runs long")
    assert {tuple(r) for r in runs.repaired_states(states, got).collect()} == {("s", "m2", 0), ("u", "kept", 3)}


def test_proposed_repairs_can_be_decided(spark):
    from recordloom.operators import operations

    rows = [("a", 0.9, 0.8, 1.0), ("b", 0.6, 0.5, 1.0), ("c", 1.0, 0.0, 0.0), ("d", 0.9, 0.7, 0.0), ("e", 1.0, 0.69, 1.0), ("f", 0.5, 2.0, 1.0)]
    p = operations.repairs(spark.createDataFrame(rows, "source_id string, mapping_confidence double, rate double, baseline double"))
    got = {r["source_id"]: (round(r["confidence"], 6), r["resolution"]) for r in p.collect()}
    assert got == {"a": (0.85, "auto"), "b": (0.55, "pending"), "c": (0.5, "pending"), "d": (0.8, "auto"), "e": (0.845, "pending"), "f": (0.75, "auto")}
    queued = p.selectExpr("source_id as id", "source_id", "resolution", "'m' as mapping")
    decided = runs.resolved_repairs(queued, spark.createDataFrame([("a", True), ("b", True), ("c", False)], "id string, approved boolean"))
    assert {r["id"]: (r["resolution"], r["applied"]) for r in decided.collect() if r["id"] in "abc"} == {"a": ("auto", False), "b": ("approved", True), "c": ("rejected", False)}


def test_validators_vote_and_veto(spark):
    cols = spark.createDataFrame([(1, ["a@b.org", "c@d.org"]), (2, ["a@b.org"]), (3, ["-", "-"]), (4, ["$5.00", "7"]), (5, None)], "example long, values array<string>")
    fields = spark.createDataFrame([("mail", "email"), ("due", "money"), ("size", "number"), ("note", "text")], "field string, kind string")
    assert {tuple(r) for r in weak_labels.unique_votes(cols, fields).collect()} == {(1, "validator_unique", "mail"), (4, "validator_unique", "due")}
    assert {tuple(r) for r in weak_labels.veto_votes(cols, fields).collect()} == {(3, "validator_veto", "none")}


def test_feature_bag_keeps_stop_words_of_labels_only(spark):
    docs = spark.createDataFrame([(1, "csv", ["Date of Sale", "x", "2024"], "The Sale", ["Tax of 2024"], "the tax bill tax", "https://elm.gov/tax")], "doc long, format string, labels array<string>, title string, headings array<string>, text string, url string")
    got = {r["token"]: r["n"] for r in classify.features(docs).collect()}
    assert got == {"fmt:csv": 1, "label:date": 1, "label:of": 1, "label:sale": 1, "title:sale": 1, "h:tax": 1, "tax": 2, "bill": 1, "url:elm": 1, "url:tax": 1}


def test_mapping_faults(spark):
    m = spark.createDataFrame([("s", "a", "l", -1, 0.5), ("s", "a", "k", -1, 0.5), ("s", "b", "l", -1, 1.5), ("t", "a", "l", 0, 1.0), ("t", "b", "l", 1, 0.0)], "source_id string, name string, label string, part int, confidence double")
    assert {tuple(r) for r in mapping.mapping_faults(m).collect()} == {("s", "score", "b"), ("s", "field twice", "a"), ("s", "part twice", "l|-1")}


def test_trusted_sources_and_authorities_decide(spark):
    row = lambda i, src, label, value, conf, as_of="": ("p", i, i, i, src, label, as_of, conf, {"owner": value})
    events = spark.createDataFrame([row("1", "a", "x", "Ann", 0.9), row("2", "b", "x", "Bob", 0.2)], "property_key string, event_date string, recorded_at string, id string, source_id string, source_label string, as_of string, confidence double, details map<string,string>")
    fields = spark.createDataFrame([("owner", "name", "")], "field string, kind string, authority string")
    value = lambda trust: comp.resolve(comp.observations(events, fields, trust)).first()["value"]
    none = spark.createDataFrame([], "source_id string, field string, confidence double")
    assert value(none) == "Ann" and value(spark.createDataFrame([("b", "owner", 0.95)], none.schema)) == "Bob"


def test_use_and_ranges(spark):
    assert column(spark, ["Condo unit", "Apartment land", "Industrial", "LAND", "", None], valuation.use_group) == ["residential", "apartments", "industrial", "vacant", "other", "other"]
    e = spark.createDataFrame([("VA", 100.0), ("CT", 50.0)], "state string, estimate double")
    got = {r["state"]: (r["estimate"], r["low"], r["high"]) for r in valuation.ranged(e, spark.createDataFrame([("VA", 0.25)], "state string, mdape double")).collect()}
    assert got == {"VA": (100.0, 75.0, 125.0), "CT": (None, None, None)}


def test_buckets_share_the_first_ones(spark):
    rows = [("g", f"k{i}", d, s) for i, (d, s) in enumerate([("n", "st"), ("", "st"), ("s", ""), ("n", ""), ("", "ave"), ("s", "ave"), ("n", "ave"), ("", "st"), ("n", "st")])]
    got = {r["property_key"]: r["bucket"] for r in comp.buckets(spark.createDataFrame(rows, "group_key string, property_key string, directional string, suffix string")).collect()}
    held, want = [], {}
    for _, k, d, s in rows:  # first fit, key by key
        at = next((i for i, (x, y) in enumerate(held) if (not x or not d or x == d) and (not y or not s or y == s)), None)
        if at is None:
            held.append((d, s))
            at = len(held) - 1
        else:
            held[at] = (held[at][0] or d, held[at][1] or s)
        want[k] = at
    assert got == want


@pytest.mark.parametrize("alphas", [(1.0,), (0.5, 1.0)])
def test_sweep_takes_the_first_best(spark, alphas):
    rows = [(i, "a" if i % 2 else "b", ("red rust " if i % 2 else "blue sky ") * 3) for i in range(10)]
    d = spark.createDataFrame(rows, "doc long, class string, text string")
    bag = classify.bags(d, "doc", F.col("text"), "class")
    labels = d.select("doc", "class")
    got = classify.sweep(labels, bag, *classify.train(bag, labels), alphas).collect()
    assert [r["alpha"] for r in got if r["best"]] == [alphas[0]] and all(r["accuracy"] == 1.0 and r["passes"] for r in got)


def test_numbers_in_c_forms(spark):
    from recordloom.functions import values

    rows = ["0x10", "-0X1.8p1", "0x", "0x.", "1e5", "inf", "nan", "1d", "0x1G", ".5", "0x.8"]
    assert column(spark, rows, lambda c: values.validate("number", c)) == [True, True, False, False, True, False, False, False, False, True, True]
    assert column(spark, ["0x10", "0x11", "-0x1.8p1"], lambda c: values.validate("number", c, -3.0, 16.0)) == [True, False, True]


def test_profiles_and_their_next_question(spark):
    from recordloom.operators import profiles

    empty = spark.createDataFrame([], "id long, " + profiles.PROFILE)
    update = "id long, " + profiles.PROFILE + ", any_event_age boolean"
    none = (None,) * 8
    first = profiles.updated(empty, spark.createDataFrame([(1, None, "elm_va", *none[2:], None), (2, *none, None)], update), "id")
    ask = lambda p: {r["id"]: r["q"] for r in p.select("id", profiles.next_field().alias("q")).collect()}
    assert ask(first) == {1: "min_owed", 2: "county"}
    then = profiles.updated(first, spark.createDataFrame([(1, None, None, 5.0, 0.0, "any", 30, None, None, None)], update), "id")
    assert ask(then)[1] == "require_approval" and then.where("id = 1").first()["markets"] == ["elm_va"]
    freed = profiles.updated(then, spark.createDataFrame([(1, ["a", "b"], None, None, None, None, None, None, True, True)], update), "id", defaults=True)
    got = {r["id"]: r for r in freed.collect()}
    assert ask(freed) == {1: None, 2: "county"} and got[1]["county"] == "a" and got[1]["max_days"] is None and got[1]["min_owed"] == 5.0 and got[2]["evidence"] == "multiple_sources"


def test_messages_and_work_are_known_again(spark):
    import hashlib

    from recordloom.operators import profiles

    m = spark.createDataFrame([("h", 2, "late"), ("h", 1, "first"), ("g", 3, "x")], "handle string, seq long, text string")
    assert {r["text"] for r in profiles.inbound(m).collect()} == {"first", "x"}
    w = spark.createDataFrame([("elm_va", "5:t", 3, None, "", "ann"), ("elm_va", "5:t", 3, "2", "c", None)], "c string, s string, a int, r string, v string, n string")
    got = [r[0] for r in w.select(profiles.workflow_id(*[F.col(c) for c in "csarvn"])).collect()]
    assert got == ["county-elm_va-" + hashlib.sha256(x.encode()).hexdigest()[:20] for x in ("elm_va:5:t:3:notify:ann", "elm_va:5:t:3:2:coverage:c")]


def test_two_ages_and_gaps(spark):
    from recordloom.operators import operations

    now = 1_000_000
    runs_ = [("a", 1, True, now - 7200, now - 3600 * 72), ("b", 1, False, now, None), ("c", 1, True, now, None), ("d", 1, True, now - 3600, now + 3600), ("a", 0, False, 0, None)]
    got = operations.record_ages(spark.createDataFrame([(x,) for x in "abcde"], "source_id string"), spark.createDataFrame(runs_, "source_id string, seq long, ok boolean, finished_epoch long, newest_epoch long"), now)
    assert {r["source_id"]: (r["fetch_age"], r["record_age"], r["verdict"]) for r in got.collect()} == {"a": (2.0, 72.0, "review"), "b": (0.0, None, "failed"), "c": (0.0, None, "unchanged"), "d": (1.0, -1.0, "ok"), "e": (None, None, "pending")}
    asked = spark.createDataFrame([("h", 0, 1), ("h", 0, 2), ("h", 5, 3), ("h", 5, 4), ("g", 0, 5)], "host string, at_s long, id long")
    waits = {r["id"]: (r["allowed"], r["wait_s"]) for r in operations.host_budget(asked, per_window=3, gap_s=2.0).collect()}
    assert waits == {1: (True, 0.0), 2: (True, 2.0), 3: (True, 0.0), 4: (False, None), 5: (True, 0.0)}


def test_store_readers(spark, tmp_path):
    import json

    from recordloom.sources import store

    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a.txt").write_bytes(b"abc")
    (tmp_path / "files" / "b.txt").write_bytes(b"x" * 20)
    assert {(r["path"][-5:], r["error"]) for r in store.scan_files(spark, str(tmp_path / "files"), 10).collect()} == {("a.txt", None), ("b.txt", "body over 10 bytes")}
    key = {"sources": [{"id": "s", "classification": "deed", "fields": {"owner": ["Owner", "Name"], "due": "Due"}}, {"id": "t", "classification": ["a", "b"]}, {"id": "t", "classification": "a"}, {"classification": "a"}, {"id": "u"}]}
    (tmp_path / "golden.json").write_text(json.dumps(key, indent=1))
    rows = [(r["source_id"], r["classifications"], r["fault"]) for r in store.golden(spark, str(tmp_path / "golden.json")).collect()]
    assert sorted(rows, key=str) == sorted([("s", ["deed"], None), ("t", ["a", "b"], "repeated id"), ("t", ["a"], "repeated id"), ("", ["a"], "no id"), ("u", None, "no classification")], key=str)
    assert store.golden(spark, str(tmp_path / "golden.json")).where("source_id = 's'").first()["fields"] == {"owner": ["Owner", "Name"], "due": ["Due"]}
    c = spark.createDataFrame([("a.org", "due", None, ["1", "2"], "amount", "lexicon")], store.CORPUS)
    store.append_corpus(c, str(tmp_path / "corpus"))
    store.append_corpus(c, str(tmp_path / "corpus"))
    assert store.read_corpus(spark, str(tmp_path / "corpus")).count() == 2
    bodies = spark.createDataFrame([("s", "body"), ("t", "body"), ("u", "other"), ("v", None)], "source_id string, body string")
    store.keep_bodies(bodies, str(tmp_path / "bodies"))
    store.keep_bodies(bodies.limit(1), str(tmp_path / "bodies"))
    want = bodies.where("source_id = 's'").select(F.sha2("body", 256).alias("body_hash"))
    assert [bytes(r["body"]) for r in store.kept_bodies(spark, str(tmp_path / "bodies"), want).collect()] == [b"body"]


def test_snapshots_pages_and_models(spark, tmp_path):
    import json

    from recordloom.sources import store

    cells = spark.createDataFrame([("s", 0, i, f"l{i}", f"v{i}") for i in range(14)] + [("s", 1, 0, "l0", "w")], "source_id string, record long, label_ord int, label string, value string")
    runs_ = spark.createDataFrame([("s", "r1", "t", "csv", "csv[2]", "deed", 0.9)], "source_id string, run_id string, at string, format string, container string, label string, confidence double")
    rates = spark.createDataFrame([("s", "owner", 0.5)], "source_id string, field string, rate double")
    got = json.loads(store.snapshots(runs_, cells, rates).first()["snapshot"])
    assert len(got["labels"]) == 14 and got["raw_sample"][11] == {"label": "l11", "value": "v11"} and len(got["raw_sample"]) == 12 and got["field_rates"] == {"owner": 0.5} and got["classification"] == {"label": "deed", "confidence": 0.9}
    pages = spark.createDataFrame([("s", 0, 0, "a", "1"), ("s", 1, 0, "a", "2"), ("s", 2, 0, "b", "3"), ("s", 3, 0, "a", "4"), ("t", 0, 0, "b", "5")], "source_id string, page int, record long, label string, value string")
    assert {r["value"] for r in store.same_pages(pages).collect()} == {"1", "2", "5"}
    hits = spark.createDataFrame([("a", "x", 2), ("a", "y", 1), ("b", "x", 4)], "class string, token string, hits long")
    totals = spark.createDataFrame([("a", 2, 3), ("b", 1, 4)], "class string, docs long, tokens long")
    store.save_model(hits, totals, str(tmp_path / "model"))
    assert store.load_model(spark, str(tmp_path / "model"))[0].count() == 3
    store.save_model(hits.where("token = 'x'"), totals, str(tmp_path / "model"))
    with pytest.raises(ValueError, match="add up"):
        store.load_model(spark, str(tmp_path / "model"))
