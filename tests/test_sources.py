import json
import random
import zlib

from pyspark.sql import functions as F

from recordloom.plans import county
from recordloom.sources import api, formats, store, web

NOW = 1767225600


def pdf(lines, deflate):
    content = b"BT " + b" ".join(b"(" + x.replace("(", "\\(").replace(")", "\\)").encode() + b") Tj T*" for x in lines) + b" ET"
    body, extra = (zlib.compress(content), b"/Filter /FlateDecode ") if deflate else (content, b"")
    return (b"%PDF-1.4\n1 0 obj\n<< " + extra + b"/Length " + str(len(body)).encode() + b" >>\nstream\n" + body + b"\nendstream\nendobj\n").decode("latin-1")


TABLE = "<html><table><tr><th>Parcel<th>Amount Due<tr><td>12-001<td>$5&nbsp;<tr><td>12-002<td>$6</table>"
BLOCKS = "<!doctype html>" + "".join(f'<article class="rec"><span data-field="account-no">A-10{i}</span><b>Status:</b> open</article>' for i in range(3))
DOCS = [
    ("json", "", json.dumps({"meta": 1, "results": [{"a": "x", "owner": {"name": "Ann"}, "tags": ["p", "q"], "n": 3, "none": None}, {"a": "y"}]})),
    ("arcgis", "", json.dumps({"fields": [1], "features": [{"attributes": {"APN": "1-2-3"}}]})),
    ("bad", "application/json", '{"a": [1,]}'),
    ("csv", "text/csv", 'Name;Note\n"Lee; A";"say ""hi"""\nBo;x\n'),
    ("headless", "", "1,2\n3,4\n5,6\n"),
    ("table", "text/html", TABLE),
    ("blocks", "", BLOCKS),
    ("text", "", "A title\nParcel    Owner      Due\n1-001   Ann   $5\n1-002   Bo   $6\n1-003   Cy   $7\n"),
    ("pdf", "", pdf(["Parcel    Due", "1-001    $5", "1-002    $6", "1-003    (7)"], True)),
    ("none", "", None),
]


def test_every_format(spark):
    got = formats.parse_documents(spark.createDataFrame(DOCS, "source_id string, content_type string, body string")).toPandas()
    kinds = dict(zip(got.source_id, got.format))
    assert kinds == {"json": "json", "arcgis": "json", "bad": "json", "csv": "csv", "headless": "csv", "table": "html", "blocks": "html", "text": "text", "pdf": "pdf", "none": "unknown"}
    rec = lambda s, i: {r.label: r.value for r in got[(got.source_id == s) & (got.record == i)].itertuples()}
    assert rec("json", 0) == {"a": "x", "owner.name": "Ann", "tags": "p; q", "n": "3"}
    assert rec("arcgis", 0) == {"APN": "1-2-3"} and rec("csv", 0) == {"Name": "Lee; A", "Note": 'say "hi"'} and rec("headless", 0) == {"col_0": "1", "col_1": "2"}
    assert rec("table", 1) == {"Parcel": "12-002", "Amount Due": "$6"} and rec("blocks", 2) == {"account-no": "A-102", "Status": "open"}
    assert rec("text", 0) == {"Parcel": "1-001", "Owner": "Ann", "Due": "$5"} and rec("pdf", 2) == {"Parcel": "1-003", "Due": "(7)"}
    assert got[got.source_id == "bad"].error.iat[0] and got[got.source_id == "none"].error.iat[0] == "no records"


def test_fingerprints_follow_structure(spark):
    f = spark.createDataFrame([(["b", "a"],), (["a", "b"],), (["a", "c"],)], "labels array<string>").select(formats.fingerprint(F.lit("csv"), F.lit("t"), F.col("labels")).alias("f"))
    x = [r["f"] for r in f.collect()]
    assert x[0] == x[1] != x[2]


def test_robots_and_crawl(spark):
    urls = spark.createDataFrame([("http://h/a/x",), ("http://h/b",), ("http://h/a/ok/1",), ("http://g/a/x",)], "url string")
    rules = spark.createDataFrame([("h", "*", False, "/"), ("h", "me", False, "/a"), ("h", "me", True, "/a/ok"), ("g", "other", False, "/")], "host string, agent string, allow boolean, prefix string")
    assert {r["url"]: r["allowed"] for r in web.allowed(urls, rules, "me").collect()} == {"http://h/a/x": False, "http://h/b": True, "http://h/a/ok/1": True, "http://g/a/x": True}
    own = spark.createDataFrame([("h", "recordloom", False, "/r"), ("h", "*", False, "/"), ("g", "recordloom", False, ""), ("g", "*", False, "/")], "host string, agent string, allow boolean, prefix string")
    urls = spark.createDataFrame([("http://h/a",), ("http://h/r?q",), ("http://g/a",)], "url string")
    assert {r["url"]: r["allowed"] for r in web.allowed(urls, own, "recordloom/1.0").collect()} == {"http://h/a": True, "http://h/r?q": False, "http://g/a": False}
    links = web.links(spark.createDataFrame([("http://h/d/p", "<a href='/x'>1</a><a href=\"y?page=2#f\">2</a><a href='http://other/z'>3</a>")], "url string, html string"))
    assert {r["target"] for r in links.collect()} == {"http://h/x", "http://h/d/y?page=2"}


ROBOTS = """
# all of it
User-agent: Other
User-Agent: RecordLoom
Disallow: /private
Allow: /private/open
crawl-delay: 1.5x

User-agent: *
Disallow: /
Crawl-delay: soon
no colon here
"""


def test_robots_records(spark):
    texts = [ROBOTS, "User-agent: *\nDisallow:\nCrawl-delay: 3", "User-agent: recordloom\nDisallow:\n\nUser-agent: *\nDisallow: /x", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, body string").withColumn("r", web.robots(F.col("body"), "recordloom/1.0 (+mail)"))
    got = {r["i"]: r["r"] for r in df.collect()}
    assert [tuple(x) for x in got[0]["rules"]] == [("/private", False), ("/private/open", True)] and got[0]["delay"] == 1.5
    assert got[1]["rules"] == [] and got[1]["delay"] == 3.0 and [tuple(x) for x in got[2]["rules"]] == [("/x", False)] and got[3]["rules"] == []
    may = lambda i, p: df.where(F.col("i") == i).select(web.permitted(F.col("r.rules"), F.lit(p))).first()[0]
    assert [may(0, p) for p in ("/", "/private/a", "/private/open/x")] == [True, False, True] and not may(2, "/x?y") and may(4, "/")


def walk(seed, pages, edges, depth, most, refused):
    """A queue, one address at a time."""
    queue, queued, bodies, out, fetched, at = [(seed, 0)], {seed}, set(), [], 0, 0
    while at < len(queue) and fetched < most:
        url, d = queue[at]
        at += 1
        if refused(url):
            out.append((seed, url, d, at, "robots"))
        elif url not in pages:
            out.append((seed, url, d, at, "failed"))
        elif pages[url][0] in bodies:
            out.append((seed, url, d, at, "duplicate"))
        else:
            bodies.add(pages[url][0])
            fetched += 1
            out.append((seed, url, d, at, "fetched"))
            if d < depth and pages[url][1]:
                for t in edges.get(url, []):
                    if len(queue) < 8 * most and t not in queued and t.split("/")[2] == seed.split("/")[2]:
                        queued.add(t)
                        queue.append((t, d + 1))
    return out


def test_crawls_walk_a_queue(spark):
    r = random.Random(11)
    urls = [f"http://{h}/{'no/' if i % 7 == 3 else ''}{i}" for h in ("h", "g") for i in range(40)]
    pages = {u: (str(r.randint(0, 30)), r.random() < 0.9) for u in urls if r.random() < 0.9}
    edges = {u: r.sample(urls, r.randint(0, 9)) for u in urls}
    rows = lambda x, schema: spark.createDataFrame(x, schema)
    p = rows([(u, b, f) for u, (b, f) in pages.items()], "url string, body_hash string, follow boolean")
    e = rows([(u, t, i) for u, ts in edges.items() for i, t in enumerate(ts)], "url string, target string, place int")
    seeds = ["http://h/0", "http://g/5", "http://h/10"]
    rules = rows([("h", [("/no", False)]), ("x", [])], f"host string, rules {web.RULES}")
    for depth, most in ((0, 5), (2, 4), (6, 3), (6, 50)):
        got = web.crawl(rows([(s,) for s in seeds], "url string"), p, e, depth, most, rules=rules).collect()
        want = [x for s in seeds for x in walk(s, pages, edges, depth, most, lambda u: u.startswith("http://h/no"))]
        assert sorted(map(tuple, got)) == sorted(want)


def test_paging(spark, tmp_path):
    for o in (0, 2, 4):
        (tmp_path / f"p{o}.json").write_text(json.dumps([{"id": o + i} for i in range(min(2, 5 - o))]))
    spark.dataSource.register(api.PagedJson)
    got = spark.read.format("paged_json").option("url", f"file://{tmp_path}/p{{offset}}.json").option("page_size", 2).option("max_rows", 6).load()
    assert sorted(r["value"] for r in got.collect()) == ["0", "1", "2", "3", "4"]
    assert api.page_url("http://h/resource/x?$where=a b", 0, 10, "date").endswith("?$where=a%20b&$limit=10&$offset=0&$order=date%20DESC")
    ends = lambda n, cap: [(r["n"], r["stop"]) for r in web.paged(spark.range(n), 10, cap).orderBy("page").collect()]
    assert ends(25, 50) == [(10, "next"), (10, "next"), (5, "short")] and ends(80, 30) == [(10, "next"), (10, "next"), (10, "truncated")]


def test_log_and_seed(spark, tmp_path):
    path = tmp_path / "events.jsonl"
    path.write_text('{"id": "1", "recorded_at": "b", "amount": 2}\n{"id": "1", "recorded_at": "a"}\nnot json\n{"id": "2", "recorded_at": "c"}\n')
    good, bad = store.read_log(spark, str(path))
    assert {(r["id"], r["recorded_at"]) for r in good.collect()} == {("1", "a"), ("2", "c")} and bad.count() == 1
    seed = spark.createDataFrame([("a", "A", "http://x"), ("b", "B", "ftp://x"), ("c", "C", "https://y"), (None, "D", "http://z")], "id string, name string, url string")
    plan = store.plan_seed(spark.createDataFrame([("a",)], "id string"), seed)
    assert [r["plan"] for r in plan.orderBy("name").collect()] == ["skip", "reject", "create", "reject"]


def test_county_from_events(spark):
    event = lambda i, key, kind, day, source, **d: (i, key, kind, day, "r", source, kind, "2024", 10.0, 0.5, d)
    rows = [
        event("1", "elm|p:1", "tax_delinquency", "2024-01-01", "s1", address="12 Elm St", owner="Ann", mailing_address="12 Elm Street"),
        event("2", "elm|a:12 elm st", "foreclosure_filed", "2024-02-01", "s2", address="12 Elm Street", owner="Bo"),
        event("3", "elm|p:9", "permit_issued", "2024-03-01", "s1", address="40 Oak Ave"),
        event("4", "elm|p:7", "code_violation", "2024-03-01", "s3", owner="Cy"),
    ]
    events = spark.createDataFrame(rows, "id string, property_key string, kind string, event_date string, recorded_at string, source_id string, source_label string, as_of string, amount double, confidence double, details map<string,string>")
    fields = spark.createDataFrame([("owner", "name", ""), ("address", "address", ""), ("mailing_address", "address", "")], "field string, kind string, authority string")
    trust = spark.createDataFrame([("s1", "owner", 0.9)], "source_id string, field string, confidence double")
    got = {tuple(r["merged_keys"]): r for r in county.compile_county(county.in_county(events, "elm"), fields, trust, NOW).collect()}
    merged = got[("elm|a:12 elm st", "elm|p:1")]
    assert merged["state"] == "FORECLOSURE_FILED" and merged["fields"]["owner"] == "Ann" and merged["conflicts"] == 1 and merged["occupancy"] == "owner_occupied" and merged["due"] == 10.0
    assert len(got) == 3 and not got[("elm|p:7",)]["locatable"]


def test_bodies_of_a_large_group_are_cut(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from recordloom.plans import queries_documents
    from recordloom.sources import formats

    monkeypatch.setattr(formats, "MAX_BYTES", 1 << 21)
    n = 60_000  # in one group: 3 MB as one body
    spark.range(n).select(F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.lit(7).cast("long").alias("user_id"), F.lit(1.5).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    spark.range(n).select(F.col("id").alias("c_custkey"), F.lit("C").alias("c_name"), F.lit(1.5).alias("c_acctbal"), F.lit("AUTO").alias("c_mktsegment"), F.lit(1).alias("c_nationkey")).write.parquet(f"{tmp_path}/customer.parquet")
    got = {(r["format"], r["label"]): (r["cells"], r["documents"]) for r in queries_documents.parsed_bodies(spark, str(tmp_path)).collect()}
    assert got["json", "event_id"] == got["json", "value"] == got["json", "who.user_id"] == (n, 3)
    assert {f for f, _ in got} == {"json", "text"} and got["text", None][1] == 3


def test_tag_soup():
    from recordloom.sources import tagsoup

    rows = tagsoup.parse("<table><tr><td>a<td>b<tr><td>c<td>d</table>").find("tr")
    assert [[c.text() for c in r.elements()] for r in rows] == [["a", "b"], ["c", "d"]]
    stray = tagsoup.parse("<div>a</span></div><p>b</p>")
    assert len(stray.find("div")) == 1 and stray.text() == "a b"
    cell = tagsoup.parse('<td class="Owner-Name main" data-field=taxpayer>Smith &amp; Sons&#44; LLC</td>').find("td")[0]
    assert cell.signature() == "td.main.owner-name" and cell.text() == "Smith & Sons, LLC" and cell.attributes["data-field"] == "taxpayer"
    raw = tagsoup.parse('<script>if (a < b) { render("<td>"); }</script><!-- <td>x</td> --><br><img src="a.png"><p>visible</p>')
    assert not raw.find("td") and len(raw.find("p")) == 1 and raw.text() == "visible"
    div = tagsoup.parse("<div><span>Owner:</span> Jane Smith</div>").find("div")[0]
    assert div.own_text() == "Jane Smith" and div.text() == "Owner: Jane Smith"
    assert len(tagsoup.parse("<div>" * 50_000 + "deep").find("div")) == 50_000


def test_nested_tables_and_repeated_blocks():
    from recordloom.sources import tagsoup

    nested = "<table><tr><th>Parcel<th>Due</tr><tr><td>12-1<td>$5 <table><tr><td>x<td>y</table></tr><tr><td>12-2<td>$6</tr></table>"
    assert tagsoup.records(nested) == [[("Parcel", "12-1"), ("Due", "$5 x y")], [("Parcel", "12-2"), ("Due", "$6")]]
    bare = "<table><tr><td>1<td>2</tr><tr><td>3<td></tr></table>"
    assert tagsoup.records(bare) == [[("col_1", "1"), ("col_2", "2")], [("col_1", "3")]]
    block = lambda i: f'<li class="b a"><dl><dt>Case<dd>CE-{i}</dl><p><b>Owner:</b> Ann {i}</p><span class="value status">open</span><i>Parcel: 04-11{i}</i></li>'
    got = tagsoup.records("<ul>" + "".join(map(block, range(3))) + '<li class="other">x</li></ul>')
    assert got[1] == [("Case", "CE-1"), ("Owner", "Ann 1"), ("status", "open"), ("Parcel", "04-111")] and len(got) == 3


def test_binary_bodies_and_corrupt_streams(spark):
    good = pdf(["Parcel    Due", "1-001    $5", "1-002    $6", "1-003    (7)"], True).encode("latin-1")
    broken = b"%PDF-1.4\n<< /Filter /FlateDecode >>\nstream\nnot deflated\nendstream\n" + good
    deep = b"[" * 80 + b"{}" + b"]" * 80
    rows = [("pdf", "", good), ("broken", "", broken), ("json", "", b'[{"a": "\xc3\xa9", "b": 1}]'), ("deep", "", deep), ("none", "", None)]
    got = formats.parse_documents(spark.createDataFrame(rows, "source_id string, content_type string, body binary")).toPandas()
    value = lambda s, label: list(got[(got.source_id == s) & (got.label == label)].value)
    assert value("pdf", "Due") == ["$5", "$6", "(7)"] == value("broken", "Due") and value("json", "a") == ["é"]
    assert "deep" in got[got.source_id == "deep"].error.iat[0] and got[got.source_id == "none"].error.iat[0] == "no records"


def test_cells_of_a_batch_come_in_bounded_frames():
    import pandas as pd

    from recordloom.sources import formats

    bodies = [f'{{"rows": [{", ".join(f"""{{"a": {i}, "b": {j}}}""" for j in range(300))}]}}' for i in range(90)]
    batch = pd.DataFrame({"source_id": [str(i) for i in range(90)], "format": "json", "body": bodies})
    frames = list(formats.cell_frames(iter([batch.head(60), batch.tail(30)])))
    assert sum(map(len, frames)) == 90 * 300 * 2 and max(map(len, frames)) == formats.CELLS_AT_ONCE
    assert pd.concat(frames).groupby("source_id").size().eq(600).all()
