import json

import pytest

from recordloom.sources import api


@pytest.fixture(scope="module")
def session(spark):
    spark.dataSource.register(api.PagedJson)
    return spark


def put(folder, offset, ids, **more):
    (folder / f"p{offset}.json").write_text(json.dumps([{"id": i, **more} for i in ids]))


def load(session, folder, **options):
    r = session.read.format("paged_json").option("url", f"file://{folder}/p{{offset}}.json").option("page_size", 2)
    for k, v in options.items():
        r = r.option(k, v)
    return r.load()


def kept(session, folder, most=20):
    rows, report = api.kept_pages(load(session, folder, max_rows=most), 2, most)
    return sorted(r["value"] for r in rows.where("label = 'id'").collect()), tuple(report.first())


def test_pages_that_a_sequential_reader_keeps(session, tmp_path):
    for o, ids in ((0, "ab"), (2, "cd"), (4, "e")):
        put(tmp_path, o, ids)
    assert kept(session, tmp_path) == (list("abcde"), (3, 5, False, "short", None))
    put(tmp_path, 4, "ef")
    assert kept(session, tmp_path) == (list("abcdef"), (3, 6, False, "failed", None))  # the page after it isn't there
    put(tmp_path, 6, [])
    assert kept(session, tmp_path) == (list("abcdef"), (4, 6, False, "short", None))
    put(tmp_path, 8, "xy")  # never asked for by a sequential reader
    assert kept(session, tmp_path)[0] == list("abcdef")
    (tmp_path / "p2.json").write_text("{not json")
    assert kept(session, tmp_path) == (["a", "b"], (1, 2, False, "failed", None))
    put(tmp_path, 2, "cd", more=1)
    assert kept(session, tmp_path) == (["a", "b"], (1, 2, False, "drift", None))
    put(tmp_path, 2, "cd")
    assert kept(session, tmp_path, most=4) == (list("abcd"), (2, 4, True, "cap", None))
    assert kept(session, tmp_path, most=3) == (list("abc"), (2, 3, True, "cap", None))


def test_a_first_page_that_fails_says_why(session, tmp_path):
    got, report = kept(session, tmp_path)
    assert got == [] and report[:4] == (0, 0, False, "failed") and report[4]


def test_several_sources(session):
    rows = [("s", 0, 0, 0, "a", "1", None), ("s", 0, 1, 0, "a", "2", None), ("s", 1, 2, 0, "b", "3", None), ("t", 0, None, None, None, None, "down")]
    cells = session.createDataFrame(rows, "source string, " + api.SCHEMA)
    keep, report = api.kept_pages(cells, 2, 10, by="source")
    assert sorted(r["value"] for r in keep.collect()) == ["1", "2"]
    assert {tuple(r) for r in report.collect()} == {("s", 1, 2, False, "drift", None), ("t", 0, 0, False, "failed", "down")}


class Poll:
    """One stream over a folder of pages, started and stopped again and again."""

    def __init__(self, session, folder, **options):
        self.session, self.folder, self.options = session, folder, options
        self.out, self.checkpoint = f"{folder}/out", f"{folder}/checkpoint"

    def __call__(self):
        r = self.session.readStream.format("paged_json").option("url", f"file://{self.folder}/p{{offset}}.json").option("page_size", 2)
        for k, v in self.options.items():
            r = r.option(k, v)
        q = r.load().writeStream.format("parquet").option("path", self.out).option("checkpointLocation", self.checkpoint).trigger(availableNow=True).start()
        q.awaitTermination()
        return [r["value"] for r in self.session.read.parquet(self.out).where("label = 'id'").orderBy("record").collect()]


def test_a_stream_goes_on_where_it_stopped(session, tmp_path):
    put(tmp_path, 0, "ab")
    put(tmp_path, 2, "c")
    poll = Poll(session, tmp_path)
    assert poll() == list("abc")
    assert poll() == list("abc")  # nothing new, nothing repeated
    put(tmp_path, 2, "cd")
    put(tmp_path, 4, "e")
    assert poll() == list("abcde")
    put(tmp_path, 4, "Xf")  # what was delivered has changed: that page comes again
    put(tmp_path, 6, [])
    assert sorted(poll()) == sorted("abcdeXf")


def test_pages_before_a_failing_one_are_kept(session, tmp_path):
    put(tmp_path, 0, "ab")
    (tmp_path / "p2.json").write_text("<html>down</html>")
    poll = Poll(session, tmp_path, progress=f"{tmp_path}/progress")
    assert poll() == ["a", "b"]
    assert poll() == ["a", "b"]
    put(tmp_path, 2, "cd")
    put(tmp_path, 4, "e")
    assert poll() == list("abcde")
    (tmp_path / "p0.json").write_text("gone")  # delivered long ago: not asked for again
    put(tmp_path, 4, "ef")
    put(tmp_path, 6, [])
    assert poll() == list("abcdef")


def test_without_progress_a_first_walk_has_to_be_whole(session, tmp_path):
    put(tmp_path, 0, "ab")
    (tmp_path / "p2.json").write_text("down")
    with pytest.raises(Exception, match="Expecting value"):
        Poll(session, tmp_path)()
    put(tmp_path, 2, "c")
    assert Poll(session, tmp_path)() == list("abc")


def reader(folder, **options):
    r = api.PagedStreamReader({"url": f"file://{folder}/p{{offset}}.json", "page_size": "2", **options})
    r.initialOffset()
    return r


def test_drift_stops_or_heals(tmp_path):
    put(tmp_path, 0, "ab")
    put(tmp_path, 2, "cd", more=1)
    r = reader(tmp_path)
    assert (r.latestOffset()["position"], r.at["state"]) == (2, "drift") and r.latestOffset()["position"] == 2
    assert reader(tmp_path, on_drift="heal").latestOffset()["position"] == 4
    put(tmp_path, 2, "cd")
    assert (r.latestOffset()["position"], r.at["state"]) == (4, "open")


def test_polls_are_bounded_and_truncated(tmp_path):
    for o in range(0, 10, 2):
        put(tmp_path, o, [o, o + 1])
    r = reader(tmp_path, pages_per_poll="2", max_rows="7")
    seen = [r.latestOffset() for _ in range(3)]
    assert [s["position"] for s in seen] == [4, 7, 7] and [s["state"] for s in seen] == ["open", "truncated", "truncated"]
    rows = [x for a, b in zip([r.START, *seen], seen) for p in r.partitions(a, b) for x in r.read(p)]
    assert [x[1] for x in rows] == list(range(7))


def test_a_shrunken_page_isnt_passed_over(tmp_path):
    put(tmp_path, 0, "ab")
    r = reader(tmp_path)
    start, end = dict(r.START), r.latestOffset()
    put(tmp_path, 0, "a")
    with pytest.raises(ValueError, match="fewer"):
        [list(r.read(p)) for p in r.partitions(start, end)]


def joined_by_hand(pages, limit, cap):
    held, n, kind = [], 0, ""
    for allowed, status, error, ctype, body in pages:
        wrong = "host request budget spent; try again shortly" if not allowed else error if error else f"http status {status}" if status not in (None, 200) else None
        if wrong is None:
            n += 1
            try:
                got = json.loads(body)
            except ValueError:
                got = None
            if not isinstance(got, list):
                wrong = "expected a json array of records"
        if wrong:
            return (False, "", "", False, 0, wrong) if not held and kind == "" else (True, held, kind, True, n, None)
        kind = ctype
        if len(held) + len(got) > cap:
            return True, held + got[: cap - len(held)], kind, True, n, None
        held += got
        if len(got) < limit:
            return True, held, kind, False, n, None
        if len(held) >= cap:
            return True, held, kind, True, n, None
    return True, held, kind, True, n, None


def test_joined_bodies(spark):
    a = lambda *ids: json.dumps([{"id": i, "z": {"b": 1, "a": [1.5, None]}} for i in ids])
    ok = lambda body: (True, 200, None, "json", body)
    sources = {
        "two": [ok(a(1, 2)), ok(a(3))], "budget": [ok(a(1, 2)), (False, None, None, None, None)], "spent": [(False, None, None, None, None)], "down": [(True, 503, None, "", "x")], "late": [ok(a(1, 2)), (True, None, "timed out", None, None)],
        "odd": [ok('{"a": 1}')], "odd later": [ok(a(1, 2)), ok("oops")], "cap": [ok(a(1, 2)), ok(a(3, 4)), ok(a(5, 6))], "over": [ok(a(1, 2)), ok(a(3, 4)), ok(a(5, 6, 7))], "drift": [ok(a(1, 2)), ok('[{"other": 1}]')], "empty": [ok(" []")],
    }
    rows = [(s, i, *p) for s, ps in sources.items() for i, p in enumerate(ps)]
    df = spark.createDataFrame(rows, "source_id string, page int, allowed boolean, status int, error string, content_type string, body string")
    for cap in (4, 5, 100):
        for r in api.joined_pages(df, 2, cap).collect():
            want = joined_by_hand(sources[r["source_id"]], 2, cap)
            assert (r["ok"], json.loads(r["body"]) if r["body"] else "", r["content_type"], r["truncated"], r["pages"], r["error"]) == want, r["source_id"]


def test_addresses_of_pages(spark):
    from pyspark.sql import functions as F

    urls = ["http://h/resource/a.json", "http://h/resource/a.json?$limit=50&x=1", "http://h/a?%24limit=0&y=2"]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    at = lambda page, least=0: [r[0] for r in df.select(api.nth_url(F.col("u"), F.lit(page), least)).collect()]
    assert at(0) == urls and [r[0] for r in df.select(api.requested_limit(F.col("u"))).collect()] == [1000, 50, 1000]
    assert at(2) == ["http://h/resource/a.json?%24limit=1000&%24offset=2000", "http://h/resource/a.json?%24limit=50&x=1&%24offset=100", "http://h/a?%24limit=1000&y=2&%24offset=2000"]
    assert at(0, 60)[1] == "http://h/resource/a.json?%24limit=60&x=1&%24offset=0" and at(0, 60)[0] == urls[0]
