"""Offset-paged API as a Spark data source, for batches and streams: spark.read.format("paged_json"), spark.readStream.format(...).

Both give cells (page, record, label_ord, label, value, error). Options: url, page_size (1000), max_rows (5000), app_token,
order_by; streams also pages_per_poll (10), on_drift (stop or heal) and progress. Works with file:// and http(s) addresses; {offset} and
{limit} in the url are filled in.

Batch: each page is an input partition that fetches itself, so pages load in parallel. A page that fails or isn't JSON
gives one row with its error, an empty one a row without record; kept_pages() then applies the rule of a sequential reader: pages
count up to the first one that failed, has other labels, or isn't full.

Stream: offsets are positions in the sequence of records. A poll walks pages from where the last one ended: a failing page
ends it there, and what was gathered before is a batch; the next poll tries again. Tasks fetch and parse the pages of a
batch. The last page, which isn't full, is read again when it grows: records that were delivered aren't repeated, unless the
hash of what was delivered has changed; then that page is delivered anew. Spark hands the reader no
position when it starts. With the option progress, a file beside the query's checkpoint, the reader remembers the last batch
that it planned and goes on from there; without it the first poll of a start walks all pages, and fails (to be started again)
if one of them fails. Either way nothing is lost or repeated.
"""

from __future__ import annotations

import hashlib
import json
import pathlib
import urllib.request
from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .formats import flat, record_array

MAX_BYTES, TIMEOUT = 32 * 1024 * 1024, 30
SCHEMA = "page int, record long, label_ord int, label string, value string, error string"


class Page(InputPartition):
    """A page, and which of its records (by their place in the sequence) are wanted."""

    def __init__(self, offset: int, limit: int, first: int = 0, last: int | None = None) -> None:
        super().__init__(offset)
        self.offset, self.limit, self.first, self.last = offset, limit, first, last


def page_url(url: str, offset: int, limit: int, order_by: str = "") -> str:
    """A page's address: placeholders, or else $limit, $offset and $order parameters; spaces are encoded."""
    if "{offset}" in url or "{limit}" in url:
        url = url.replace("{offset}", str(offset)).replace("{limit}", str(limit))
    else:
        url += ("&" if "?" in url else "?") + f"$limit={limit}&$offset={offset}"
        if order_by and " " not in order_by and "$order=" not in url and "/resource/" in url:
            url += f"&$order={order_by}%20DESC"
    return url.replace(" ", "%20")


class Paging:
    """What both readers share: options and the fetching of one page."""

    def __init__(self, options: dict[str, str]) -> None:
        self.url = options["url"]
        self.size = int(options.get("page_size", 1000))
        self.rows = int(options.get("max_rows", 5000))
        self.token = options.get("app_token", "")
        self.order_by = options.get("order_by", "")
        self.per_poll = int(options.get("pages_per_poll", 10))
        self.heals = options.get("on_drift", "stop") == "heal"

    def fetched(self, offset: int, limit: int) -> list[dict]:
        """A page's records; OSError or ValueError if it can't be had."""
        url = page_url(self.url, offset, limit, self.order_by)
        headers = {"X-App-Token": self.token} if self.token and "/resource/" in url else {}
        with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=TIMEOUT) as answer:  # noqa: S310
            body = answer.read(MAX_BYTES + 1)
        if len(body) > MAX_BYTES:
            raise ValueError("the page is too large")
        return record_array(json.loads(body))[:limit]


def cells(records: list[dict], page: int, at: int, first: int, last: int) -> Iterator[tuple]:
    order: dict[str, int] = {}
    for i, record in enumerate(records):
        for label, value in flat(record):
            place = order.setdefault(label, len(order))
            if first <= at + i < last:
                yield page, at + i, place, label, value, None


class PagedJson(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_json"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options)

    def streamReader(self, schema: object) -> DataSourceStreamReader:
        return PagedStreamReader(self.options)


class PagedReader(Paging, DataSourceReader):
    def partitions(self) -> list[Page]:
        return [Page(o, min(self.size, self.rows - o)) for o in range(0, self.rows, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        page = partition.offset // self.size
        try:
            records = self.fetched(partition.offset, partition.limit)
        except (OSError, ValueError) as e:
            yield page, None, None, None, None, str(e)[:200] or type(e).__name__
            return
        if not records:
            yield page, None, None, None, None, None
        yield from cells(records, page, partition.offset, partition.offset, partition.offset + partition.limit)


def digest(value: object) -> str:
    return hashlib.sha256(json.dumps(value, sort_keys=True).encode()).hexdigest()[:16]


def labels_of(records: list[dict]) -> str:
    return digest(list(dict.fromkeys(label for r in records for label, _ in flat(r))))


class PagedStreamReader(Paging, DataSourceStreamReader):
    """Offsets: position (records delivered), labels and prefix (hashes of the labels, and of what was delivered of a last page that
    isn't full), state (open, drift or truncated)."""

    START = {"position": 0, "labels": "", "prefix": "", "state": "open"}

    def __init__(self, options: dict[str, str]) -> None:
        super().__init__(options)
        self.progress = options.get("progress", "")
        self.at: dict | None = None
        if self.progress:
            path = pathlib.Path(self.progress)
            self.at = json.loads(path.read_text()) if path.exists() else dict(self.START)

    def initialOffset(self) -> dict:  # noqa: N802
        self.at = self.at or dict(self.START)
        return dict(self.START)

    def latestOffset(self) -> dict:  # noqa: N802
        known = self.at is not None
        now = dict(self.at or self.START, state="open")
        pages = 0
        while now["position"] < self.rows and (pages < self.per_poll or not known):
            begin, done = now["position"] - now["position"] % self.size, now["position"] % self.size
            try:
                records = self.fetched(begin, min(self.size, self.rows - begin))
            except (OSError, ValueError):
                if not known:
                    raise
                break  # what is gathered stays, and the next poll tries this page again
            labels = labels_of(records)
            if records and now["labels"] and labels != now["labels"] and not self.heals:
                now["state"] = "drift"
                break
            end = begin + len(records)
            if end < now["position"] or (end == now["position"] and (not done or digest(records) == now["prefix"])):
                break  # nothing new
            now |= {"position": end, "labels": labels if records else now["labels"], "prefix": digest(records) if end % self.size else ""}
            pages += 1
            if len(records) < self.size:
                break
        if now["position"] >= self.rows:
            now["state"] = "truncated"
        self.at = now
        return dict(now)

    def partitions(self, start: dict, end: dict) -> Sequence[Page]:
        first, last, done = start["position"], end["position"], start["position"] % self.size
        if done and digest(self.fetched(first - done, self.size)[:done]) != start["prefix"]:
            first -= done  # what was delivered of this page has changed
        if self.progress:
            planned = pathlib.Path(f"{self.progress}.new")
            planned.write_text(json.dumps(end))
            planned.replace(self.progress)
        return [Page(o, min(self.size, self.rows - o), first, last) for o in range(first - first % self.size, last, self.size)]

    def read(self, partition: Page) -> Iterator[tuple]:
        records = self.fetched(partition.offset, partition.limit)
        if partition.offset + len(records) < min(partition.last, partition.offset + partition.limit):
            raise ValueError("the page has fewer records than when it was polled")
        yield from cells(records, partition.offset // self.size, partition.offset, partition.first, partition.last)


def kept_pages(cells: DataFrame, page_size: int = 1000, max_rows: int = 5000, by: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(cells kept, report) of pages that were read in parallel, as one reader after the other would have kept them.

    Pages count up to the first that failed or has other labels than the first page (in order of appearance), or is missing, and
    up to and including the first that isn't full; rows beyond max_rows are cut. report: pages, records, truncated, stopped (short,
    drift, failed or cap), error (of a failed first page, else null). by: a column that tells several sources apart.
    """
    keys = [by] if by else []
    shape = F.array_sort(F.collect_set(F.when(F.col("label").isNotNull(), F.struct("label_ord", "label"))))
    pages = cells.groupBy(*keys, "page").agg(F.count_distinct("record").alias("n"), shape.alias("labels"), F.max("error").alias("error"))
    first = F.array_sort(F.collect_list(F.struct("page", "n", "labels", "error")))
    rows = pages.groupBy(*keys).agg(first.alias("pages"))  # a few pages for each source
    head = F.get("pages", F.lit(0))
    why = lambda p, i: (
        F.when(p["page"] != i, "failed").when(p["error"].isNotNull(), "failed").when((p["n"] > 0) & (p["labels"] != head["labels"]), "drift")
        .when(p["page"] * page_size + p["n"] >= max_rows, "cap").when(p["n"] < page_size, "short")
    )
    ends = F.transform("pages", lambda p, i: F.struct(why(p, i).alias("why"), p["page"].alias("page"), p["n"].alias("n")))
    stop = F.get(F.filter(ends, lambda e: e["why"].isNotNull()), F.lit(0))
    rows = rows.withColumn("stop", stop).withColumn("stopped", F.coalesce(F.col("stop.why"), F.lit("short")))
    taken = F.when(F.col("stop").isNull(), F.size("pages")).otherwise(F.col("stop.page") + F.when(F.col("stopped").isin("short", "cap"), 1).otherwise(0))
    taken = F.least(taken, F.size("pages"))
    rows = rows.withColumn("taken", taken)
    count = F.aggregate(F.slice("pages", F.lit(1), F.col("taken")), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    report = rows.select(*keys, F.col("taken").alias("pages"), F.least(count, F.lit(max_rows)).cast("long").alias("records"), (F.col("stopped") == "cap").alias("truncated"), "stopped", F.when(F.col("taken") == 0, head["error"]).alias("error"))
    upto = report.select(*keys, F.col("pages").alias("__pages"))
    kept = (cells.join(upto, keys) if keys else cells.crossJoin(upto)).where((F.col("page") < F.col("__pages")) & F.col("record").isNotNull() & (F.col("record") < max_rows))
    return kept.drop("__pages"), report


# --- pages whose bodies are joined to one

#: Records that a joined body holds at most, and rows of a page where the address doesn't say.
RECORD_CAP, PAGE_ROWS = 5000, 1000


def requested_limit(url: Column) -> Column:
    """The rows of a page that an address asks for."""
    asked = F.floor(F.regexp_extract(url, r"[?&](?:\$|%24)limit=([0-9]+(?:\.[0-9]+)?)(?=&|#|$)", 1).try_cast("double"))
    return F.when(asked > 0, asked).otherwise(PAGE_ROWS).cast("long")


def with_param(url: Column, name: str, value: Column) -> Column:
    """An address with a $parameter, which takes the place of one that is there."""
    there = rf"([?&])(?:\$|%24){name}=[^&#]*"
    said = F.concat(F.lit(f"%24{name}="), value.cast("string"))
    return F.when(url.rlike(there), F.regexp_replace(url, F.lit(there), F.concat(F.lit("$1"), said))).otherwise(F.concat(url, F.when(url.contains("?"), "&").otherwise("?"), said))


def nth_url(url: Column, page: Column, minimum: int = 0) -> Column:
    """The address of a page: the first one as it is, unless pages have to be larger than it asks for."""
    asked = requested_limit(url)
    limit = F.greatest(asked, F.lit(minimum).cast("long"))
    return F.when((page == 0) & (limit == asked), url).otherwise(with_param(with_param(url, "limit", limit), "offset", limit * page))


def joined_pages(pages: DataFrame, limit: Column | int = PAGE_ROWS, cap: int = RECORD_CAP) -> DataFrame:
    """(source_id, ok, body, content_type, truncated, pages, error): the JSON arrays of a source's pages as one array.

    pages: source_id, page, allowed (by the host's budget, see operations.host_budget), status (null or 200 if it came), error,
    content_type, body. A first page that isn't allowed, failed or is no array is the source's error; a later one ends the
    array there, as truncated. A page with fewer than limit records is the last one; labels aren't compared. Records are
    objects. Sources hold `cap` records and as many pages as these need, so one row for each is small.
    """
    records = F.when(F.ltrim(F.col("body")).startswith("["), F.from_json("body", "array<string>"))
    wrong = (
        F.when(~F.coalesce("allowed", F.lit(True)), "host request budget spent; try again shortly").when(F.col("error").isNotNull(), F.col("error"))
        .when(F.col("status") != 200, F.concat(F.lit("http status "), F.col("status").cast("string"))).when(records.isNull(), "expected a json array of records")
    )
    size = (F.lit(limit) if isinstance(limit, int) else limit).cast("long")
    row = F.struct("page", wrong.alias("wrong"), (records.isNull() & F.coalesce("allowed", F.lit(True)) & F.col("error").isNull() & F.coalesce(F.col("status") == 200, F.lit(True))).alias("came"), records.alias("records"), F.col("content_type").alias("kind"), size.alias("size"))
    each = pages.groupBy("source_id").agg(F.array_sort(F.collect_list(row)).alias("p"))
    start = F.struct(F.array().cast("array<string>").alias("held"), F.lit(0).alias("n"), F.lit("").alias("kind"), F.lit(False).alias("done"), F.lit(True).alias("cut"), F.lit(None).cast("string").alias("error"))

    def step(a: Column, p: Column) -> Column:
        fine = p["wrong"].isNull()
        together = F.concat(a["held"], F.coalesce(p["records"], F.array().cast("array<string>")))
        short = fine & (F.size(p["records"]) < p["size"]) & (F.size(together) <= cap)
        stop = ~fine | short | (F.size(together) >= cap)
        new = F.struct(
            F.when(fine, F.slice(together, 1, cap)).otherwise(a["held"]).alias("held"), (a["n"] + F.when(fine | p["came"], 1).otherwise(0)).alias("n"), F.when(fine, F.coalesce(p["kind"], F.lit(""))).otherwise(a["kind"]).alias("kind"),
            stop.alias("done"), (~short).alias("cut"), F.when(~fine & (a["n"] == 0), p["wrong"]).alias("error"),
        )
        return F.when(a["done"], a).otherwise(new)

    out = each.select("source_id", F.aggregate("p", start, step).alias("r"))
    ok = F.col("r.error").isNull()
    body = F.when(ok, F.concat(F.lit("["), F.array_join("r.held", ","), F.lit("]"))).otherwise("")
    return out.select("source_id", ok.alias("ok"), body.alias("body"), F.when(ok, F.col("r.kind")).otherwise("").alias("content_type"), (ok & F.col("r.cut")).alias("truncated"), F.when(ok, F.col("r.n")).otherwise(0).alias("pages"), F.col("r.error").alias("error"))
