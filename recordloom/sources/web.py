"""Web sources over tables of fetched pages: URLs, robots rules, the crawl frontier, pages of an API."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def path(url: Column) -> Column:
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)?", 1)
    return F.when(p == "", "/").otherwise(p)


def asked_path(url: Column) -> Column:
    """A URL's path with its query, as robots rules see it."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


RULES = "array<struct<path: string, allow: boolean>>"


def robots(body: Column, agent: str) -> Column:
    """struct<rules, delay> of a robots.txt for an agent. Records whose name is part of the agent's win over those for *, if they have a
    rule or a delay; an empty Disallow is none. Lines without a colon and delays that aren't numbers are passed over."""
    lines = F.filter(F.transform(F.split(body, "\n", -1), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, "#.*", ""), r"[\t\r\f\x0B]", " "))), lambda x: x.contains(":"))
    none = F.array().cast(RULES)
    start = F.struct(none.alias("own"), none.alias("any"), F.lit(0.0).alias("own_delay"), F.lit(0.0).alias("any_delay"), F.lit(False).alias("in_own"), F.lit(False).alias("in_any"), F.lit(False).alias("named"))

    def step(a: Column, x: Column) -> Column:
        key, value = F.lower(F.trim(F.substring_index(x, ":", 1))), F.trim(F.substring(x, F.instr(x, ":") + 1, F.length(x)))
        who, name = F.lower(value), key == "user-agent"
        ours = (who != "") & (who != "*") & F.lit(agent.lower()).contains(who)
        inside = lambda held, now: F.when(name, (a["named"] & held) | now).otherwise(held)
        rule = (key == "allow") | ((key == "disallow") & (value != ""))
        one = F.array(F.struct(value.alias("path"), (key == "allow").alias("allow"))).cast(RULES)
        delay = F.when(key == "crawl-delay", F.regexp_extract(value, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0).try_cast("double"))
        return F.struct(
            F.when(rule & a["in_own"], F.concat(a["own"], one)).otherwise(a["own"]).alias("own"),
            F.when(rule & a["in_any"], F.concat(a["any"], one)).otherwise(a["any"]).alias("any"),
            F.when(a["in_own"], F.coalesce(delay, a["own_delay"])).otherwise(a["own_delay"]).alias("own_delay"),
            F.when(a["in_any"], F.coalesce(delay, a["any_delay"])).otherwise(a["any_delay"]).alias("any_delay"),
            inside(a["in_own"], ours).alias("in_own"),
            inside(a["in_any"], who == "*").alias("in_any"),
            name.alias("named"),
        )

    def finish(a: Column) -> Column:
        own = (F.size(a["own"]) > 0) | (a["own_delay"] > 0)
        return F.struct(F.when(own, a["own"]).otherwise(a["any"]).alias("rules"), F.when(own, a["own_delay"]).otherwise(a["any_delay"]).alias("delay"))

    return F.aggregate(lines, start, step, finish)


def permitted(rules: Column, at: Column) -> Column:
    """Whether rules let a path be fetched: the longest that it starts with decides, Allow on ties; without any it may."""
    hits = F.filter(F.coalesce(rules, F.array().cast(RULES)), lambda r: (r["path"] != "") & at.startswith(r["path"]))
    best = F.array_max(F.transform(hits, lambda r: F.struct(F.octet_length(r["path"]).alias("n"), r["allow"].alias("allow"))))
    return F.coalesce(best["allow"], F.lit(True))


def allowed(urls: DataFrame, rules: DataFrame, agent: str) -> DataFrame:
    """urls (url) with allowed, by rules (host, agent, allow, prefix): records whose agent is part of ours before *, the longest prefix,
    Allow on ties. A record of ours with empty prefixes only is none."""
    ours = (F.col("agent") != "") & (F.col("agent") != "*") & F.lit(agent.lower()).contains(F.lower("agent"))
    some = rules.where((F.col("prefix") != "") | F.col("allow")).where(ours | (F.col("agent") == "*"))
    own = some.where(ours).select("host").distinct().withColumn("own", F.lit(True))
    r = some.join(own, "host", "left").where(F.when(F.col("own"), ours).otherwise(F.col("agent") == "*")).where("prefix != ''")
    u = urls.withColumn("__host", host(F.col("url"))).withColumn("__path", asked_path(F.col("url")))
    hit = u.select("url", "__host", "__path").distinct().join(r, (F.col("__host") == r["host"]) & F.col("__path").startswith(F.col("prefix")))
    best = hit.groupBy("url").agg(F.max_by("allow", F.struct(F.octet_length("prefix"), "allow")).alias("__allow"))
    return u.join(best, "url", "left").withColumn("allowed", F.coalesce("__allow", F.lit(True))).drop("__allow", "__host", "__path")


def links(pages: DataFrame) -> DataFrame:
    """(url, target): absolute same-host links of pages (url, html), in small steps of native expressions."""
    href = F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), 1)))
    base = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    h = F.col("href")
    target = F.when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), h).when(h.startswith("/"), F.concat(base, h)).otherwise(F.concat(base, F.regexp_extract(path(F.col("url")), "^(.*/)", 1), h))
    return pages.select("url", href.alias("href")).select("url", target.alias("target")).where(host(F.col("url")) == host(F.col("target")))


def normalized(p: Column) -> Column:
    """A path without . and .. parts and empty ones; .. at the top goes nowhere."""
    step = lambda held, x: F.when((x == "") | (x == "."), held).when(x == "..", F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0)))).otherwise(F.concat(held, F.array(x)))
    parts = F.aggregate(F.split(p, "/", -1), F.array().cast("array<string>"), step)
    return let(parts, lambda x: F.concat(F.lit("/"), F.array_join(x, "/"), F.when(p.rlike(r"(^|/)\.{0,2}\z") & (F.size(x) > 0), "/").otherwise("")))


def resolved(base: Column, href: Column) -> Column:
    """An http address that a link on a page leads to, without its fragment and with . and .. resolved; null for other schemes."""
    scheme, site = F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*):", 1), F.regexp_extract(base, "^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)

    def of(h: Column) -> Column:
        tail = F.regexp_extract(h, r"(\?.*)?\z", 1)
        bare = F.regexp_replace(h, r"\?.*\z", "")
        around = F.regexp_extract(path(base), "^(.*/)", 1)
        own = F.when(bare == "", path(base)).when(bare.startswith("/"), normalized(bare)).otherwise(normalized(F.concat(around, bare)))
        inside = F.concat(site, own, tail)
        return F.when(h.rlike("(?i)^https?://"), h).when(h.rlike("^[A-Za-z][A-Za-z0-9+.-]*:"), None).when(h.startswith("//"), F.concat(scheme, F.lit(":"), h)).when(h != "", inside)

    return let(F.regexp_replace(F.trim(href), "#.*$", ""), of)


def ordered_links(pages: DataFrame, limit: int) -> DataFrame:
    """pages (url, html, ...) with target and place: links in page order, those to further pages of a list (next, a number, rel=next)
    before others, each target once, `limit` of a page at most. They are ordered within the page's own array."""
    anchor = F.regexp_extract_all("html", F.lit(r"(?is)<a\b[^>]*>.*?(?:</a\s*>|\z)"), 0)
    value = lambda x, name: F.coalesce(F.nullif(F.regexp_extract(x, rf"""(?is)^<a\b[^>]*?\b{name}\s*=\s*"([^"]*)\"""", 1), F.lit("")), F.regexp_extract(x, rf"""(?is)^<a\b[^>]*?\b{name}\s*=\s*'([^']*)'""", 1))
    said = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_replace(x, r"(?s)<[^>]*>", " "), r"\s+", " ")))
    found = F.transform(anchor, lambda x, i: F.struct(i.alias("i"), value(x, "href").alias("href"), said(x).alias("said"), F.lower(value(x, "rel")).alias("rel")))
    leads = lambda x: x["said"].isin("next", "next page", ">", "&gt;", "\u00bb", "&raquo;") | (x["rel"] == "next") | x["said"].rlike("^[0-9]{1,3}\\z")
    placed = F.transform("found", lambda x: F.struct((~leads(x)).alias("later"), x["i"].alias("i"), resolved(F.col("url"), x["href"]).alias("target")))
    targets = F.array_distinct(F.transform(F.filter(F.array_sort(placed), lambda x: x["target"].isNotNull()), lambda x: x["target"]))
    rows = pages.withColumn("found", found).withColumn("targets", F.slice(targets, 1, limit))
    return rows.select(*pages.columns, F.posexplode("targets").alias("place", "target"))


#: Fixed value: how many addresses a crawl queues for each page that it may fetch.
QUEUED = 8


def crawl(seeds: DataFrame, pages: DataFrame, edges: DataFrame, max_depth: int, max_pages: int, *, rules: DataFrame | None = None) -> DataFrame:
    """The walks from seeds (url) over pages (url, body_hash, follow) and their ordered links, edges (url, target, place): one row for each
    address that a walk took from its queue, (seed, url, depth, place, outcome), place being its turn.

    Each seed's walk is one of its own, breadth first, on the seed's host. outcome: robots (refused by rules (host, rules), see
    robots()), failed (no such page), duplicate (its body was seen before: it is neither counted nor followed) or fetched. A walk ends
    with max_pages fetched; its queue takes QUEUED times as many addresses, the first ones. Only pages with follow lead on.

    A round is a level of all walks: joins with pages and edges, and windows over one walk's level, which the queue's bound limits. Rounds are
    checkpointed, so that no round computes the ones before again.
    """
    own = seeds.select(F.regexp_replace("url", "#.*", "").alias("seed")).distinct()
    level = own.select("seed", F.col("seed").alias("url"), F.lit(1).cast("long").alias("place")).checkpoint()
    queued, log = level.select("seed", "url"), None
    turn = Window.partitionBy("seed").orderBy("place")
    for depth in range(max_depth + 1):
        took = level
        if rules is not None:
            took = took.join(rules.select(F.col("host").alias("__h"), F.col("rules").alias("__r")), host(F.col("url")) == F.col("__h"), "left").withColumn("may", permitted(F.col("__r"), asked_path(F.col("url")))).drop("__h", "__r")
        else:
            took = took.withColumn("may", F.lit(True))
        took = took.join(pages.select("url", "body_hash", "follow", F.lit(True).alias("there")), "url", "left")
        bodies = log.where("outcome = 'fetched'").select("seed", "body_hash", F.lit(True).alias("old")) if log is not None else None
        took = took.join(bodies, ["seed", "body_hash"], "left") if bodies is not None else took.withColumn("old", F.lit(None).cast("boolean"))
        live = F.col("may") & F.col("there")
        again = F.row_number().over(Window.partitionBy("seed", "body_hash", live).orderBy("place")) > 1
        outcome = F.when(~F.col("may"), "robots").when(F.col("there").isNull(), "failed").when(F.coalesce("old", F.lit(False)) | again, "duplicate").otherwise("fetched")
        took = took.withColumn("outcome", outcome)
        had = log.groupBy("seed").agg(F.count_if(F.col("outcome") == "fetched").alias("had")) if log is not None else own.select("seed", F.lit(0).cast("long").alias("had"))
        before = F.coalesce(F.sum(F.when(F.col("outcome") == "fetched", 1).otherwise(0)).over(turn.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        took = took.join(had, "seed").withColumn("before", F.col("had") + before).where(F.col("before") < max_pages)
        took = took.select("seed", "url", F.lit(depth).alias("depth"), "place", "outcome", "body_hash", F.coalesce("follow", F.lit(False)).alias("follow")).checkpoint()
        log = took if log is None else log.unionByName(took)
        if depth == max_depth:
            break
        found = took.where("outcome = 'fetched' and follow").select("seed", "url", F.col("place").alias("page")).join(edges.select("url", F.regexp_replace("target", "#.*", "").alias("target"), F.col("place").alias("link")), "url")
        found = found.where(host(F.col("target")) == host(F.col("seed"))).groupBy("seed", "target").agg(F.min(F.struct("page", "link")).alias("first"))
        fresh = found.withColumnRenamed("target", "url").join(queued, ["seed", "url"], "left_anti")
        held = queued.groupBy("seed").agg(F.count("*").alias("held"))
        nth = F.row_number().over(Window.partitionBy("seed").orderBy("first"))
        level = fresh.withColumn("n", nth).join(held, "seed").where(F.col("n") + F.col("held") <= QUEUED * max_pages).select("seed", "url", (F.col("held") + F.col("n")).alias("place")).checkpoint()
        if level.isEmpty():
            break
        queued = queued.unionByName(level.select("seed", "url"))
    return log.select("seed", "url", "depth", "place", "outcome")


def paged(rows: DataFrame, page: int, cap: int | None = None) -> DataFrame:
    """(page, n, stop): offset paging of all rows, which ends with a page that isn't full, or at `cap` rows as truncated. Each
    partition's rows fall on the pages that its place among the others gives, so no row is numbered or moved."""
    parts = rows.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ends = parts.select(before.alias("first"), (before + F.col("n")).alias("end"))  # one row for each partition
    if cap is not None:
        ends = ends.select("first", F.least("end", F.lit(cap)).alias("end"))
    last = ends.agg(F.coalesce(F.max("end"), F.lit(0)).alias("end")).select(F.col("end").alias("first"), "end")  # a full last page is followed by an empty one
    pages = F.explode(F.sequence(F.floor(F.col("first") / page), F.floor(F.greatest(F.col("end") - 1, F.col("first")) / page)))
    each = ends.where("end > first").union(last).select("first", "end", pages.alias("page"))
    held = F.least("end", (F.col("page") + 1) * page) - F.greatest("first", F.col("page") * page)
    n = each.groupBy(F.col("page").cast("int").alias("page")).agg(F.sum(held).alias("n"))
    stop = F.when(F.col("n") < page, "short").otherwise("next")
    if cap is not None:
        n = n.where(F.col("page") * page < cap)
        stop = F.when((F.col("page") + 1) * page >= cap, "truncated").otherwise(stop)
    return n.select("page", "n", stop.alias("stop"))
