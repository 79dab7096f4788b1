"""Main text of web pages by wrappers: union-free regular expressions over the tags of a host's pages.

A page is a tree of labels (a tag, with class and id where these tell sections apart). Its wrapper is an expression
over them with text slots: runs of one label, and runs of a group of up to GROUP labels, become repeated groups. All pages of
one host are aligned: children that match are
merged, a mismatch becomes optional, a repeat on either side stays one. In the host's wrapper the main region is the
article, or else the section with most of the text that isn't link text or within furniture (navigation, headers,
adverts, forms, reader comments, ...). Articles side by side are one region, whatever their classes. The regions that
single pages' wrappers have are the host's layouts. A page is read by the first region, that of the host's wrapper and then the
layouts by their pages, that holds at least SHARE of the page's text; if none does, by the one with most text, the region
of the page's own wrapper among them.

A leaf of the wrapper is a path of labels that ends in a block; runs of one label share it. A block of text that at least ALIKE of
a host's distinct pages with that leaf have there (DISTINCT pages or more) is template, other blocks fill slots, and only slots are
the page's text. Where templates are more than half of a host's text, its pages are copies of each other, and all blocks count as slots.

Tasks align their pages of each host, each structure once; what they have is aligned by salted key, then by host. Layouts are
counted with map-side combining and both are joined back by host, so a host with a third of all pages costs its share of a scan.
"""

from __future__ import annotations

import html
import json
import re
from collections import Counter
from collections.abc import Generator, Iterator
from difflib import SequenceMatcher

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import join_small, written

#: Labels of a repeated group, at most; share of a page's text that a region has to hold.
GROUP, SHARE = 4, 0.5
#: Least share and number of a host's distinct pages that hold a block of template text.
ALIKE, DISTINCT = 0.9, 4
#: Structures that a task holds before it aligns or hands on what it has; salts of a host's wrappers.
HELD, SALTS = 2_000, 32

# HTML's own element classes.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noframes".split())
BLOCK = set("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}}
SCOPE = set("table ul ol dl select html body article section main div".split())

# Elements, roles and words of class names that mark what isn't the article.
FURNITURE = set("nav footer aside form script style noscript template iframe button select textarea svg dialog menu head title object audio video canvas search".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
WORDS = set("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion sidebar widget nav navbar navigation menu breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe signup login comment comments reply replies disqus share sharing social related recommended toolbar pagination pager banner".split())

ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
TAG_END = re.compile(r"""(?:"[^"]*"|'[^']*'|[^'">])*>""")
NAME = re.compile(r"[a-zA-Z][^\s/>]*")


class Node:
    __slots__ = ("children", "furniture", "label", "tag")

    def __init__(self, tag: str, label: str, furniture: bool) -> None:
        self.tag, self.label, self.furniture, self.children = tag, label, furniture, []


def element(tag: str, attributes: str) -> Node:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(attributes)} if attributes.strip(" /") else {}
    named = f"{found.get('class', '')} {found.get('id', '')}".lower()
    words = set(re.split(r"[^a-z]+", named))
    label = tag
    if tag in BLOCK and named.strip():
        label += "." + "-".join(sorted(w for w in words if w))
    hidden = "hidden" in found or found.get("aria-hidden") == "true"
    outer = tag not in ("html", "body", "article", "main")
    return Node(tag, label, tag in FURNITURE or hidden or found.get("role", "").lower() in ROLES or (outer and bool(words & WORDS)) or (tag == "article" and bool(words & {"comment", "comments", "reply", "replies"})))


def parse(page: str) -> Node:
    """A page's tree; its text is strings among the children. Forgiving: end tags may be missing or stray."""
    root = Node("#root", "#root", False)
    stack = [root]
    at, n = 0, len(page)
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            stack[-1].children.append(page[at:])
            break
        if lt > at:
            stack[-1].children.append(page[at:lt])
        at = lt
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = n if end < 0 else end + 3
        elif page.startswith(("<!", "<?"), lt):
            end = page.find(">", lt)
            at = n if end < 0 else end + 1
        elif (name := NAME.match(page, lt + 2 if page.startswith("</", lt) else lt + 1)) and (end := TAG_END.match(page, name.end())):
            tag, at = name.group().lower(), end.end()
            if page[lt + 1] == "/":
                close(stack, tag)
                continue
            node = element(tag, page[name.end() : at - 1])
            open_tag(stack, node)
            if tag in RAW:
                stop = re.compile(f"</{tag}\\s*>", re.I).search(page, at)
                node.children.append(page[at : stop.start() if stop else n])
                at = stop.end() if stop else n
            elif tag not in VOID:
                stack.append(node)
        else:
            stack[-1].children.append("<")
            at = lt + 1
    return root


def open_tag(stack: list[Node], node: Node) -> None:
    gone = {"p"} if node.tag in BLOCK else set()
    gone |= CLOSES.get(node.tag, set())
    if gone:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in gone:
                del stack[i:]
                gone = gone - {"p"} if node.tag in CLOSES else set()
                if not gone:
                    break
            elif stack[i].tag in SCOPE and not (node.tag in ("td", "th", "tr") and stack[i].tag in ("td", "th", "tr")):
                break
    stack[-1].children.append(node)


def close(stack: list[Node], tag: str) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == tag:
            del stack[i:]
            return
        if tag not in BLOCK and stack[i].tag in BLOCK:
            return


def run(task: Generator) -> object:
    """Result of a generator that yields the generators whose results it needs: recursion of any depth without Python frames."""
    stack, value = [task], None
    while stack:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as e:
            stack.pop()
            value = e.value
    return value


def infer(node: Node, inside: bool = False) -> dict:
    """A wrapper of one tree: l label, q quantity ('', '?', '+', '*'), c children, m text that isn't furniture or links."""
    return run(inferring(node, inside))


def inferring(node: Node, inside: bool) -> Generator:
    inside = inside or node.furniture
    items: list[dict] = []
    for c in node.children:
        if isinstance(c, str):
            size = len(c.strip())
            if size:
                items.append({"l": "#text", "q": "", "c": [], "m": 0 if inside else size, "f": inside})
        else:
            items.append((yield inferring(c, inside or c.tag == "a")))
    items = yield repeats(items)
    return {"l": node.label, "q": "", "c": items, "m": sum(i["m"] for i in items), "f": node.furniture, "t": node.tag}


def repeats(items: list[dict]) -> Generator:
    """Runs of equal labels, then of equal groups, as one repeated item each."""
    out: list[dict] = []
    for i in items:
        if out and out[-1]["l"] == i["l"]:
            out[-1] = yield merging(out[-1], i)
            out[-1]["q"] = "+" if out[-1]["q"] in ("", "+") else "*"
        else:
            out.append(i)
    for k in range(2, GROUP + 1):
        at, packed = 0, []
        while at < len(out):
            names, times = [i["l"] for i in out[at : at + k]], 1
            while len(names) == k and [i["l"] for i in out[at + times * k : at + (times + 1) * k]] == names:
                times += 1
            if times > 1:
                group = out[at : at + k]
                for t in range(1, times):
                    merged = []
                    for a, b in zip(group, out[at + t * k : at + (t + 1) * k], strict=True):
                        merged.append((yield merging(a, b)))
                    group = merged
                packed.append({"l": "(" + " ".join(names) + ")", "q": "+", "c": group, "m": sum(i["m"] for i in group), "f": False})
                at += k * times
            else:
                packed.append(out[at])
                at += 1
        out = packed
    return out


def merge(a: dict, b: dict) -> dict:
    """One wrapper for what either matches; both have one label."""
    return run(merging(a, b))


def merging(a: dict, b: dict) -> Generator:
    optional = "?" in a["q"] + b["q"] or "*" in a["q"] + b["q"]
    many = any(q in a["q"] + b["q"] for q in "+*")
    return a | {"q": ("*" if optional else "+") if many else "?" if optional else "", "c": (yield aligned(a["c"], b["c"])) if a["c"] or b["c"] else [], "m": a["m"] + b["m"], "f": a["f"] and b["f"]}


def aligned(a: list[dict], b: list[dict]) -> Generator:
    out: list[dict] = []
    once = lambda items: [i | {"q": "*" if i["q"] in ("+", "*") else "?"} for i in items]
    names = [c["l"] for c in a], [c["l"] for c in b]
    codes = [("equal", 0, len(a), 0, len(b))] if names[0] == names[1] else SequenceMatcher(None, *names, autojunk=False).get_opcodes()
    for kind, i, j, x, y in codes:
        if kind == "equal":
            for p, q in zip(a[i:j], b[x:y], strict=True):
                out.append((yield merging(p, q)))
        else:
            out += once(a[i:j]) + once(b[x:y])
    return out


def expression(w: dict) -> str:
    """The wrapper as a union-free regular expression."""
    return run(expressing(w))


def expressing(w: dict) -> Generator:
    if w["l"] == "#text":
        return "#text" + w["q"]
    parts = []
    for c in w["c"]:
        parts.append((yield expressing(c)))
    inner = " ".join(parts)
    if w["l"].startswith("("):
        return f"({inner}){w['q']}"
    body = f"<{w['l']}>{inner}</>" if inner else f"<{w['l']}/>"
    return f"({body}){w['q']}" if w["q"] else body


def main_path(w: dict) -> list[str]:
    """Labels from the root to the main region of a wrapper."""
    best: tuple[int, int, list[str]] | None = None
    heap: list[tuple[dict, list[str]]] = [(w, [])]
    while heap:
        node, path = heap.pop()
        for c in node["c"]:
            if c["f"]:
                continue
            here = path if c["l"].startswith("(") else [*path, c["l"]]
            if c["l"] != "#text":
                if c.get("t") in ("article", "main") and c["m"]:
                    rank = (2 if c["t"] == "article" else 1, c["m"])
                    if best is None or rank > best[:2]:
                        best = (*rank, here)
                heap.append((c, here))
    return best[2] if best else mass_path(w)


def mass_path(w: dict) -> list[str]:
    """Labels from the root to the section that holds most text, whatever its element."""
    path: list[str] = []
    node = w
    while True:
        parts = [c for c in node["c"] if not c["f"] and c["m"]]
        top = max(parts, key=lambda c: c["m"], default=None)
        if top is None or top["l"] == "#text" or top["l"].startswith("(") or top["q"] in ("+", "*") or top.get("t") not in BLOCK or top.get("t") in ("p", "h1", "h2", "h3", "table", "ul", "ol") or top["m"] < 0.6 * node["m"]:
            return path
        path.append(top["l"])
        node = top


def main_region(w: dict) -> list[str | list[str]]:
    """main_path, with the labels of all articles that stand side by side at its end."""
    path = main_path(w)
    nodes = [w]
    for label in path[:-1]:
        nodes = [c for c in within(nodes) if c["l"] == label and not c["f"]]
    beside = within(nodes)
    if not any(c["l"] == path[-1] and c.get("t") == "article" for c in beside if path):
        return path
    return [*path[:-1], sorted({c["l"] for c in beside if c.get("t") == "article" and c["m"] and not c["f"]})]


def own_regions(w: dict) -> list[list[str | list[str]]]:
    """A wrapper's main region; if that holds too little of the text, the section elsewhere that holds most, too."""
    main, other = main_region(w), mass_path(w)
    size, nodes = 0, [w]
    for label in main:
        nodes = [c for c in within(nodes) if c["l"] in ([label] if isinstance(label, str) else label) and not c["f"]]
    size = sum(n["m"] for n in nodes)
    return [main] if size >= SHARE * w["m"] or around(other, main) else [main, other]


def around(a: list[str | list[str]], b: list[str | list[str]]) -> bool:
    """Whether region a is b or holds it."""
    return len(a) <= len(b) and all(x == y or (isinstance(y, list) and x in y) for x, y in zip(a, b))


def within(nodes: list[dict]) -> list[dict]:
    """Children of wrappers, those of repeated groups instead of the groups."""
    out: list[dict] = []
    work = [c for n in reversed(nodes) for c in reversed(n["c"])]
    while work:
        c = work.pop()
        if c["l"].startswith("("):
            work.extend(reversed(c["c"]))
        else:
            out.append(c)
    return out


def regions(root: Node, path: list[str | list[str]]) -> list[Node]:
    nodes = [root]
    for label in path:
        labels = [label] if isinstance(label, str) else label
        nodes = [c for n in nodes for c in n.children if isinstance(c, Node) and c.label in labels and not c.furniture]
    return nodes


def flat(w: dict) -> tuple[str, list[int]]:
    """A wrapper's structure as text, and the amounts of text of its nodes."""
    shape, sizes, work = [], [], [w]
    while work:
        n = work.pop()
        shape.append([n["l"], n["q"], int(n["f"]), n.get("t"), len(n["c"])])
        sizes.append(n["m"])
        work.extend(reversed(n["c"]))
    return json.dumps(shape, ensure_ascii=False, separators=(",", ":")), sizes


def unflat(shape: str, sizes: list[int]) -> dict:
    done: list[dict] = []
    for (label, q, f, tag, n), m in zip(reversed(json.loads(shape)), reversed(list(sizes)), strict=True):
        done.append({"l": label, "q": q, "c": [done.pop() for _ in range(n)], "m": int(m), "f": bool(f), "t": tag})
    return done.pop()


def all_merged(found: dict[str, list[int]]) -> dict:
    """One wrapper for several structures, aligned in pairs, then pairs of these."""
    some = [unflat(*x) for x in sorted(found.items())]
    while len(some) > 1:
        some = [merge(*some[i : i + 2]) if i + 1 < len(some) else some[i] for i in range(0, len(some), 2)]
    return some[0]


def add(found: dict[str, list[int]], shape: str, sizes: list[int]) -> None:
    have = found.get(shape)
    found[shape] = [a + b for a, b in zip(have, sizes, strict=True)] if have else sizes


def blocks(node: Node) -> list[str]:
    """The text blocks of a region in page order, without furniture."""
    return [b for _, b in leaves(node, 0)]


def below(leaf: int, label: str) -> int:
    return xxhash.xxh64_intdigest(label, leaf)


def region_leaves(root: Node, path: list[str | list[str]]) -> list[tuple[int, str]]:
    """(leaf, text) of the blocks of a page's regions; a leaf is a hash of the labels from the root to the block."""
    above = 0
    for label in path[:-1]:
        above = below(above, label)
    return [x for n in regions(root, path) for x in leaves(n, below(above, n.label) if path else 0)]


def leaves(node: Node, leaf: int) -> list[tuple[int, str]]:
    """(leaf, text) of the blocks of a region, whose own leaf is given."""
    out: list[tuple[int, str]] = []
    text: list[str] = []
    at = leaf

    def end() -> None:
        if text:
            block = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if block:
                out.append((at, block))

    work: list[tuple[Node | str | None, int]] = [(node, leaf)]
    while work:
        n, here = work.pop()
        if n is None:
            end()
            at = here
        elif isinstance(n, str):
            text.append(n)
        elif n.tag == "br":
            text.append(" ")
        elif not n.furniture:
            if n.tag in BLOCK:
                end()
                work.append((None, at))
                at = here
            work.extend((c, below(here, c.label) if isinstance(c, Node) else here) for c in reversed(n.children))
    end()
    return out


def read_page(page: str, paths: list[list[str | list[str]]] | None, template: frozenset[int] = frozenset()) -> str:
    """A page's main text by its host's regions, or by its own, without the host's template."""
    root = parse(page)
    whole = sum(len(b) for b in blocks(root)) if paths else 0
    own: list[list[str | list[str]]] | None = None
    most, best = -1, []
    for path in [*(paths or []), None]:
        if path is None or not (isinstance(path[-1] if path else "", list) or own):
            own = own or own_regions(infer(root))
        for p in own if path is None else [path]:
            if path is not None and (not path or (own and path not in own and around(path, own[0]))):
                continue  # all of the page, or the surroundings of its own region
            some = region_leaves(root, p)
            size = sum(len(b) for _, b in some)
            if size and paths and size >= SHARE * whole:
                return slots(some, template)
            if size > most:
                most, best = size, some
    return slots(best, template)


def block_id(leaf: int, text: str) -> int:
    """A block's text at its leaf, as a signed hash."""
    h = xxhash.xxh64_intdigest(text.encode("utf-8", "replace"), leaf)
    return h - (1 << 64) if h >> 63 else h


def slots(some: list[tuple[int, str]], template: frozenset[int]) -> str:
    return "\n".join(b for leaf, b in some if not template or block_id(leaf, b) not in template)


def host_of(url: str) -> F.Column:
    return F.coalesce(F.lower(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


PARTS = "host shape sizes path pages key ids leaves lengths".split()


def learned(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of hosts' wrappers (shape, sizes) and of layouts (path, pages), each over a part of the pages, and a page's blocks (key, ids, leaves, lengths)."""
    shapes: dict[str, dict[str, list[int]]] = {}
    layouts: Counter = Counter()
    texts: list[tuple] = []

    def rows() -> pd.DataFrame:
        none = (None, None, None, None)
        out = [(host, *flat(all_merged(found)), None, 0, *none) for host, found in shapes.items()] + [(host, None, None, path, n, *none) for (host, path), n in layouts.items()] + texts
        shapes.clear()
        layouts.clear()
        texts.clear()
        return pd.DataFrame({c: pd.Series(list(v), dtype=object) for c, v in zip(PARTS, zip(*out, strict=True), strict=True)})

    held = 0
    for b in batches:
        for host, page in zip(b["host"], b["page"], strict=True):
            root = parse(page)
            w = infer(root)
            of = shapes.setdefault(host, {})
            before = len(of)
            add(of, *flat(w))
            held += len(of) - before
            own = own_regions(w)
            layouts.update((host, json.dumps(path)) for path in own)
            some = [x for path in own for x in region_leaves(root, path)]
            ids = {block_id(leaf, b): (leaf - (1 << 64) if leaf >> 63 else leaf, len(b)) for leaf, b in some}
            texts.append((host, None, None, None, 0, block_id(0, " ".join(map(str, sorted(ids)))), list(ids), [x[0] for x in ids.values()], [x[1] for x in ids.values()]))
            if held >= HELD or len(texts) >= HELD:
                yield rows()
                held = 0
    if shapes:
        yield rows()


def wrappers(pages: DataFrame, url: str, page: str) -> DataFrame:
    """(of_host, paths, wrapper) for each host, from all of its pages; paths: its wrapper's region, then its layouts'."""
    rows = pages.where(F.col(page).isNotNull()).select(host_of(url).alias("host"), F.col(page).alias("page"))
    parts = written(rows.mapInPandas(learned, "host string, shape string, sizes array<long>, path string, pages long, key long, ids array<long>, leaves array<long>, lengths array<long>").withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(SALTS))))
    shape = "host string, shape string, sizes array<long>"

    def joined(group: pd.DataFrame) -> dict:
        found: dict[str, list[int]] = {}
        for shape, sizes in zip(group["shape"], group["sizes"], strict=True):
            add(found, shape, [int(x) for x in sizes])
        return all_merged(found)

    def partly(group: pd.DataFrame) -> pd.DataFrame:
        shape, sizes = flat(joined(group))
        return pd.DataFrame({"host": [group["host"].iat[0]], "shape": [shape], "sizes": [sizes]})

    def wholly(group: pd.DataFrame) -> pd.DataFrame:
        w = joined(group)
        return pd.DataFrame({"of_host": [group["host"].iat[0]], "path": [json.dumps(main_region(w))], "wrapper": [expression(w)]})

    merged = parts.where("shape is not null").select("host", "salt", "shape", "sizes").groupBy("host", "salt").applyInPandas(partly, shape)
    merged = merged.groupBy("host").applyInPandas(wholly, "of_host string, path string, wrapper string")
    layouts = parts.where("path is not null").groupBy("host", "path").agg(F.sum("pages").alias("pages")).where("pages > 1")  # a page alone has its own region
    layouts = layouts.groupBy("host").agg(F.array_sort(F.collect_list(F.struct((-F.col("pages")).alias("n"), "path"))).alias("found")).select("host", F.col("found.path").alias("layouts"))
    paths = F.array_distinct(F.concat(F.array("path"), F.coalesce("layouts", F.array().cast("array<string>"))))
    out = merged.join(layouts, F.col("of_host") == F.col("host"), "left").select("of_host", paths.alias("paths"), "wrapper")
    return out.join(templates(parts), F.col("of_host") == F.col("host"), "left").select("of_host", "paths", "wrapper", "template")


def templates(parts: DataFrame) -> DataFrame:
    """(host, template): the blocks that recur at their leaf on a host's distinct pages."""
    pages = parts.where("key is not null").select("host", "key", "ids", "leaves", "lengths").dropDuplicates(["host", "key"])
    found = pages.select("host", F.inline(F.arrays_zip("ids", "leaves", "lengths"))).groupBy("host", "leaves", "ids").agg(F.count("*").alias("n"), F.max("lengths").alias("length"))
    found = written(found)
    of_leaf = pages.select("host", F.explode(F.array_distinct("leaves")).alias("leaf")).groupBy("host", "leaf").agg(F.count("*").alias("held")).where(F.col("held") >= DISTINCT).withColumnRenamed("host", "leaf_host")
    same = found.where(F.col("n") >= DISTINCT).join(of_leaf, (F.col("host") == F.col("leaf_host")) & (F.col("leaves") == F.col("leaf"))).where(F.col("n") >= ALIKE * F.col("held"))
    same = same.groupBy("host").agg(F.collect_list("ids").alias("template"), F.sum(F.col("n") * F.col("length")).alias("size"))
    whole = found.groupBy(F.col("host").alias("whole_host")).agg(F.sum(F.col("n") * F.col("length")).alias("whole"))
    return same.join(whole, F.col("host") == F.col("whole_host")).where(F.col("size") <= 0.5 * F.col("whole")).select("host", "template")


def main_text(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row for each row of pages: page_id, url, text, n_chars (code points).

    A null or empty page gives the empty text. A null or odd url belongs to the host ''. Repeated rows are read alike;
    other columns aren't looked at; an empty table gives an empty one.
    """
    rows = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("page"))
    known = written(wrappers(rows, "url", "page"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts, known = [], {}
            for host, page, found, template in zip(b["host"], b["page"], b["paths"], b["template"], strict=True):
                if host not in known:
                    known[host] = [json.loads(p) for p in found] if found is not None else None, frozenset(map(int, template)) if template is not None else frozenset()
                texts.append(read_page(page, *known[host]) if isinstance(page, str) else "")
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts, "n_chars": [len(t) for t in texts]})

    kind = rows.schema["page_id"].dataType.simpleString()
    out = join_small(rows.withColumn("host", host_of("url")), known.select("of_host", "paths", "template"), F.col("host") == F.col("of_host"))
    return out.select("page_id", "url", "host", "page", "paths", "template").mapInPandas(read, f"page_id {kind}, url string, text string, n_chars long")
