"""Documents to records: format detection as columns, and one Arrow pass that parses a body into labelled cells.

The parsers are small: the standard library reads JSON, CSV, tags and deflate streams, the rest is regular expressions. Each gives
a list of records, a record being a list of (label, value). What needs no parser (flat JSON, HTML projections, text tables of
known shape) has native forms beside them.
"""

from __future__ import annotations

import csv
import io
import itertools
import json
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_hash, lower, trim
from . import tagsoup

MAX_BYTES = 32 * 1024 * 1024
DEEPEST = 64
Record = list[tuple[str, str]]
Json = dict | list | str | float | bool | None


def detect_format(content_type: Column, body: Column) -> Column:
    """pdf, json, html, csv or text: by magic, by what parses, by markers at the start, by content type, by delimiters."""
    head, kind = lower(F.substring(body, 1, 256)), lower(F.coalesce(content_type, F.lit("")))
    start = F.substring(trim(body), 1, 1)
    lines = F.slice(F.filter(F.split(body, "\n", -1), lambda x: trim(x) != ""), 1, 6)  # delimiters inside quotes count, too
    same = lambda sep: (F.size(lines) >= 2) & (F.size(F.array_distinct(F.transform(lines, lambda x: F.size(F.split(x, sep, -1))))) == 1) & (F.size(F.split(F.get(lines, F.lit(0)), sep, -1)) > 1)
    delimited = same(",") | same(";") | same("\t") | same(r"\|")
    return (
        F.when(body.isNull() | (F.octet_length(body) > MAX_BYTES), "unknown")
        .when(body.startswith("%PDF-"), "pdf")
        .when(start.isin("{", "[") & F.try_parse_json(body).isNotNull(), "json")
        .when(head.rlike("<!doctype html|<html|<head|<body|<table|<div"), "html")
        .when(kind.contains("html"), "html").when(kind.contains("json"), "json").when(kind.contains("csv"), "csv").when(kind.contains("pdf"), "pdf")
        .when(delimited, "csv").when(start == "<", "html").when(trim(body) == "", "unknown").otherwise("text")
    )


def fingerprint(kind: Column, container: Column, labels: Column) -> Column:
    """Structure of a document, whatever its rows."""
    return content_hash(F.concat_ws("|", kind, container, F.array_join(F.array_sort(labels), ",")))


# --- JSON


def flat(value: dict, prefix: str = "") -> Record:
    """Dotted labels; arrays of scalars joined; nulls dropped."""
    out: Record = []
    for k, v in value.items():
        if isinstance(v, dict):
            out += flat(v, f"{prefix}{k}.")
        elif isinstance(v, list):
            if (some := [scalar(x) for x in v if not isinstance(x, (dict, list)) and x is not None]):
                out.append((prefix + k, "; ".join(some)))
        elif v is not None:
            out.append((prefix + k, scalar(v)))
    return out


def scalar(v: Json) -> str:
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(int(v)) if float(v).is_integer() and abs(v) < 1e15 else f"{v:.10g}"
    return str(v)


def record_array(value: Json) -> list[dict]:
    """The array of objects that says most: features first, else the greatest product of records and mean width."""
    if isinstance(value, dict) and isinstance(value.get("features"), list) and all(isinstance(x, dict) for x in value["features"]):
        return [x.get("attributes", x) if isinstance(x.get("attributes", x), dict) else x for x in value["features"]]
    best: tuple[int, list[dict]] = (0, [])
    work = [value]
    while work:
        v = work.pop()
        if isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            score = len(v) * (sum(map(len, v)) // len(v))
            best = (score, v) if score > best[0] else best
        if isinstance(v, (dict, list)):
            work += [x for x in reversed(list(v.values() if isinstance(v, dict) else v)) if isinstance(x, (dict, list))]
    if not best[1] and isinstance(value, dict) and len(flat(value)) >= 2:
        return [value]
    return best[1]


def depth(value: Json) -> int:
    most, work = 0, [(value, 1)]
    while work:
        v, d = work.pop()
        if isinstance(v, (dict, list)):
            most = max(most, d)
            work += [(x, d + 1) for x in (v.values() if isinstance(v, dict) else v)]
    return most


def parse_json(body: str) -> list[Record]:
    value = json.loads(body)
    if depth(value) > DEEPEST:
        raise ValueError(f"nested more than {DEEPEST} deep")
    return [flat(x) for x in record_array(value)]


# --- delimited and fixed-width text


def numeric(cell: str) -> bool:
    digits = sum(c.isdigit() for c in cell)
    return bool(cell) and digits * 2 >= len(cell)


def parse_csv(body: str) -> list[Record]:
    first = re.sub(r'"[^"]*"', "", body.split("\n", 1)[0])
    sep = max(",;\t|", key=lambda s: (first.count(s), -",;\t|".index(s)))
    rows = [r for r in csv.reader(io.StringIO(body.replace("\r", "")), delimiter=sep) if r and not (len(r) == 1 and not r[0].strip())]
    if not rows:
        return []
    headed = len(rows) > 1 and not any(numeric(c.strip()) for c in rows[0])
    names = [c.strip() or f"col_{i}" for i, c in enumerate(rows[0])] if headed else [f"col_{i}" for i in range(len(rows[0]))]
    return [[(n, c.strip()) for n, c in zip(names, r)] for r in rows[1 if headed else 0 :]]


def parse_lines(lines: list[str]) -> list[Record]:
    """Columns parted by tabs or two spaces: rows of the commonest width, headed by its first row without numbers."""
    rows = [[c for c in re.split(r"\t+| {2,}", x.strip()) if c] for x in lines]
    votes = Counter(len(r) for r in rows if len(r) >= 2)
    width = min((w for w in votes if votes[w] == max(votes.values())), default=0)
    rows = [r for r in rows if len(r) == width]
    if not width or votes[width] < 3:
        return []
    at = next((i for i, r in enumerate(rows) if not any(map(numeric, r))), None)
    names = rows[at] if at is not None else [f"col_{i}" for i in range(width)]
    return [list(zip(names, r)) for i, r in enumerate(rows) if at is None or i > at]


# --- PDF


SHOW = re.compile(rb"\((?:\\.|[^\\()])*\)\s*(?:Tj|'|\")|\[(?:[^\]\\]|\\.)*\]\s*TJ|T\*|T[dDm]\b|BT\b")
STRING = re.compile(rb"\(((?:\\.|[^\\()])*)\)|(-?\d+(?:\.\d+)?)")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def pdf_lines(body: bytes) -> list[str]:
    """Text lines of a PDF's plain and deflated content streams; wide kerning parts columns."""
    if not body.startswith(b"%PDF-"):
        raise ValueError("not a PDF")
    lines: list[str] = []
    for m in re.finditer(rb"(?s)<<(.*?)>>\s*stream\r?\n(.*?)\r?\nendstream", body):
        if b"/Image" in m.group(1) or (b"/Filter" in m.group(1) and b"FlateDecode" not in m.group(1)):
            continue
        try:
            data = zlib.decompressobj().decompress(m.group(2)) if b"FlateDecode" in m.group(1) else m.group(2)
        except zlib.error:
            continue  # one corrupt stream leaves the others
        line = ""
        for op in SHOW.finditer(data):
            token = op.group()
            if token[:1] in b"([":
                for s, kern in STRING.findall(token):
                    line += "  " if kern and float(kern) < -180 else re.sub(rb"\\(.)", lambda x: ESCAPES.get(x.group(1), x.group(1)), s).decode("latin-1") if not kern else ""
            elif line.strip():
                lines.append(line)
                line = ""
        lines += [line] if line.strip() else []
    return lines


PARSERS = {"json": parse_json, "csv": parse_csv, "html": tagsoup.records, "text": lambda b: parse_lines(b.split("\n")), "pdf": lambda b: parse_lines(pdf_lines(b if isinstance(b, bytes) else b.encode("latin-1", "replace")))}


CELL_TYPE = "record long, label_ord int, label string, value string, error string"


def cells_of(kind: str | None, body: str | bytes | None) -> list[tuple]:
    """(record, label_ord, label, value, error) of one body: its cells, or a row that says why there are none."""
    if isinstance(body, (bytes, bytearray)):
        body = bytes(body) if kind == "pdf" else bytes(body).decode("utf-8", "replace")
    try:
        records, error = PARSERS[kind](body) if kind in PARSERS else [], None
    except (ValueError, RecursionError, zlib.error, csv.Error) as e:
        records, error = [], str(e)[:200]
    order: dict[str, int] = {}
    rows = [(i, order.setdefault(k, len(order)), k, v, None) for i, r in enumerate(records) for k, v in r]
    return rows or [(None, None, None, None, error or "no records")]


#: Cells that go back to Spark at once: a batch has thousands of bodies, whose cells together would fill a worker's memory.
CELLS_AT_ONCE = 20_000


def cell_frames(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Cells of the batches' bodies, all of them, CELLS_AT_ONCE in a frame at most."""
    names = ["source_id", "format", "record", "label_ord", "label", "value", "error"]
    each = ((source, kind, *cell) for batch in batches for source, kind, body in zip(batch["source_id"], batch["format"], batch["body"], strict=True) for cell in cells_of(kind, body))
    while some := list(itertools.islice(each, CELLS_AT_ONCE)):
        yield pd.DataFrame(some, columns=names).astype({"record": "Int64", "label_ord": "Int32"})


def parse_documents(docs: DataFrame) -> DataFrame:
    """docs (source_id, content_type, body) as cells (source_id, format, record, label_ord, label, value, error).

    body: text, or binary as files and responses have it; a PDF's bytes reach its reader as they are, others are read as UTF-8.
    A body that can't be parsed gives one row with an error and no cell. label_ord is the place of a label's first appearance.
    """

    if dict(docs.dtypes)["body"] == "binary":
        large = F.octet_length("body") > MAX_BYTES
        shown = F.when(~large, F.decode(F.col("body"), "ISO-8859-1"))  # no byte fails: PDFs are told by their first ones
        typed = docs.withColumn("format", F.when(shown.startswith("%PDF-"), "pdf").otherwise(detect_format(F.col("content_type"), F.when(~large, F.try_validate_utf8(F.col("body").cast("string"))))))
        typed = typed.select("source_id", "format", "body")
    else:
        typed = docs.withColumn("format", detect_format(F.col("content_type"), F.col("body"))).select("source_id", "format", "body")
    return typed.mapInPandas(cell_frames, f"source_id string, format string, {CELL_TYPE}")


# --- native projections


def script_shell(body: Column) -> Column:
    """Whether a page is a shell that scripts fill: framework markers, or four times as much script as text."""
    script = F.array_join(F.regexp_extract_all(body, F.lit(r"(?is)<script\b[^>]*>(.*?)</script\s*>"), 1), "")
    bare = F.regexp_replace(F.regexp_replace(body, r"(?is)<(script|style)\b.*?</\1\s*>", ""), r"(?s)<[^>]*>", "")
    marks = F.lower(body).rlike("id=\"(root|app|__next)\"\\s*>\\s*</div>|data-reactroot|ng-app")
    return marks | (F.octet_length(trim(bare)) * 4 < F.octet_length(script))


def page_projection(body: Column) -> Column:
    """struct<title, headings, links, items>: what a page shows without a tree of it."""
    squeeze = lambda c: trim(F.regexp_replace(F.regexp_replace(c, r"(?s)<[^>]*>", " "), r"\s+", " "))
    heads = F.transform(F.regexp_extract_all(body, F.lit(r"(?is)<h[1-6]\b[^>]*>(.*?)</h[1-6]>"), 1), squeeze)
    links = F.array_distinct(F.regexp_extract_all(body, F.lit(r"""(?is)<a\b[^>]*\bhref\s*=\s*["']([^"'#]+)"""), 1))
    return F.struct(squeeze(F.regexp_extract(body, r"(?is)<title\b[^>]*>(.*?)</title>", 1)).alias("title"), heads.alias("headings"), links.alias("links"), F.size(F.regexp_extract_all(body, F.lit(r"(?i)<li\b"), 0)).alias("items"))


def fetch_mode(url: Column, content_type: Column, body: Column) -> Column:
    """How a fetched body is taken: rendered if it was asked for, api and document by content type, html; shell for a page that only a
    browser could fill (local files are taken as they are)."""
    kind, shell = lower(F.coalesce(content_type, F.lit(""))), F.coalesce(script_shell(body), F.lit(False))
    local = ~F.coalesce(url.rlike("^(render\\+)?https?://"), F.lit(False))
    return F.when(url.startswith("render+"), "rendered").when(kind.rlike("json|csv|xml"), "api").when(kind.contains("pdf"), "document").when(shell & ~local, "shell").otherwise("html")
