"""Ranked lexical search by best-first document intervals over posting lists with range-maximum sparse tables.

1. One pass over all texts keeps of each document its number of terms and the frequencies of the terms that some item
   asks for. Sums over that table give the number of documents, of terms, and each asked term's document frequency.
2. Each task turns its documents into shards of POSTINGS postings. A shard orders its documents by identifier and holds one
   posting list for each asked term, with the impact (weight times damped frequency) of every posting and a sparse
   table over the lists: the place of the largest impact in any window of 2 ** j postings, so that the maximum over
   any range of a list is read from two cells.
3. An item's search starts from the interval of all documents of the shard. The sum over its terms of the lists' maxima
   within an interval bounds every score there. The intervals with the highest bounds are taken first and split at
   the document that holds their largest impact: that document is scored exactly, both sides get bounds of their own. Intervals of
   at most LEAF documents are scored whole. Intervals whose bound can't reach the item's last place are dropped, which loses
   nothing. A task carries an item's best documents from shard to shard, so later shards start with a high bar.
4. The best of each task meet in one window for each item (tasks * top rows at most, cut before the shuffle).

The items go to the tasks in blocks of bounded size; each block is one pass over the documents. No posting is shuffled:
a shard is built where its documents are read, so that a frequent term is split over all tasks.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .text import written

#: What isn't in a term, as ranges of ASCII; the same for UTF-8 bytes that were lower-cased as bytes (A-Z only).
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERM_BYTES = re.compile(rb"[0-9a-z\x80-\xff]+")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Postings of a shard; documents of an interval that is scored whole; intervals that are split together.
POSTINGS, LEAF, TOGETHER = 1_000_000, 64, 64
#: Bytes of item terms that one pass ships to the tasks.
ITEM_BYTES = 32_000_000


def weight(documents: int, holding: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


def counted(batches: Iterator[pa.RecordBatch], asked: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """(id, text) to (id, n, terms, tfs): all terms counted, the asked ones by number."""
    for batch in batches:
        n, ends, terms, tfs = [], [0], [], []
        for text in batch.column(1):
            found = TERM_BYTES.findall(t.lower()) if (t := text.as_buffer() and text.as_buffer().to_pybytes()) else []
            n.append(len(found))
            for term, tf in Counter(found).items():
                if (k := asked.get(term)) is not None:
                    terms.append(k)
                    tfs.append(tf)
            ends.append(len(terms))
        lists = lambda x: pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x, pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists(terms), lists(tfs)], ["id", "n", "terms", "tfs"])


class Best:
    """An item's best documents so far: highest score first, equal scores by identifier, null last."""

    def __init__(self, top: int):
        self.top, self.rows = top, []

    def bar(self) -> tuple[int, float]:
        """The last place's score and identifier, as soon as all places are taken."""
        return (-self.rows[-1][0], self.rows[-1][1]) if len(self.rows) == self.top else (0, -math.inf)

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        score, _ = self.bar()
        keep = np.flatnonzero(scores >= max(score, 1))
        if len(keep):
            self.rows = heapq.nsmallest(self.top, self.rows + [(-int(s), float("inf") if i is None else i) for s, i in zip(scores[keep], ids[keep])])


class Shard:
    """Posting lists over documents in order of their identifiers, with sparse tables of the largest impacts."""

    def __init__(self, ids: list, lengths: np.ndarray, ends: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, documents: int, total: int):
        order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0)), np.int64)
        self.ids, self.n_docs = np.array(ids, object)[order], len(ids)
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        doc = np.repeat(place, np.diff(ends))
        key = terms.astype(np.int64) * (self.n_docs + 1) + doc
        by = np.argsort(key, kind="stable")
        self.key, self.doc, tf = key[by], doc[by], tfs[by].astype(np.int64)
        damp = 10 + (90 * lengths.astype(np.int64) * documents) // total
        held = np.repeat(damp, np.diff(ends))[by]
        self.impact = weights[terms[by]] * ((1_000_000_000 * tf) // (1000 * tf + 8 * held))
        self.table = [np.arange(len(by), dtype=np.int32)]
        longest = int(np.bincount(terms).max()) if len(terms) else 0
        while 2 << (len(self.table) - 1) <= longest:  # of two equal maxima the left one: copies are split a quarter in, not at their edge
            last, half = self.table[-1], 1 << (len(self.table) - 1)
            a, b = last[:-half], last[half:]
            inner = a if len(self.table) % 2 else b
            cut = np.where(self.impact[a] > self.impact[b], a, np.where(self.impact[a] < self.impact[b], b, inner))
            self.table.append(cut)

    def at(self, terms: np.ndarray, docs: np.ndarray) -> np.ndarray:
        """(intervals, terms): where each list reaches a document."""
        return np.searchsorted(self.key, terms[None, :] * (self.n_docs + 1) + docs[:, None])

    def largest(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Range maxima of lists: for each interval the sum of them, and the document that holds the largest."""
        size = hi - lo
        level = np.frexp(np.maximum(size, 1))[1] - 1
        a, b = np.zeros(lo.shape, np.int64), np.zeros(lo.shape, np.int64)
        for j in np.unique(level[size > 0]):
            m = (level == j) & (size > 0)
            a[m], b[m] = self.table[j][lo[m]], self.table[j][hi[m] - (1 << int(j))]
        best = np.where(self.impact[a] >= self.impact[b], a, b)
        value = np.where(size > 0, self.impact[best], -1)
        top = value.argmax(1)
        return np.maximum(value, 0).sum(1), self.doc[best[np.arange(len(best)), top]]

    def whole(self, docs: np.ndarray, width: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """(intervals, width): exact scores of all documents of short intervals."""
        size = (hi - lo).ravel()
        p = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo.ravel(), size)
        row = np.repeat(np.arange(len(docs)), (hi - lo).sum(1))
        return np.bincount(row * width + self.doc[p] - docs[row], self.impact[p].astype(float), len(docs) * width).astype(np.int64).reshape(-1, width)

    def search(self, terms: np.ndarray, best: Best) -> None:
        lists = np.searchsorted(self.key, np.stack([terms, terms + 1]) * (self.n_docs + 1))
        terms = terms[lists[0] < lists[1]]
        if not len(terms):
            return
        lo, hi = self.at(terms, np.array([0])), self.at(terms, np.array([self.n_docs]))
        bound, split = self.largest(lo, hi)
        heap = [(-int(bound[0]), 0, self.n_docs, int(split[0]), lo[0], hi[0])]
        while heap:
            taken = []
            while heap and len(taken) < TOGETHER:
                score, last = best.bar()
                b, start, stop, cut, lo, hi = heapq.heappop(heap)
                if -b < max(score, 1):
                    heap.clear()
                    break
                first = self.ids[start]
                if -b > score or (math.inf if first is None else first) < last:  # an equal score needs a smaller identifier
                    taken.append((start, stop, cut, lo, hi))
            small = [x for x in taken if x[1] - x[0] <= LEAF]
            large = [x for x in taken if x[1] - x[0] > LEAF]
            if small:
                docs = np.array([x[0] for x in small])
                scores = self.whole(docs, LEAF, np.stack([x[3] for x in small]), np.stack([x[4] for x in small]))
                row, col = np.nonzero(scores)
                best.add(scores[row, col], self.ids[docs[row] + col])
            if large:
                cut, lo, hi = np.array([x[2] for x in large]), np.stack([x[3] for x in large]), np.stack([x[4] for x in large])
                left, right = self.at(terms, cut), self.at(terms, cut + 1)
                best.add(np.where(right > left, self.impact[np.minimum(left, len(self.impact) - 1)], 0).sum(1), self.ids[cut])
                for a, b, starts, stops in ((lo, left, [x[0] for x in large], cut), (right, hi, cut + 1, [x[1] for x in large])):
                    bound, split = self.largest(a, b)
                    floor = max(best.bar()[0], 1)
                    for i in np.flatnonzero(bound >= floor):
                        heapq.heappush(heap, (-int(bound[i]), int(starts[i]), int(stops[i]), int(split[i]), a[i], b[i]))


def searched(batches: Iterator[pa.RecordBatch], items: list[tuple], weights: np.ndarray, documents: int, total: int, top: int, item_type: pa.DataType, postings: int) -> Iterator[pa.RecordBatch]:
    """Counted documents to each item's best ones among them: (item_id, doc_id, score)."""
    best = [Best(top) for _ in items]
    ids, lengths, terms, tfs, sizes = [], [], [], [], []

    def close() -> None:
        if terms:
            shard = Shard(ids, np.array(lengths, np.int64), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), np.concatenate(terms), np.concatenate(tfs), weights, documents, total)
            for (_, asked), b in zip(items, best):
                shard.search(asked, b)
        for x in (ids, lengths, terms, tfs, sizes):
            x.clear()

    id_type = None
    for batch in batches:
        id_type = batch.column(0).type
        at, ends = 0, batch.column(2).offsets.to_numpy()
        while at < batch.num_rows:
            held = sum(map(len, terms))
            to = max(at + 1, int(np.searchsorted(ends, ends[at] + postings - held, "right")) - 1)
            part = batch.slice(at, to - at)
            ids.extend(part.column(0).to_pylist())
            lengths.extend(part.column(1).to_pylist())
            sizes.append(np.diff(ends[at : to + 1]))
            terms.append(part.column(2).flatten().to_numpy())
            tfs.append(part.column(3).flatten().to_numpy())
            at = to
            if sum(map(len, terms)) >= postings or len(ids) >= postings:
                close()
    close()
    rows = [(item, None if i == math.inf else i, -s) for (item, _), b in zip(items, best) for s, i in b.rows]
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], item_type), pa.array([r[1] for r in rows], id_type), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])


def search(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", top: int = 10) -> DataFrame:
    """Each item's `top` documents with a score above 0: item_id, rank, doc_id, score.

    Identifiers of documents are integers; equal scores go by identifier, null last. Every row of docs is a document of
    its own, also if it repeats another; rows of items with one identifier are one item that asks for the terms of all
    of them. Null and empty texts have no terms: such documents don't count, such items return no row. Texts are taken
    whole at any length. Other columns aren't looked at. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    item_field, id_field = T.StructField("item_id", items.schema[item_col].dataType), T.StructField("doc_id", docs.schema[id_col].dataType)
    lowered = F.translate(F.col(f"`{item_text_col}`").cast("string"), UPPER, LOWER)
    asked = items.select(F.col(f"`{item_col}`").alias("item_id"), F.explode(F.regexp_extract_all(lowered, F.lit(TERM), F.lit(0))).alias("term")).distinct()
    asked = written(asked)
    size = asked.agg(F.sum(F.octet_length("term") + 8)).first()[0] or 0
    blocks = max(1, math.ceil(size / ITEM_BYTES))
    found = [best_of_block(docs, asked.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b), id_col, text_col, top, item_field, id_field) for b in range(blocks)] if size else []
    schema = T.StructType([item_field, T.StructField("rank", T.IntegerType()), id_field, T.StructField("score", T.LongType())])
    out = spark.createDataFrame([], schema)
    for f in found:
        place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
        out = out.unionByName(f.withColumn("rank", place).where(F.col("rank") <= top).select("item_id", "rank", "doc_id", "score"))
    return out


def best_of_block(docs: DataFrame, asked: DataFrame, id_col: str, text_col: str, top: int, item_field: T.StructField, id_field: T.StructField) -> DataFrame:
    """The best documents of each task for a block of items."""
    rows = asked.groupBy("item_id").agg(F.collect_list("term").alias("terms")).collect()
    numbers = {t: k for k, t in enumerate(sorted({t for r in rows for t in r["terms"]}))}
    number_of = {t.encode(): k for t, k in numbers.items()}
    items = [(r["item_id"], np.array(sorted(numbers[t] for t in r["terms"]), np.int64)) for r in rows]
    schema = T.StructType([T.StructField("id", id_field.dataType), T.StructField("n", T.LongType()), T.StructField("terms", T.ArrayType(T.IntegerType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))])
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    table = written(texts.mapInArrow(lambda b: counted(b, number_of), schema).where("n > 0"))
    documents, total = table.agg(F.count("*"), F.sum("n")).first()
    holding = dict(table.select(F.explode("terms").alias("term")).groupBy("term").count().collect())  # as many rows as the block has terms
    weights = np.array([weight(documents, holding.get(k, 0)) for k in range(len(numbers))], np.int64)
    item_type, postings = to_arrow_type(item_field.dataType), POSTINGS
    out = T.StructType([item_field, id_field, T.StructField("score", T.LongType())])
    return table.where(F.size("terms") > 0).mapInArrow(lambda b: searched(b, items, weights, documents, total or 1, top, item_type, postings), out)
