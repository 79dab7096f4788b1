"""Words in blocks of whole documents: counted, and scored, where their documents lie.

Each different word of a block goes out once, with the block's counts, and comes back once, with those of all blocks. What is
shuffled grows with the number of blocks, not with the classes that each word of each document meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import written

#: Bytes of text and rows of bags that make a block, cells of a table of weights, and words that are scored at a time.
BYTES, ROWS, CELLS, AT_ONCE = 12 << 20, 1_000_000, 1_000_000, 50_000


def of_texts(docs: DataFrame, tokens: Column, text: Column) -> DataFrame:
    """Blocks of docs (doc, class): see `coded`. The texts are shuffled, once, and not their words."""
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    dealt = docs.select("doc", "class", text.alias("text")).repartition(blocks(docs, size / BYTES), "doc")
    each = dealt.withColumn("tokens", tokens).withColumn("ns", F.lit(None).cast("array<long>"))
    return coded(each.select("doc", "class", "tokens", "ns"))


def of_bags(bag: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of bags (doc, class, token, n) and of examples (doc, class) without words."""
    bare = labels.select("doc", "class", F.lit(None).cast("string").alias("token"), F.lit(None).cast("long").alias("n"))
    rows = bag.select("doc", "class", "token", "n").unionByName(bare).repartition(blocks(bag, bag.count() / ROWS), "doc")
    return coded(rows.groupBy("doc", "class").agg(F.collect_list("token").alias("tokens"), F.collect_list("n").alias("ns")))


def blocks(df: DataFrame, needed: float) -> int:
    return max(int(needed) + 1, df.sparkSession.sparkContext.defaultParallelism)


def coded(each: DataFrame) -> DataFrame:
    """A table of blocks, one for each partition of each (doc, class, tokens, ns: how often, null: once), which holds documents whole. It has
    two kinds of rows: words (block, word, token, df, hits array<struct<class, hits>>) and examples (block, doc, class, words, counts)."""
    doc, kind = each.schema["doc"].dataType.simpleString(), each.schema["class"].dataType.simpleString()
    schema = f"block long, word int, token string, df long, hits array<struct<class: {kind}, hits: long>>, doc {doc}, class {kind}, words array<int>, counts array<int>"
    return written(each.mapInArrow(counted, schema))


def words(table: DataFrame) -> DataFrame:
    return table.where("word is not null").select("block", "word", "token", "df", "hits")


def examples(table: DataFrame) -> DataFrame:
    return table.where("word is null").select("block", "doc", "class", "words", "counts")


def codes(column: pa.ChunkedArray) -> tuple[np.ndarray, pa.Array]:
    """Each value's place among the different ones, nulls included, and these."""
    if not column.num_chunks:
        return np.zeros(0, np.int64), pa.array([], column.type)
    whole = pa.chunked_array([pa.concat_arrays(column.chunks)]) if column.null_count else column  # Arrow can't unify dictionaries with nulls
    coded = pc.dictionary_encode(whole, null_encoding="encode")
    coded = coded if coded.num_chunks == 1 else coded.unify_dictionaries()
    return np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in coded.chunks]).astype(np.int64), coded.chunk(0).dictionary


def starts(of: np.ndarray, groups: int) -> np.ndarray:
    """Offsets of the groups in a sorted array of their numbers."""
    return np.searchsorted(of, np.arange(groups + 1)).astype(np.int32)


def lists(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of one block, see `coded`."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t, block = pa.Table.from_batches(parts), TaskContext.get().partitionId()
    doc, docs = codes(t["doc"])
    kind, kinds = codes(t["class"])
    _, first, example = np.unique(doc * len(kinds) + kind, return_index=True, return_inverse=True)
    doc, kind = doc[first], kind[first]
    lengths, each = pc.fill_null(pc.list_value_length(t["tokens"]), 0).to_numpy(), None if t["ns"].null_count == t.num_rows else pc.list_flatten(t["ns"]).to_numpy()
    pair, tokens = codes(pc.list_flatten(t["tokens"]))
    del parts, t  # the texts' words are no longer held
    # numbers of words by their order: the same if a block is computed again and its rows come in another order
    order = pc.sort_indices(tokens).to_numpy()
    place, tokens = np.empty(len(order), np.int64), tokens.take(pa.array(order))
    place[order] = np.arange(len(order))
    pair = place[pair]
    pair += np.repeat(example * len(tokens), lengths)
    if each is None:
        pair.sort()
        heads = np.flatnonzero(np.concatenate([np.ones(min(len(pair), 1), bool), pair[1:] != pair[:-1]]))
        pair, n = pair[heads], np.diff(heads, append=len(pair))
    else:
        pair, at = np.unique(pair, return_inverse=True)
        n = np.zeros(len(pair), np.int64)
        np.add.at(n, at, each)
    at, word = np.divmod(pair, max(len(tokens), 1))
    seen = np.unique(doc[at] * len(tokens) + word) % max(len(tokens), 1) if len(docs) < len(doc) else word
    df = np.bincount(seen, minlength=len(tokens))
    hit, of = np.unique(word * len(kinds) + kind[at], return_inverse=True)
    hits = np.zeros(len(hit), np.int64)
    np.add.at(hits, of, n)
    word, n = word.astype(np.int32), n.astype(np.int32)
    by_class = pa.StructArray.from_arrays([kinds.take(pa.array(hit % len(kinds))), pa.array(hits)], ["class", "hits"])
    vocabulary = {
        "word": pa.array(np.arange(len(tokens)), pa.int32()), "token": tokens, "df": pa.array(df, pa.int64()), "hits": lists(by_class, starts(hit // len(kinds), len(tokens))),
    }
    ends = starts(at, len(doc))
    texts = {"doc": docs.take(pa.array(doc)), "class": kinds.take(pa.array(kind)), "words": lists(pa.array(word, pa.int32()), ends), "counts": lists(pa.array(n, pa.int32()), ends)}
    names = ["block", *vocabulary, *texts]
    types = {k: v.type for k, v in (vocabulary | texts).items()}
    del pair, at, word, n, seen, hit, of, hits
    for part, most in ((vocabulary, 20_000), (texts, 1_000)):
        rows = len(next(iter(part.values())))
        columns = [pa.array(np.full(rows, block), pa.int64()), *[part.get(k, pa.nulls(rows, types[k])) for k in names[1:]]]
        yield from pa.Table.from_arrays(columns, names).to_batches(most)


def scored(table: DataFrame, model: DataFrame, totals: Sequence[tuple[Any, int, int]], vocabulary: int, all_docs: int, alphas: Sequence[float]) -> DataFrame:
    """(doc, truth, class, scores): log odds of each example of a table of blocks under the model without it, one for each smoothing constant.
    model: (token, hits array<long>) of words that more than one document has, as hits * number of classes + the class's place in totals
    (class, docs, tokens)."""
    doc, kind = table.schema["doc"].dataType.simpleString(), table.schema["class"].dataType.simpleString()
    known = words(table).select("block", "word", "token").join(model, "token").select(F.col("block").alias("of"), "word", "hits")
    each = examples(table).groupBy("block").cogroup(known.groupBy("of"))
    return each.applyInArrow(scorer(totals, vocabulary, all_docs, alphas), f"doc {doc}, truth {kind}, class {kind}, scores array<double>")


def scorer(totals: Sequence[tuple[Any, int, int]], vocabulary: int, all_docs: int, alphas: Sequence[float]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    classes, docs, tokens = ([t[i] for t in totals] for i in range(3))
    docs, tokens = np.array(docs, np.float64), np.array(tokens, np.float64)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        named = pa.array(classes, texts.schema.field("class").type)
        truth = pc.fill_null(pc.index_in(texts["class"], value_set=named), -1).to_numpy()
        doc, different = codes(texts["doc"])
        lengths = pc.list_value_length(texts["words"]).to_numpy()
        word, n = pc.list_flatten(texts["words"]).to_numpy(), pc.list_flatten(texts["counts"]).to_numpy().astype(np.float64)
        at = np.repeat(np.arange(len(doc)), lengths)
        hits, place = np.divmod(pc.list_flatten(known["hits"]).to_numpy(), max(len(classes), 1))
        entries = (np.repeat(known["word"].to_numpy(), pc.list_value_length(known["hits"]).to_numpy()), place, hits)
        size = int(word.max(initial=-1)) + 1
        elsewhere = np.zeros(size, bool)
        elsewhere[known["word"].to_numpy()] = True
        sums = lambda x: np.bincount(doc[at], weights=x, minlength=len(different))[doc]
        own, met, lone = sums(n), sums(n * elsewhere[word]), sums(~elsewhere[word])
        held = truth[:, None] == np.arange(len(classes))
        left = docs - held
        out = np.empty((len(doc), len(classes), len(alphas)))
        lifts = lifted(entries, word, n, at, truth, size, len(classes), alphas, len(doc))
        if len(different) < len(doc):  # a document under several classes
            whole = np.zeros((len(different), *lifts.shape[1:]))
            np.add.at(whole, doc, lifts)
            lifts = whole[doc]
        with np.errstate(divide="ignore", invalid="ignore"):
            for i, a in enumerate(alphas):
                denominator = tokens - held * own[:, None] + a * (vocabulary - lone)[:, None]
                absent = np.where(met[:, None] > 0, met[:, None] * np.log(a / denominator), 0.0)
                out[:, :, i] = np.log(left / (all_docs - 1)) + absent + lifts[:, :, i]
        row, place = np.nonzero((left > 0) & (truth[:, None] >= 0))
        scores = pa.array(out[row, place].ravel(), pa.float64())
        picked = [texts["doc"].take(pa.array(row)), texts["class"].take(pa.array(row)), named.take(pa.array(place))]
        return pa.Table.from_arrays([*picked, lists(scores, np.arange(len(row) + 1) * len(alphas))], ["doc", "truth", "class", "scores"])

    return score


def lifted(entries: tuple[np.ndarray, ...], word: np.ndarray, n: np.ndarray, at: np.ndarray, truth: np.ndarray, size: int, classes: int, alphas: Sequence[float], examples: int) -> np.ndarray:
    """[example, class, constant]: sums of n * ln((hits + alpha) / alpha), an example's own words taken from the hits of its class.
    entries: word, class and hits of the words known. Classes are taken a few at a time, so that the tables of weights stay small."""
    out, (of, place, hits) = np.zeros((examples, classes, len(alphas))), entries
    few = max(1, CELLS // max(size, 1))
    cuts = np.searchsorted(at, np.arange(examples))  # examples without words begin where the next one does
    filled = np.flatnonzero(np.diff(np.append(cuts, len(at))))
    parts = np.split(filled, np.flatnonzero(np.diff(cuts[filled] // AT_ONCE)) + 1) if len(filled) else []
    for low in range(0, classes, few):
        here, wide = (place >= low) & (place < low + few), min(few, classes - low)
        table = np.zeros((size, wide))
        mine = np.flatnonzero((truth[at] >= low) & (truth[at] < low + few))
        table[of[here], place[here] - low] = hits[here]
        rest = table[word[mine], truth[at[mine]] - low]
        mine, rest = mine[rest > 0], (rest - n[mine])[rest > 0]
        for i, a in enumerate(alphas):
            table[of[here], place[here] - low] = np.log((hits[here] + a) / a)
            for part in parts:
                first, last = cuts[part[0]], cuts[part[-1] + 1] if part[-1] + 1 < examples else len(at)
                out[part, low : low + wide, i] = np.add.reduceat(table[word[first:last]] * n[first:last, None], cuts[part] - first)
            own = np.bincount(at[mine], weights=n[mine] * np.log((rest + a) / a), minlength=examples)
            one = np.flatnonzero((truth >= low) & (truth < low + few))
            out[one, truth[one], i] = own[one]
    return out
