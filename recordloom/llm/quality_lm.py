"""Quality classifier: an interpolated modified Kneser-Ney model of trusted text, perplexity bands by language.

The model has word pairs over words over spellings (the pairs can be switched off). Its lowest order spells a word by characters, folded to an alphabet of 32
symbols (Latin letters without accents, one symbol each for capitals, digits, white space, punctuation, other marks, other
letters) with ORDER symbols to a gram, so it gives any word a probability and has 32 ** ORDER rows at most. Counts of words and
pairs grow with the trusted text and have no bound; they stay tables: continuation counts, count-of-counts discounts and
interpolation weights of each order are joins and aggregations of them.

An interpolated model is a sum over a text's grams in logarithms: the spelling of each word, plus a weight of each word and each
pair that the model knows. So a document's perplexity is one join of (gram, document, times) with (gram, weight), sharded by the
gram's hash, and a sum. Texts ask in blocks: a block sends each shard its grams there, sorted, as gaps in as few bytes as they need, with
the texts that hold them, and gets back a sum for each text. Two tables of fixed size keep that join small and even. The weights of the most
frequent grams (HOT at most) are shipped to the tasks, so no frequent word is a hot key; and a bitmap of the others (2 **
BITMAP bits) lets tasks leave out grams that the model surely lacks, whose weight is none. Neither changes a result. Blocks are numbered by
partition, so texts have to come from a table (a scan), which deals them out alike if a task is run again.

A text's own words and pairs make it likely, so a third of the trusted documents is held out from counting: the upper bounds are quantiles of
these, the lower ones of all trusted documents.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import count

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import BROADCAST_IDS, M1, drop_written, join_small, mix64, shuffles_removed, spans, written

ORDER, BITS = 4, 5
SYMBOLS = 1 << BITS
SPACE, CAPITAL, DIGIT, POINT, MARK, LETTER = range(26, 32)
CHUNK = 4_000_000

#: Most frequent grams that every task has, at most; bits of the bitmap of the others, as a power of two, and a gram's places there.
HOT, BITMAP, PLACES = 1 << 22, 27, 2
#: Words whose codes are short and whose facts are broadcast, at most; the highest bit, which other words' codes have.
COMMON, RARE = 1 << 17, np.uint64(1 << 63)
#: Characters of a block of texts; weights that are packed together; weights of a shard, on average.
BLOCK, PACKED, SHARD = 8_000_000, 1_000_000, 500_000
#: Places of a text's start and end among its words, and the logarithm of the share that ends have in the spelling model.
START, END, STOP = 0, 1, -10.0
#: What stands for the second word where a word is by itself.
ALONE = -1
#: One in so many trusted documents is held out.
FOLDS = 3


def symbol(c: str) -> int:
    if c.isspace() or unicodedata.category(c) in ("Cc", "Cf"):
        return SPACE
    base = unicodedata.normalize("NFKD", c)[0]
    if base.isascii() and base.isalpha():
        return CAPITAL if base.isupper() else ord(base) - 97
    kind = unicodedata.category(c)
    return CAPITAL if kind == "Lu" else LETTER if kind[0] in "LM" else DIGIT if kind[0] == "N" else POINT if c in ".,;:!?'\"()-" else MARK


#: Symbols of the first 0x3000 code points; later ones count as other letters.
TABLE = np.array([LETTER if 0xD800 <= i < 0xE000 else symbol(chr(i)) for i in range(0x3000)], np.uint8)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all grams of the texts, each symbol with the ORDER - 1 before it (white space before the first), and lengths."""
    pad = " " * (ORDER - 1)
    lengths = np.fromiter((len(t) if t else 0 for t in texts), np.int64, len(texts))
    points = np.frombuffer("".join(pad + (t or "") for t in texts).encode("utf-32-le", "replace"), np.uint32)
    s = np.where(points < len(TABLE), TABLE[np.minimum(points, len(TABLE) - 1)], LETTER).astype(np.int32)
    code = np.zeros(max(0, len(s) - ORDER + 1), np.int32)
    for i in range(ORDER):
        code = (code << BITS) | s[i : len(s) - ORDER + 1 + i]
    ends = np.cumsum(lengths + ORDER - 1)
    at = np.arange(int(lengths.sum())) + np.repeat(ends - lengths - (ORDER - 1) - (np.cumsum(lengths) - lengths), lengths)
    return code[at], lengths


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    total = np.zeros(SYMBOLS**ORDER, np.int64)
    for batch in batches:
        for rows in spans(batch["text"], CHUNK):
            codes, _ = grams([t if isinstance(t, str) else None for t in batch["text"].iloc[rows]])
            total += np.bincount(codes, minlength=len(total))
    seen = np.flatnonzero(total)
    yield pd.DataFrame({"g": seen.astype("int32"), "c": total[seen]})


def discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney discounts for counts of one, two, and three or more (Chen and Goodman, 1999)."""
    n = [float(x or 0) for x in counts.agg(*[F.sum((F.col("c") == i).cast("long")) for i in range(1, 5)]).first()]
    if not all(n):
        return [0.5, 0.75, 0.9]  # too few grams to tell
    y = n[0] / (n[0] + 2 * n[1])
    return [min(max(d, 0.05), i - 0.05) for i, d in ((1, 1 - 2 * y * n[1] / n[0]), (2, 2 - 3 * y * n[2] / n[1]), (3, 3 - 4 * y * n[3] / n[2]))]


def interpolated(top: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The model from counts (g, c) of the grams that occur, as (g, part), (context, weight) and (g, p): a gram's probability
    is its discounted part, none if it doesn't occur, and the weight of its context (one, if that doesn't occur) times the
    probability of the gram less its first symbol. The last table holds these, for all SYMBOLS ** (ORDER - 1) of them."""
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: how many symbols come before it
        orders[k] = written(orders[k + 1].groupBy((F.col("g") % (SYMBOLS**k)).alias("g")).agg(F.count("*").alias("c")))

    def cut_and_contexts(k: int) -> tuple[F.Column, DataFrame]:
        d = discounts(orders[k])
        cut = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
        context = F.floor(F.col("g") / SYMBOLS).cast("int").alias("context")
        return cut, orders[k].groupBy(context).agg(F.sum("c").alias("total"), F.sum(cut).alias("left"))

    lower: DataFrame | None = None
    for k in range(1, ORDER):
        cut, of = cut_and_contexts(k)
        every = top.sparkSession.range(SYMBOLS**k).select(F.col("id").cast("int").alias("g"), F.floor(F.col("id") / SYMBOLS).cast("int").alias("context"), (F.col("id") % (SYMBOLS ** (k - 1))).cast("int").alias("shorter"))
        rows = every.join(orders[k].select(F.col("g").cast("int").alias("g"), "c"), "g", "left").join(of, "context", "left")
        rows = rows.join(lower, "shorter") if lower is not None else rows.withColumn("q", F.lit(1 / SYMBOLS))
        p = F.when(F.col("total").isNull(), F.col("q")).otherwise(F.coalesce(F.col("c") - cut, F.lit(0.0)) / F.col("total") + F.col("left") / F.col("total") * F.col("q"))
        last = written(rows.select("g", p.alias("p")))
        lower = last.select(F.col("g").alias("shorter"), F.col("p").alias("q"))
    cut, of = cut_and_contexts(ORDER)
    parts = top.withColumn("context", F.floor(F.col("g") / SYMBOLS).cast("int")).join(of, "context").select("g", ((F.col("c") - cut) / F.col("total")).alias("part"))
    return parts, of.select("context", (F.col("left") / F.col("total")).alias("weight")), last


def train(texts: DataFrame) -> np.ndarray:
    """log2 probabilities by gram from a table with one text column; without any text they are uniform."""
    counts = texts.select(F.col(texts.columns[0]).cast("string").alias("text")).mapInPandas(counted, "g int, c long").groupBy("g").agg(F.sum("c").alias("c"))
    top = written(counts)
    parts, contexts, lower = (t.toArrow() for t in interpolated(top))  # SYMBOLS ** ORDER rows at most, whatever the corpus
    drop_written(top)
    column = lambda t, c: t[c].to_numpy()
    shorter = np.zeros(SYMBOLS ** (ORDER - 1))
    shorter[column(lower, "g")] = column(lower, "p")
    weight = np.ones(SYMBOLS ** (ORDER - 1))
    weight[column(contexts, "context")] = column(contexts, "weight")
    p = np.repeat(weight, SYMBOLS) * np.tile(shorter, SYMBOLS)
    p[column(parts, "g")] += column(parts, "part")
    return np.log2(p).astype(np.float32)


def placed(texts: list[str | None]) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """The texts' distinct words with their numbers, from 2, all hashes (first of the start and the end), and, for each place of the
    texts laid end to end, its word and its text."""
    table: defaultdict[bytes, int] = defaultdict(count(2).__next__)
    split = [(t or "").encode("utf-8", "replace").split() for t in texts]
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((table[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    hashes = np.fromiter((1, 2, *map(xxhash.xxh64_intdigest, table)), np.uint64, len(table) + 2)
    starts = np.cumsum(sizes + 2) - sizes - 2
    words = np.full(int(sizes.sum()) + 2 * len(split), -1, np.int64)
    words[starts], words[starts + sizes + 1] = START, END
    words[words < 0] = ids
    return table, hashes, words, np.repeat(np.arange(len(split)), sizes + 2)


def spelled(table: dict[bytes, int], letters: np.ndarray) -> np.ndarray:
    """Spelling logarithms of the start, the end, and the words."""
    codes, lengths = grams([w.decode("utf-8", "replace") + " " for w in table])
    spelling = np.bincount(np.repeat(np.arange(len(table)), lengths), letters[codes], minlength=len(table)) + np.log2(1 - 2.0**STOP)
    return np.concatenate([[0.0, STOP], spelling])


def pairs_of(hashes: np.ndarray, words: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, text) of each pair of adjacent places of one text; the place is the first one's."""
    at = np.flatnonzero(of[:-1] == of[1:])
    return mix64(hashes[words[at]] * M1 + hashes[words[at + 1]]), at, of[at]


def counted_words(letters: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in spans(batch["text"], CHUNK):
                table, hashes, words, _ = placed([t for t in batch["text"].iloc[rows] if isinstance(t, str) and t.strip()])
                spelling = spelled(table, letters)
                times = np.bincount(words, minlength=len(hashes))
                seen = np.flatnonzero(times)
                seen = seen[seen != START]
                yield pd.DataFrame({"w": hashes[seen].view(np.int64), "c": times[seen], "spelling": spelling[seen]})

    return run


def coded(hashes: np.ndarray, common: np.ndarray) -> np.ndarray:
    """Words' codes: a common word's place among the common ones' sorted hashes, another's hash with the highest bit set. Codes
    of common words have a few bytes once a shuffle compresses them, and whatever is known of such words can be shipped."""
    at = np.minimum(np.searchsorted(common, hashes), len(common) - 1)
    return np.where(common[at] == hashes, at.astype(np.uint64), hashes | RARE)


def counted_pairs(common: np.ndarray) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for rows in spans(batch["text"], BLOCK):
                _, hashes, words, of = placed([t for t in batch["text"].iloc[rows] if isinstance(t, str) and t.strip()])
                codes = coded(hashes, common)
                g, at, _ = pairs_of(codes, words, of)
                _, first, times = np.unique(g, return_index=True, return_counts=True)
                yield pd.DataFrame({"v": codes[words[at[first]]].view(np.int64), "w": codes[words[at[first] + 1]].view(np.int64), "c": times})

    return run


def hashed(v: np.ndarray, w: np.ndarray, bits: int) -> np.ndarray:
    """Grams of pairs of codes, as hashes of so many bits; w is ALONE for a word by itself."""
    return mix64(v.view(np.uint64) * M1 + w.view(np.uint64)) >> np.uint64(64 - bits)


def cut_by(d: list[float]) -> Column:
    return F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])


def most_frequent(counts: DataFrame, most: int) -> Column:
    """Of rows with a count c the most frequent ones, `most` at most, whole eighths of an octave."""
    size = F.floor(F.log2("c") * 8).cast("int")
    held, least = 0, 1 << 30
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():  # eight rows for each octave of counts
        held += r["n"]
        if held > most:
            break
        least = r["size"]
    return size >= least


def words_of(texts: DataFrame, letters: np.ndarray) -> tuple[DataFrame, np.ndarray]:
    """(w, c, spelling) of the texts' words and ends, by code, as a table, and the sorted hashes of common ones."""
    rows = texts.mapInPandas(counted_words(letters), "w long, c long, spelling double")
    rows = written(rows.groupBy("w").agg(F.sum("c").alias("c"), F.max("spelling").alias("spelling")))
    known = rows.where(most_frequent(rows, COMMON)).select("w").toArrow()["w"].to_numpy().view(np.uint64)
    common = np.unique(np.append(known, np.uint64(START + 1)))  # the start comes before many words

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(w=coded(b["w"].to_numpy().view(np.uint64), common).view(np.int64))

    words = written(rows.mapInPandas(run, rows.schema))
    drop_written(rows)
    return words, common


@dataclass
class Weights:
    """Rows (v, w, weight, c) of the words (w: ALONE) and pairs that the texts hold, a table of their counts c, the share that
    spellings have in the words' probabilities, and tables to remove when the rows aren't needed any more."""

    rows: DataFrame
    counts: DataFrame
    share: float
    tables: list[DataFrame]


def word_weights(words: DataFrame) -> Weights:
    """A model without pairs: words are its highest order, so their own counts are discounted."""
    cut = cut_by(discounts(words))
    total, left = words.agg(F.sum("c"), F.sum(cut)).first()
    share = left / total if total else 1.0
    p = (F.col("c") - cut) / F.lit(float(total or 1)) + share * F.pow(F.lit(2.0), "spelling")
    single = words.select(F.col("w").alias("v"), F.lit(ALONE).cast("long").alias("w"), (F.log2(p) - F.lit(float(np.log2(share))) - F.col("spelling")).cast("float").alias("weight"), "c")
    return Weights(single, words.select("c"), share, [words])


def looked_up(rows: DataFrame, key: str, facts: DataFrame) -> DataFrame:
    """rows with the facts of the word at `key`. Common words' facts, COMMON at most, are broadcast, so that no frequent word is
    a hot key; only rows of other words are shuffled."""
    facts = facts.withColumnRenamed("code", "of_code")
    same = F.col(key) == F.col("of_code")
    often = rows.where(F.col(key) >= 0).join(F.broadcast(facts.where("of_code >= 0")), same)
    return often.union(join_small(rows.where(F.col(key) < 0), facts.where("of_code < 0"), same, "inner")).drop("of_code")


def gram_weights(texts: DataFrame, words: DataFrame, common: np.ndarray) -> Weights:
    """A model of pairs over words. A word's weight is the logarithm of its probability over its share of the spelling's, plus that
    of its interpolation weight as a context; a pair's that of its probability over what its words alone would give."""
    pairs = texts.mapInPandas(counted_pairs(common), "v long, w long, c long")
    pairs = written(pairs.groupBy("v", "w").agg(F.sum("c").alias("c")))
    before = written(pairs.groupBy("w").agg(F.count("*").alias("c")))
    of_words, of_pairs = cut_by(discounts(before)), cut_by(discounts(pairs))
    total, left = before.agg(F.sum("c"), F.sum(of_words)).first()
    share = left / total if total else 1.0
    p = (F.col("c") - of_words) / F.lit(float(total or 1)) + share * F.pow(F.lit(2.0), "spelling")
    found = before.join(words.select(F.col("w").alias("code"), F.col("c").alias("times"), "spelling"), F.col("w") == F.col("code"))
    found = found.select("code", "times", F.log2(p).cast("float").alias("log_p"), (F.log2(p) - F.lit(float(np.log2(share))) - F.col("spelling")).cast("float").alias("gain"))
    contexts = pairs.groupBy("v").agg(F.sum("c").alias("total"), F.log2(F.sum(of_pairs) / F.sum("c")).cast("float").alias("back"))
    facts = written(found.join(contexts, F.col("code") == F.col("v"), "full").select(F.coalesce("code", "v").alias("code"), "times", "log_p", "gain", "total", "back"))
    drop_written(before)
    rows = looked_up(pairs, "v", facts.where("back is not null").select("code", "total", "back"))
    rows = looked_up(rows, "w", facts.where("log_p is not null").select("code", "log_p"))
    both = F.log2((F.col("c") - of_pairs) / F.col("total") + F.pow(F.lit(2.0), F.col("back") + F.col("log_p")))
    gain = F.coalesce("gain", F.lit(0.0)) + F.coalesce("back", F.lit(0.0))
    single = facts.select(F.col("code").alias("v"), F.lit(ALONE).cast("long").alias("w"), gain.cast("float").alias("weight"), F.coalesce("times", "total").alias("c"))
    rows = rows.select("v", "w", (both - F.col("back") - F.col("log_p")).cast("float").alias("weight"), "c")
    return Weights(single.union(rows), pairs.select("c").union(facts.select(F.coalesce("times", "total"))), share, [pairs, facts, words])


def narrowed(x: np.ndarray) -> bytes:
    """Unsigned integers in as few bytes each as the greatest needs, lowest bytes first, after the number of these bytes."""
    x = x.astype(np.uint64)
    k = max(1, (int(x.max(initial=0)).bit_length() + 7) // 8)
    return bytes([k]) + x.view(np.uint8).reshape(-1, 8)[:, :k].T.tobytes()


def widened(b: bytes) -> np.ndarray:
    k = b[0]
    out = np.zeros(((len(b) - 1) // k, 8), np.uint8)
    out[:, :k] = np.frombuffer(b, np.uint8, offset=1).reshape(k, -1).T
    return out.view(np.uint64).ravel()


def gaps(sorted_grams: np.ndarray) -> bytes:
    return narrowed(np.diff(sorted_grams, prepend=np.uint64(0)))


def from_gaps(b: bytes) -> np.ndarray:
    return np.cumsum(widened(b), dtype=np.uint64)


def fixed(x: np.ndarray) -> bytes:
    """Logarithms in steps of 2 ** -16, negative ones as odd numbers."""
    i = np.rint(x * 65536).astype(np.int64)
    return narrowed(((i << 1) ^ (i >> 63)).view(np.uint64))


def from_fixed(b: bytes) -> np.ndarray:
    i = widened(b).view(np.int64)
    return ((i >> 1) ^ -(i & 1)) / 65536


def places(g: np.ndarray) -> list[np.ndarray]:
    """A gram's places in the bitmap."""
    return [mix64(g + np.uint64((i + 1) * int(M1) % (1 << 64))) >> np.uint64(64 - BITMAP) for i in range(PLACES)]


@dataclass
class Known:
    """What tasks know of the model: spellings, common words, the most frequent grams and their weights, and which grams others
    may be. The last three are packed: a broadcast has a file in every executor."""

    letters: np.ndarray
    common: np.ndarray
    share: float
    pairs: bool
    bits: int
    hot: bytes
    weight: bytes
    bitmap: bytes

    @cached_property
    def often(self) -> tuple[np.ndarray, np.ndarray]:
        return from_gaps(self.hot), from_fixed(self.weight).astype(np.float32)

    @cached_property
    def places_taken(self) -> np.ndarray:
        return np.frombuffer(zlib.decompress(self.bitmap), np.uint64)

    def look(self, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The weights of frequent grams (0 for others), and whether a gram's weight has to be joined."""
        hot, weight = self.often
        at = np.minimum(np.searchsorted(hot, g), len(hot) - 1)
        known = hot[at] == g
        may = ~known
        for place in places(g):
            may &= (self.places_taken[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return np.where(known, weight[at], 0.0), may

    def judged(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """For each text its words and the part of its logarithm that needs no join; and (gram, text), sorted by gram, of the
        words and of the pairs that a join has to weigh."""
        table, hashes, words, of = placed(texts)
        spelling = spelled(table, self.letters)
        codes = coded(hashes, self.common)
        g = hashed(codes, np.full(len(codes), ALONE), self.bits)
        weight, wanted = self.look(g)
        logs = np.bincount(of, (weight + spelling + np.where(np.arange(len(g)) == START, 0.0, np.log2(self.share)))[words], minlength=len(texts))
        some = np.flatnonzero(wanted[words])
        some = some[np.argsort(g[words[some]])]
        asked = [(g[words[some]], of[some])]
        if self.pairs:
            at = np.flatnonzero(of[:-1] == of[1:])
            g = hashed(codes[words[at]], codes[words[at + 1]], self.bits)
            order = np.argsort(g)
            g, text = g[order], of[at][order]
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
            times = np.diff(np.append(first, len(g)))
            weight, wanted = self.look(g[first])
            logs += np.bincount(text, np.repeat(weight, times), minlength=len(texts))
            wanted = np.repeat(wanted, times)
            asked.append((g[wanted], text[wanted]))
        return np.bincount(of, minlength=len(texts)) - 2, logs, asked


def shard_of(g: np.ndarray, shards: int, bits: int) -> np.ndarray:
    """A gram's shard; higher grams have higher shards."""
    return (((g >> np.uint64(bits - 24)) * np.uint64(shards)) >> np.uint64(24)).astype(np.int64)


#: Rows that meet in a shard: weights (kind 0), then what blocks of texts ask (1), and the facts of blocks, which only pass (2).
MEETING = "shard int, kind int, block long, grams binary, weights binary, texts binary, held binary, facts string"
FIELDS = [f.split(" ")[0] for f in MEETING.split(", ")]


def meeting(rows: list[dict]) -> pd.DataFrame:
    return pd.DataFrame({c: pd.Series([r.get(c, -1 if c == "block" else None) for r in rows], dtype="int64" if c in ("shard", "kind", "block") else object) for c in FIELDS})


def runs(shard: np.ndarray) -> list[tuple[int, int]]:
    cuts = [0, *(np.flatnonzero(np.diff(shard)) + 1).tolist(), len(shard)] if len(shard) else [0]
    return list(zip(cuts, cuts[1:]))


def dealt_weights(shards: int, bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Rows (v, w, weight) packed by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def packed() -> pd.DataFrame:
            g, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(g)
            g, w = g[order], w[order]
            shard = shard_of(g, shards, bits)
            return meeting([{"shard": shard[i], "kind": 0, "grams": gaps(g[i:j]), "weights": fixed(w[i:j])} for i, j in runs(shard)])

        for b in batches:
            if len(b):
                held.append((hashed(b["v"].to_numpy(), b["w"].to_numpy(), bits), b["weight"].to_numpy(np.float64)))
            if sum(len(h[0]) for h in held) >= PACKED:
                yield packed()
        if held:
            yield packed()

    return run


def taken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A bitmap of the places that a task's packed grams take."""
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    for b in batches:
        for x in b["grams"]:
            for place in places(from_gaps(x)):
                np.bitwise_or.at(out, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
    if out.any():
        yield pd.DataFrame({"grams": [zlib.compress(out.tobytes(), 1)]})


def packed_weights(bits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """All rows (v, w, weight) of a task as one row of packed grams and weights, one of them a gram that never occurs, so that there is one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [(np.array([ALONE]), np.array([ALONE]), np.zeros(1))]
        held += [tuple(b[c].to_numpy() for c in ("v", "w", "weight")) for b in batches]
        v, w, weight = (np.concatenate(x) for x in zip(*held, strict=True))
        g = hashed(v, w, bits)
        order = np.argsort(g)
        yield pd.DataFrame({"grams": [gaps(g[order])], "weights": [fixed(weight[order])]})

    return run


def either(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The bits that any of a task's bitmaps has, as one bitmap."""
    out = np.zeros(1 << (BITMAP - 6), np.uint64)
    for b in batches:
        for x in b["grams"]:
            out |= np.frombuffer(zlib.decompress(x), np.uint64)
    if out.any():
        yield pd.DataFrame({"grams": [zlib.compress(out.tobytes(), 1)]})


def shipped(weights: Weights, letters: np.ndarray, common: np.ndarray, pairs: bool, hot: int) -> tuple[Known, DataFrame, int]:
    """What tasks get, and the table of the other weights, packed by shard, with the number of shards. It grows with the model, and
    so do the bits of its grams, so that a gram which the model lacks is taken for another with odds of 2 ** -24 whatever its size."""
    spark = weights.rows.sparkSession
    total = weights.counts.count()
    bits = min(64, max(40, 24 + total.bit_length()))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // SHARD))
    often = most_frequent(weights.counts, hot)
    # one task packs the most frequent grams, `hot` at most, so that the driver never holds them as rows
    top = written(weights.rows.where(often).select("v", "w", "weight").repartition(1).mapInPandas(packed_weights(bits), "grams binary, weights binary"))
    packed = top.toArrow()  # one row
    rest = written(weights.rows.where(~often).select("v", "w", "weight").mapInPandas(dealt_weights(shards, bits), MEETING))
    for t in (*weights.tables, top):
        drop_written(t)
    bitmaps = rest.select("grams").mapInPandas(taken, "grams binary").repartition(8).mapInPandas(either, "grams binary")
    with shuffles_removed(spark):
        bitmap = bitmaps.repartition(1).mapInPandas(either, "grams binary").toArrow()  # one row at most: eight bitmaps meet
    none = zlib.compress(bytes(1 << (BITMAP - 3)), 1)
    return Known(letters, common, weights.share, pairs, bits, packed["grams"][0].as_py(), packed["weights"][0].as_py(), bitmap["grams"][0].as_py() if bitmap.num_rows else none), rest, shards


def asked_weights(known: Known, shards: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What blocks of texts (doc_id, lang, text) ask of each shard, and the facts of their texts."""

    def block(number: int, part: pd.DataFrame) -> pd.DataFrame:
        texts = [t if isinstance(t, str) else None for t in part["text"]]
        n_words, logs, asked = known.judged(texts)
        facts = [[i, lang, len(t or ""), int(n), float(x)] for i, lang, t, n, x in zip(part["doc_id"], part["lang"], texts, n_words, logs, strict=True)]
        rows = [{"shard": number % shards, "kind": 2, "block": number, "facts": json.dumps(facts)}]
        for g, text in asked:
            first = np.flatnonzero(np.concatenate([np.ones(min(1, len(g)), bool), g[1:] != g[:-1]]))
            ends = np.append(first, len(g))
            held = np.diff(ends)
            for i, j in runs(shard_of(g[first], shards, known.bits)):
                rows.append({"shard": shard_of(g[first[i : i + 1]], shards, known.bits)[0], "kind": 1, "block": number, "grams": gaps(g[first[i:j]]), "held": narrowed(held[i:j]), "texts": narrowed(text[ends[i] : ends[j]])})
        return meeting(rows)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in spans(batch["text"], BLOCK):
                yield block(number, batch.iloc[rows])
                number += 1

    return run


def weighed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, texts, sums, facts) from the rows of shards, each shard's weights first; a task holds one shard's weights."""
    at, held, model, out = None, [], None, []
    for b in batches:
        for shard, kind, number, grams, weights, texts, holding, facts in b[FIELDS].itertuples(index=False, name=None):
            if shard != at:
                at, held, model = shard, [], None
            if kind == 0:
                held.append((from_gaps(grams), from_fixed(weights)))
            elif kind == 2:
                out.append((number, None, None, facts))
            elif held:
                if model is None:
                    g = np.concatenate([h[0] for h in held])
                    order = np.argsort(g)
                    model = g[order], np.concatenate([h[1] for h in held])[order]
                g = from_gaps(grams)
                place = np.minimum(np.searchsorted(model[0], g), len(model[0]) - 1)
                weight = np.where(model[0][place] == g, model[1][place], 0.0)
                doc = widened(texts).astype(np.int64)
                sums = np.bincount(doc, np.repeat(weight, widened(holding).astype(np.int64)))
                seen = np.flatnonzero(sums)
                if len(seen):
                    out.append((number, narrowed(seen), fixed(sums[seen]), None))
        if len(out) > 1000:
            yield pd.DataFrame(out, columns=["block", "texts", "sums", "facts"], dtype=object)
            out = []
    if out:
        yield pd.DataFrame(out, columns=["block", "texts", "sums", "facts"], dtype=object)


def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Texts with their whole logarithm, from the rows of blocks, sorted by block."""
    at, parts, told = None, [], None

    def block() -> pd.DataFrame:
        ids, langs, chars, words, logs = zip(*json.loads(told), strict=True)
        logs = np.array(logs, float)
        for texts, sums in parts:
            logs[widened(texts).astype(np.int64)] += from_fixed(sums)  # a row's texts are distinct
        return pd.DataFrame({"doc_id": pd.Series(ids, dtype=object), "lang": pd.Series(langs, dtype=object), "n_chars": chars, "n_words": words, "logs": logs})

    for b in batches:
        for number, texts, sums, facts in b[["block", "texts", "sums", "facts"]].itertuples(index=False, name=None):
            if number != at:
                if told:
                    yield block()
                at, parts, told = number, [], None
            if facts is not None:
                told = facts
            else:
                parts.append((texts, sums))
    if told:
        yield block()


def scored_texts(rows: DataFrame, rest: DataFrame, known: Known, shards: int) -> DataFrame:
    """(doc_id, lang, n_chars, n_words, logs) of rows (doc_id, lang, text): one pass over the texts, one shuffle by shard, where
    weights meet what blocks of texts ask, and one by block."""
    asked = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(asked_weights(known, shards), MEETING)
    met = rest.union(asked).repartition("shard").sortWithinPartitions("shard", "kind").mapInPandas(weighed, "block long, texts binary, sums binary, facts string")
    out = met.repartition("block").sortWithinPartitions("block").mapInPandas(summed, "doc_id string, lang string, n_chars long, n_words long, logs double")
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))


def quality(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_id_col: str = "doc_id", trusted_col: str = "quality", low: float = 0.001, high: float = 0.999, slack: float = 1.5, pairs: bool = True, hot: int = HOT) -> DataFrame:
    """One row for each row of docs: doc_id, n_chars, n_words, perplexity (of a word), kept.

    Trusted documents are those whose label is above 0. kept: the perplexity is within the low quantile of the trusted
    documents of the row's language and the high one of those held out, widened by `slack`; a language without any goes by
    all trusted ones. A null text or one without words has no perplexity and isn't kept. Repeated rows are judged alike; other
    columns aren't looked at; an empty table gives an empty one; without trusted rows all rows with words are kept.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"), F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("")).alias("lang"))
    trusted = labels.where(F.col(f"`{trusted_col}`") > 0).select(F.col(f"`{label_id_col}`").cast("long").alias("trusted_id")).where("trusted_id is not null").distinct()
    trusted = written(trusted.withColumn("held_out", F.pmod(F.xxhash64("trusted_id"), F.lit(FOLDS)) == 0))
    texts = join_small(rows.select("text", "doc_id"), trusted.where("not held_out"), F.col("doc_id") == F.col("trusted_id"), "left_semi", BROADCAST_IDS).select("text")
    letters = train(texts)
    words, common = words_of(texts, letters)
    weights = gram_weights(texts, words, common) if pairs else word_weights(words)
    known, rest, shards = shipped(weights, letters, common, pairs, hot)
    scored = scored_texts(rows, rest, known, shards)
    perplexity = F.when(F.col("n_words") > 0, F.pow(F.lit(2.0), -F.col("logs") / (F.col("n_words") + 1)))
    scored = written(scored.select("doc_id", "lang", "n_chars", "n_words", perplexity.alias("perplexity")))
    drop_written(rest)
    own = join_small(scored, trusted, F.col("doc_id") == F.col("trusted_id"), "inner", BROADCAST_IDS)
    ends = (F.percentile_approx("perplexity", F.lit(low), F.lit(10_000)).alias("least"), F.percentile_approx(F.when(F.col("held_out"), F.col("perplexity")), F.lit(high), F.lit(10_000)).alias("most"))
    bands = written(own.groupBy("lang").agg(*ends).select(F.col("lang").alias("of_lang"), "least", "most"))
    every = own.agg(*ends).first()
    out = join_small(scored, bands, F.col("lang") == F.col("of_lang"))
    at_least = F.coalesce("least", F.lit(float(every["least"] or 0.0)))
    at_most = F.coalesce("most", F.lit(float(every["most"] or "inf")))
    kept = F.coalesce(F.col("perplexity").between(at_least / slack, at_most * slack), F.lit(False))
    return out.select("doc_id", "n_chars", "n_words", "perplexity", kept.alias("kept"))
