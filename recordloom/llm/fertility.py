"""Quality rules: base counts of a text and the fertility of a public tokeniser, with rejection bands by language.

One pass measures every whole text. Texts of a batch share a word table: a sentencepiece vocabulary never merges
across words, so each distinct word is encoded once, and counts, token histograms and three-word windows are numpy
work on word ids. Then each language (texts without one: their script) gets bands from all its documents, the
median plus or minus `width` robust standard deviations of

- characters per token, on both sides: a tokeniser that suddenly does far better or worse reads something else;
- byte-fallback share, above only: characters that the vocabulary doesn't know;
- token entropy over the greatest possible for the length, below only: few tokens again and again.

A document outside a band, or failing a base rule, is rejected.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import join_small, spans, written

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FERTILITY = ("n_tokens", "chars_per_token", "byte_share", "token_entropy")
ADDED = (*BASE, "base_failed", *FERTILITY, "kept")

SPACES, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Bytes of text that are measured together, and words that the table of encoded words keeps between batches.
CHUNK, TABLE = 2_000_000, 400_000


class Encoder:
    """Token ids of words, each encoded once while the table has room."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = self.model.get_piece_size()
        self.is_byte = np.fromiter((self.model.is_byte(i) for i in range(size)), bool, size)
        self.known: dict[bytes, list[int]] = {}

    def encode(self, words: list[bytes]) -> list[list[int]]:
        if len(self.known) > TABLE:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        self.known.update(zip(new, self.model.encode([w.decode("utf-8", "replace") for w in new], num_threads=1), strict=True))
        return [self.known[w] for w in words]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def measure(texts: list[str | None], encoder: Encoder) -> pd.DataFrame:
    """The counts of BASE and FERTILITY for each text."""
    raw = [(t or "").encode("utf-8", "replace") for t in texts]
    split = [t.split() for t in raw]  # on bytes: exactly ASCII white space
    n = len(raw)
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    n_words = np.fromiter(map(len, split), np.int64, n)
    ids = np.fromiter((table[w] for ws in split for w in ws), np.int64, int(n_words.sum()))
    doc = np.repeat(np.arange(n), n_words)
    out = {
        "n_words": n_words,
        "word_chars": np.fromiter((len(t or "") - len(b) + len(b.translate(None, SPACES)) for t, b in zip(texts, raw, strict=True)), np.int64, n),
        "n_symbols": np.fromiter((len(b) - len(b.translate(None, SYMBOLS)) for b in raw), np.int64, n),
        "n_dup_lines": np.fromiter((len(x) - len(set(x)) for x in ([y for y in b.split(b"\n") if y.strip()] for b in raw)), np.int64, n),
        "n_repeat_words": repeated_words(ids, doc, len(table), n),
    }
    pieces = encoder.encode(list(table))
    lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
    flat = np.fromiter((i for p in pieces for i in p), np.int64, int(lengths.sum()))
    own = lengths[ids]
    tokens, of = flat[ragged((np.cumsum(lengths) - lengths)[ids], own)], np.repeat(doc, own)
    n_tokens = np.bincount(of, minlength=n)
    pairs, times = np.unique(of * len(encoder.is_byte) + tokens, return_counts=True)
    of_pair = pairs // len(encoder.is_byte)
    share = times / np.maximum(n_tokens, 1)[of_pair]
    entropy = np.bincount(of_pair, -share * np.log2(share), minlength=n)
    most = np.log2(np.minimum(np.maximum(n_tokens, 2), len(encoder.is_byte)))
    out |= {
        "n_tokens": n_tokens,
        "chars_per_token": out["word_chars"] / np.maximum(n_tokens, 1),
        "byte_share": np.bincount(of, encoder.is_byte[tokens], minlength=n) / np.maximum(n_tokens, 1),
        "token_entropy": np.maximum(entropy, 0) / most,
    }
    return pd.DataFrame(out)


def repeated_words(ids: np.ndarray, doc: np.ndarray, words: int, n: int) -> np.ndarray:
    """For each text, words within a three-word window that the text holds twice or more."""
    if len(ids) < 3:
        return np.zeros(n, np.int64)
    whole = doc[:-2] == doc[2:]
    first, second = np.unique(ids[:-2] * (words + 1) + ids[1:-1], return_inverse=True)
    key = second.astype(np.int64) * (words + 1) + ids[2:]  # exact: a chunk has fewer than 2^31 words
    key[~whole] = -1 - np.arange(int((~whole).sum()))  # a window across two texts equals no other
    order = np.argsort(key, kind="stable")  # texts stay in order within a window
    k, d = key[order], doc[:-2][order]
    equal = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    again = np.zeros(len(k), bool)
    again[1:] |= equal
    again[:-1] |= equal
    start = order[again]
    within = np.zeros(len(ids), bool)
    for i in range(3):
        within[start + i] = True
    return np.bincount(doc[within], minlength=n)


def chunks(texts: pd.Series) -> Iterator[slice]:
    """Slices of rows that are measured together."""
    return spans(texts, CHUNK)


def measured(docs: DataFrame, id_col: str, text_col: str, lang_col: str, vocabulary: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for rows in chunks(batch["text"]):
                part = batch.iloc[rows]
                found = measure([t if isinstance(t, str) else None for t in part["text"]], encoder)
                yield pd.concat([part[["id", "band"]].reset_index(drop=True), found], axis=1)

    text = F.col(f"`{text_col}`")
    latin = F.regexp_count(text, F.lit(r"\p{IsLatin}")) * 2 >= F.regexp_count(text, F.lit(r"\p{L}"))
    band = F.coalesce(F.concat(F.lit("lang "), F.col(f"`{lang_col}`").cast("string")), F.when(latin, F.lit("script latin")), F.lit("script other"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), text.cast("string").alias("text"), band.alias("band"))
    schema = f"id long, band string, {', '.join(f'{c} long' for c in BASE)}, n_tokens long, {', '.join(f'{c} double' for c in FERTILITY[1:])}"
    return rows.mapInPandas(run, schema)


def bands(rows: DataFrame, width: float, least: dict[str, float]) -> DataFrame:
    """For each language or script and each measure: median - width * s and median + width * s over all documents that
    pass the base rules, s being the interquartile range over 1.349 or `least`, if that is more."""
    quartiles = {c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.lit(2000)) for c in FERTILITY[1:]}
    got = rows.where(~F.col("base_failed")).groupBy("band").agg(*[q.alias(c) for c, q in quartiles.items()])
    cols = []
    for c in FERTILITY[1:]:
        s = F.greatest((F.col(c)[2] - F.col(c)[0]) / 1.349, F.lit(least[c])) * width
        cols += [(F.col(c)[1] - s).alias(f"{c}_low"), (F.col(c)[1] + s).alias(f"{c}_high")]
    return got.select(F.col("band").alias("of_band"), *cols)


#: The least standard deviation that a band goes by: languages with few or very even documents keep some room.
LEAST = {"chars_per_token": 0.04, "byte_share": 0.02, "token_entropy": 0.05}


def quality_rules(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", vocabulary: str = VOCABULARY, width: float = 8.0, least: dict[str, float] | None = None) -> DataFrame:
    """One row for each row of docs: doc_id, the counts of BASE, base_failed, the measures of FERTILITY, kept.

    base_failed: fewer than 50 words, or over half of the words in repeated three-word windows. kept: not
    base_failed and within the bands. A null or empty text has no words and so fails. Repeated rows are judged
    alike; an empty table gives an empty one; other columns aren't looked at. vocabulary: a sentencepiece model
    that every executor can read.
    """
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    rows = written(measured(docs, id_col, text_col, lang_col, vocabulary).withColumn("base_failed", failed))
    limits = written(bands(rows, width, least or LEAST))
    out = join_small(rows, limits, F.col("band") == F.col("of_band"))
    inside = F.col("chars_per_token").between(F.col("chars_per_token_low"), F.col("chars_per_token_high")) & (F.col("byte_share") <= F.col("byte_share_high")) & (F.col("token_entropy") >= F.col("token_entropy_low"))
    return out.select(F.col("id").alias("doc_id"), *BASE, "base_failed", *FERTILITY, (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def with_verdict(docs: DataFrame, **options: object) -> DataFrame:
    """The rows of docs that quality_rules keeps, with the columns of docs. Rows are told apart by identifier, text and language, so
    those that share an identifier are judged one by one."""
    key = F.xxhash64(*[F.col(f"`{options.get(c, d)}`") for c, d in (("id_col", "doc_id"), ("text_col", "text"), ("lang_col", "lang"))])
    judged = quality_rules(docs.withColumn("__judged", key), **options | {"id_col": "__judged"})
    return docs.join(judged.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), key == F.col("__gone"), "left_anti")
