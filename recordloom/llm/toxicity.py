"""Toxicity as severity grades: cumulative-link ordinal regression on sparse text features.

P(grade > k) = sigmoid(w.x - t_k) with one weight vector w for all thresholds t_0 < t_1 < ...; the expected severity
is the sum of these probabilities, and a document is toxic if P(grade > 0) is at least one half.

Features are words and their four- and five-character prefixes (a stem covers its inflections), as 1 + log(count).
Their document counts over the labelled sample are aggregated in Spark, and those whose association with the label
pass a likelihood-ratio test at one and a half times the Bonferroni level become the model's vocabulary, FEATURES at most. The sample is
bounded by `max_labelled`; scoring covers every word of every document with the few model weights shipped along.

Labels of 0 and 1 carry no degrees. There, toxic samples are graded 1 to 3 by terciles of the score that a model of one threshold
gives them which was fitted on the other half of the sample, so a grade says how strongly texts that the model hasn't seen are
taken for toxic; labels that go above 1 are used as they are. The column graded_from says which of the two it was.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import mix64, spans, written

#: The most features a model has, and labelled rows (about) that it is fitted on.
FEATURES, MAX_LABELLED = 2000, 20_000
PREFIXES = (4, 5)
STRIP = b".,;:!?\"'()[]{}<>*#-_|%$&"
CHUNK = 2_000_000


def features(word: bytes) -> set[str]:
    """A word's features: itself without case and outer marks, and its prefixes."""
    w = word.strip(STRIP).decode("utf-8", "replace").lower()
    return {f"w {w}", *(f"{k} {w[:k]}" for k in PREFIXES if len(w) > k)} if w else set()


def tables(texts: list[str]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
    """Distinct words, each word's place among them, and its text."""
    split = [t.encode("utf-8", "replace").split() for t in texts]
    table: defaultdict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, split), np.int64, len(split))
    ids = np.fromiter((table[w] for ws in split for w in ws), np.int64, int(sizes.sum()))
    return list(table), ids, np.repeat(np.arange(len(split)), sizes)


def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """For each feature of a batch, how many toxic and how many other texts have it."""
    for batch in batches:
        toxic, other = Counter(), Counter()
        for text, grade in zip(batch["text"], batch["grade"], strict=True):
            have: set[str] = set()
            for w in set((text or "").encode("utf-8", "replace").split()):
                have |= features(w)
            (toxic if grade > 0 else other).update(have)
        both = list({*toxic, *other})
        yield pd.DataFrame({"feature": both, "toxic": [toxic[f] for f in both], "other": [other[f] for f in both]})


def hits(texts: list[str | None], index: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, feature, value) of the model's features in each text."""
    words, ids, doc = tables([t or "" for t in texts])
    found = [[index[f] for f in features(w) if f in index] for w in words]
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    flat = np.fromiter((f for x in found for f in x), np.int64, int(sizes.sum()))
    some = sizes[ids] > 0
    ids, doc = ids[some], doc[some]
    own = sizes[ids]
    ends = np.cumsum(own)
    at = np.arange(ends[-1] if len(ends) else 0) + np.repeat((np.cumsum(sizes) - sizes)[ids] - (ends - own), own)
    pairs, times = np.unique(np.repeat(doc, own) * max(1, len(index)) + flat[at], return_counts=True)
    return pairs // max(1, len(index)), pairs % max(1, len(index)), 1 + np.log(times)


@dataclass
class Model:
    index: dict[str, int]
    weights: np.ndarray
    thresholds: np.ndarray
    graded_from: str = "labels"

    def above(self, texts: list[str | None]) -> np.ndarray:
        """P(grade > k) for each text and k."""
        doc, feature, value = hits(texts, self.index)
        score = np.bincount(doc, self.weights[feature] * value if len(feature) else None, minlength=len(texts)) if len(doc) else np.zeros(len(texts))
        return 1 / (1 + np.exp(np.clip(self.thresholds[None] - score[:, None], -50, 50)))


def fit_ordinal(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, grades: np.ndarray, size: int, ridge: float = 0.1, rounds: int = 600) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds of a cumulative-link model by full-batch gradient steps (Adam). Thresholds are a first
    one and exponents of their gaps, so they stay in order."""
    n, k = len(grades), int(grades.max(initial=1))
    w, raw = np.zeros(size), np.zeros(k)
    raw[0] = np.log((np.sum(grades == 0) + 1) / (np.sum(grades > 0) + 1))
    m, v = np.zeros(size + k), np.zeros(size + k)
    for t in range(1, rounds + 1):
        th = raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])
        score = np.bincount(doc, w[feature] * value, minlength=n) if len(doc) else np.zeros(n)
        above = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(np.clip(th[None] - score[:, None], -50, 50))), np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        hi, lo = above[rows, grades], above[rows, grades + 1]
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p, lo * (1 - lo) / p
        d_score = d_lo - d_hi  # of the negative log-likelihood
        g_th = np.array([np.sum(d_hi[grades == j + 1]) - np.sum(d_lo[grades == j]) for j in range(k)])
        g_w = (np.bincount(feature, d_score[doc] * value, minlength=size) if len(doc) else np.zeros(size)) + ridge * w
        tails = np.cumsum(g_th[::-1])[::-1]
        g = np.concatenate([g_w, [tails[0]], tails[1:] * np.exp(raw[1:])]) / n
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-10)
        w, raw = w - step[:size], raw - step[size:]
    return w, raw[0] + np.concatenate([[0.0], np.cumsum(np.exp(raw[1:]))])


def tercile_grades(doc: np.ndarray, feature: np.ndarray, value: np.ndarray, toxic: np.ndarray, size: int, half: np.ndarray) -> np.ndarray:
    """Grades 0 to 3 from labels of 0 and 1: each half's toxic samples by their scores under a model of the other half."""
    n = len(toxic)
    score = np.zeros(n)
    for side in (half, ~half):
        own = side[doc]
        row = np.cumsum(side) - 1
        w, t = fit_ordinal(row[doc[own]], feature[own], value[own], toxic[side], size, rounds=200)
        other = np.bincount(doc, w[feature] * value, minlength=n) - t[0] if len(doc) else np.zeros(n)
        score = np.where(side, score, other)
    low, high = np.quantile(score[toxic == 1], [1 / 3, 2 / 3])
    return np.where(toxic == 1, 1 + (score > low) + (score > high), 0)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", grade_col: str = "toxic", max_labelled: int = MAX_LABELLED, limit: int = FEATURES) -> Model:
    """A model from documents and their labelled grades (0: harmless). Null grades and identifiers count as unlabelled."""
    graded = labels.select(F.col(f"`{label_id_col}`").cast("long").alias("__label_id"), F.col(f"`{grade_col}`").cast("int").alias("grade")).where("grade is not null and __label_id is not null")
    graded = graded.groupBy("__label_id").agg(F.max("grade").alias("grade"))
    share = min(1.0, max_labelled / max(1, graded.count()))
    sample = graded.where(F.pmod(F.xxhash64("__label_id"), F.lit(1 << 30)) < int(share * (1 << 30)))  # about max_labelled rows, so it may be broadcast
    key = F.col(f"`{id_col}`").cast("long")
    rows = written(docs.select(key.alias("id"), F.col(f"`{text_col}`").cast("string").alias("text")).join(F.broadcast(sample), F.col("id") == F.col("__label_id")).select("id", "text", "grade").dropDuplicates(["id"]))
    totals = rows.agg(F.sum((F.col("grade") > 0).cast("long")), F.count("*")).first()
    a_all, n_all = int(totals[0] or 0), int(totals[1] or 0)
    b_all = n_all - a_all
    if not a_all or not b_all:
        return Model({}, np.zeros(0), np.array([50.0]))
    counts = rows.mapInPandas(counted, "feature string, toxic long, other long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("other").alias("b"))
    counts = written(counts.where("a + b >= 3"))
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    n = F.col("a") + F.col("b")
    a, b = F.col("a"), F.col("b")
    g2 = 2 * (term(a, n * a_all / n_all) + term(b, n * b_all / n_all) + term(F.lit(a_all) - a, (F.lit(n_all) - n) * a_all / n_all) + term(F.lit(b_all) - b, (F.lit(n_all) - n) * b_all / n_all))
    level = 3 * np.log(max(2, counts.count()))
    best = counts.select("feature", g2.alias("g2")).where(F.col("g2") >= float(level)).orderBy(F.desc("g2"), "feature").limit(limit).collect()
    index = {r["feature"]: i for i, r in enumerate(best)}

    def matrix(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in spans(batch["text"], CHUNK):
                part = batch.iloc[s]
                doc, feature, value = hits(list(part["text"]), index)
                at = np.searchsorted(doc, np.arange(len(part) + 1))
                yield pd.DataFrame({"id": part["id"].to_numpy(), "grade": part["grade"].to_numpy(), "f": [feature[i:j] for i, j in zip(at, at[1:])], "v": [value[i:j] for i, j in zip(at, at[1:])]})

    got = rows.mapInPandas(matrix, "id long, grade int, f array<long>, v array<double>").toPandas()  # the bounded sample
    grades = got["grade"].to_numpy().astype(np.int64)
    sizes = got["f"].map(len).to_numpy()
    doc = np.repeat(np.arange(len(got)), sizes)
    feature = np.concatenate([*got["f"], np.zeros(0)]).astype(np.int64)
    value = np.concatenate([*got["v"], np.zeros(0)])
    graded_from = "labels"
    if grades.max() == 1 and len(index):
        graded_from = "terciles of held-out scores"
        grades = tercile_grades(doc, feature, value, grades, len(index), mix64(got["id"].to_numpy().view(np.uint64)) & np.uint64(1) == 1)
    grades = np.unique(grades, return_inverse=True)[1]  # grades that occur, in order
    return Model(index, *fit_ordinal(doc, feature, value, grades, len(index)), graded_from)


def severity(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: doc_id, expected_severity, grade (the likeliest), p_toxic, toxic, graded_from.

    A null or empty text scores as one without features. Other columns aren't looked at; an empty table gives an
    empty one. Without labels of both kinds the model finds nothing toxic.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in spans(batch["text"], CHUNK):
                part = batch.iloc[s]
                above = model.above([t if isinstance(t, str) else None for t in part["text"]])
                each = np.diff(np.concatenate([np.ones((len(part), 1)), above, np.zeros((len(part), 1))], axis=1), axis=1) * -1
                yield pd.DataFrame({"doc_id": part["id"].to_numpy(), "expected_severity": above.sum(axis=1), "grade": each.argmax(axis=1).astype("int32"), "p_toxic": above[:, 0], "toxic": above[:, 0] >= 0.5, "graded_from": model.graded_from})

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return rows.mapInPandas(run, "doc_id long, expected_severity double, grade int, p_toxic double, toxic boolean, graded_from string")


def harmless(docs: DataFrame, model: Model, **options: str) -> DataFrame:
    """The rows of docs that aren't toxic, with the columns of docs. Rows are told apart by identifier and text, so those that
    share an identifier are judged one by one."""
    key = F.xxhash64(*[F.col(f"`{options.get(c, d)}`") for c, d in (("id_col", "doc_id"), ("text_col", "text"))])
    judged = severity(docs.withColumn("__judged", key), model, **options | {"id_col": "__judged"})
    return docs.join(judged.where("toxic").select(F.col("doc_id").alias("__gone")).distinct(), key == F.col("__gone"), "left_anti")
