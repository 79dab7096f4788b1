"""A column tagger's tokens and its forward pass: byte tokens of a name and a few values through a small transformer.

Weights are given (none come with the library); the network is numpy on Arrow batches, with the weights shipped to the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The vocabulary (marks, then printable ASCII, then the rest) and the lengths that are read.
PAD, CLS, SEP, OTHER, FIRST, VOCABULARY = 0, 1, 2, 3, 4, 99
NAME_BYTES, VALUE_BYTES, VALUES = 24, 12, 3


def tokens(name: str, values: list[str], length: int = 64) -> list[int]:
    """CLS, the name's bytes, then SEP and the bytes of each value; cut at `length`."""
    code = lambda b: FIRST + b - 32 if 32 <= b < 127 else OTHER
    out = [CLS, *map(code, name.encode()[:NAME_BYTES])]
    for v in values[:VALUES]:
        out += [SEP, *map(code, v.encode()[:VALUE_BYTES])]
    return out[:length]


def normed(x: np.ndarray, gain: np.ndarray, shift: np.ndarray) -> np.ndarray:
    return (x - x.mean(axis=-1, keepdims=True)) / np.sqrt(x.var(axis=-1, keepdims=True) + 1e-5) * gain + shift


def soft(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def forward(ids: np.ndarray, weights: dict[str, np.ndarray], heads: int = 4) -> np.ndarray:
    """Class probabilities (n, classes) of padded token rows: pre-norm layers, ReLU, the head on the first position."""
    n, length = ids.shape
    x = weights["embed"][ids] + weights["position"][:length]
    hidden = np.where((ids == PAD)[:, None, None, :], -1e9, 0.0)
    layer = 0
    while f"{layer}.qkv" in weights:
        w = lambda k: weights[f"{layer}.{k}"]  # noqa: E731, B023
        q, k, v = np.split(normed(x, w("g1"), w("b1")) @ w("qkv") + w("qkv_b"), 3, axis=-1)
        split = lambda t: t.reshape(n, length, heads, -1).transpose(0, 2, 1, 3)
        seen = soft(split(q) @ split(k).transpose(0, 1, 3, 2) / np.sqrt(x.shape[-1] / heads) + hidden) @ split(v)
        x = x + seen.transpose(0, 2, 1, 3).reshape(n, length, -1) @ w("out") + w("out_b")
        x = x + np.maximum(normed(x, w("g2"), w("b2")) @ w("up") + w("up_b"), 0) @ w("down") + w("down_b")
        layer += 1
    return soft(normed(x[:, 0], weights["g"], weights["b"]) @ weights["head"] + weights["head_b"])


def random_weights(classes: int, width: int = 48, layers: int = 2, inner: int = 96, length: int = 64, seed: int = 0) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    m = lambda *s: rng.standard_normal(s) / np.sqrt(s[0])
    out = {"embed": m(VOCABULARY, width), "position": m(length, width), "g": np.ones(width), "b": np.zeros(width), "head": m(width, classes), "head_b": np.zeros(classes)}
    for i in range(layers):
        out |= {f"{i}.{k}": v for k, v in {"g1": np.ones(width), "b1": np.zeros(width), "g2": np.ones(width), "b2": np.zeros(width), "qkv": m(width, 3 * width), "qkv_b": np.zeros(3 * width), "out": m(width, width), "out_b": np.zeros(width), "up": m(width, inner), "up_b": np.zeros(inner), "down": m(inner, width), "down_b": np.zeros(width)}.items()}
    return out


def save_weights(spark: SparkSession, weights: dict[str, np.ndarray], path: str) -> None:
    """Weights as a table of one row for each: name, shape and values."""
    rows = [(k, list(v.shape), [float(x) for x in v.ravel()]) for k, v in sorted(weights.items())]
    spark.createDataFrame(rows, "name string, shape array<int>, values array<double>").write.mode("overwrite").parquet(path)


def load_weights(spark: SparkSession, path: str, expected: dict[str, tuple[int, ...]] | None = None) -> dict[str, np.ndarray]:
    """Saved weights (a model's, so few and small). A shape that its values don't fill, a value that isn't finite, a repeated name, or
    names and shapes other than the expected ones raise."""
    out: dict[str, np.ndarray] = {}
    for r in spark.read.parquet(path).orderBy("name").collect():
        values, shape = np.array(r["values"], float), tuple(r["shape"])
        if len(values) != int(np.prod(shape)) or not np.isfinite(values).all() or r["name"] in out:
            raise ValueError(f"weights {r['name']} at {path} don't add up")
        out[r["name"]] = values.reshape(shape)
    if expected is not None and {k: v.shape for k, v in out.items()} != expected:
        raise ValueError(f"weights at {path} aren't those of this model")
    return out


def tag(columns: DataFrame, weights: dict[str, np.ndarray], classes: list[str], heads: int = 4, keys: Sequence[str] = ("example",)) -> DataFrame:
    """columns (keys..., name, values) with the likeliest class and its probability."""
    length, keys = len(weights["position"]), list(keys)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.iloc[at : at + 512]
                rows = [tokens(n or "", [v for v in vs if v is not None], length) for n, vs in zip(part["name"], part["values"], strict=True)]
                ids = np.full((len(rows), max(map(len, rows))), PAD)
                for i, r in enumerate(rows):
                    ids[i, : len(r)] = r
                p = forward(ids, weights, heads)
                yield part[keys].assign(**{"class": [classes[i] for i in p.argmax(axis=1)], "probability": p.max(axis=1)})

    kept = columns.select(*keys, F.col("name").cast("string").alias("name"), F.coalesce("values", F.array().cast("array<string>")).alias("values"))
    schema = T.StructType([*[kept.schema[k] for k in keys], T.StructField("class", T.StringType()), T.StructField("probability", T.DoubleType())])
    return kept.mapInPandas(run, schema)


def flat_weights(weights: dict[str, np.ndarray]) -> np.ndarray:
    """All weights in one vector, in the order of their names."""
    return np.concatenate([weights[k].ravel() for k in sorted(weights)])


def from_flat(flat: np.ndarray, expected: dict[str, tuple[int, ...]]) -> dict[str, np.ndarray]:
    """Weights of the expected shapes from such a vector; another number of values raises."""
    sizes = [int(np.prod(expected[k])) for k in sorted(expected)]
    if len(flat) != sum(sizes):
        raise ValueError(f"{len(flat)} values for a model of {sum(sizes)}")
    parts = np.split(np.asarray(flat, float), np.cumsum(sizes)[:-1])
    return {k: p.reshape(expected[k]) for k, p in zip(sorted(expected), parts)}


def parity(weights: dict[str, np.ndarray], other: dict[str, np.ndarray], rows: list[tuple[str, list[str]]], heads: int = 4) -> tuple[float, int]:
    """(greatest difference of probabilities, changed classes) of two models' weights on the same columns."""
    length = len(weights["position"])
    ids = np.full((len(rows), length), PAD)
    for i, (name, values) in enumerate(rows):
        t = tokens(name, values, length)
        ids[i, : len(t)] = t
    a, b = forward(ids, weights, heads), forward(ids, other, heads)
    return float(np.abs(a - b).max()), int((a.argmax(1) != b.argmax(1)).sum())
