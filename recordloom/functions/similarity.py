"""Jaro-Winkler similarity of bytes, as an Arrow function to be run over distinct pairs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def jaro_winkler(a: str, b: str) -> float:
    """Similarity of two strings' bytes; the common prefix (four at most) always counts, at 0.1 each."""
    x, y = a.encode(), b.encode()
    if x == y:
        return 1.0
    if not x or not y:
        return 0.0
    reach = max(0, max(len(x), len(y)) // 2 - 1)
    taken = [False] * len(y)
    hits = []
    for i, c in enumerate(x):
        for j in range(max(0, i - reach), min(len(y), i + reach + 1)):
            if not taken[j] and y[j] == c:
                taken[j] = True
                hits.append(c)
                break
    if not hits:
        return 0.0
    swaps = sum(p != q for p, q in zip(hits, (c for c, t in zip(y, taken, strict=True) if t), strict=True)) / 2
    m = len(hits)
    jaro = (m / len(x) + m / len(y) + (m - swaps) / m) / 3
    prefix = next((i for i, (p, q) in enumerate(zip(x[:4], y[:4])) if p != q), min(4, len(x), len(y)))
    return jaro + prefix * 0.1 * (1 - jaro)


@F.pandas_udf(T.DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler(x, y) if isinstance(x, str) and isinstance(y, str) else None for x, y in zip(a, b, strict=True)], dtype="float64")
