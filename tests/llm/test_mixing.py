import pytest
from pyspark.sql import functions as F

from recordloom.llm import mixing


def water(sizes, weights, cap):
    total, left = sum(sizes.values()), set(sizes)
    out = {}
    need = total
    while left:
        share = {s: need * weights[s] / sum(weights[x] for x in left) for s in left}
        over = [s for s in left if share[s] > cap * sizes[s]]
        if not over:
            return out | share
        for s in over:
            out[s] = cap * sizes[s]
            need -= out[s]
            left.discard(s)
    return out


def make(spark, sizes, per=20):
    rows, i = [], 0
    for s, n in sizes.items():
        for k in range(per):
            i += 1
            rows.append((i, " ".join(["w"] * (n // per)), s))
    return spark.createDataFrame(rows, "doc_id long, text string, source string")


@pytest.mark.parametrize("sizes", [{"a": 200, "b": 4000, "c": 1000, None: 20000}, {"a": 1000, "b": 1000}, {"a": 40, "b": 40, "c": 90000, "d": 60}])
def test_targets_follow_iterated_clamping(spark, sizes):
    got = mixing.mix_sources(make(spark, sizes)).groupBy("source").agg(F.first("source_size").alias("n"), F.first("target").alias("t"), F.sum("taken").alias("taken")).collect()
    names = sorted(s for s in sizes if s) + [s for s in sizes if s is None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = water(sizes, weights, 3)
    for r in got:
        assert r["n"] == sizes[r["source"]] and r["t"] == pytest.approx(want[r["source"]])
        assert abs(r["taken"] - r["t"]) <= sizes[r["source"]] / 20  # a document


def test_reruns_agree_and_edges(spark):
    rows = [(1, None, "a", 9), (2, "", "a", 9), (3, "x y z", None, 9), (3, "x y z", None, 9), (None, "q", "b", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, Target long")
    a, b = (sorted(map(str, mixing.mix_sources(docs).collect())) for _ in range(2))
    assert a == b and len(a) == 5
    assert all(r["taken"] <= 3 * r["size"] for r in mixing.mix_sources(docs).collect())
    assert mixing.mix_sources(docs.limit(0)).count() == 0
    assert mixing.repeated(mixing.mix_sources(docs)).columns == ["doc_id", "text", "source"]


def test_repeats(spark):
    docs = make(spark, {"a": 200, "b": 4000})
    mixed = mixing.mix_sources(docs)
    assert mixing.repeated(mixed).count() == mixed.agg(F.sum("copies")).first()[0]
