import numpy as np

from recordloom.llm import ann


def brute(ids, x, k=10, every=5):
    out = {}
    for i, v in zip(ids, x):
        if i % every == 0:
            d = np.sqrt(((x - v) ** 2).sum(axis=1))
            out[i] = [(int(ids[j]), d[j]) for j in np.lexsort((ids, d)) if ids[j] != i][:k]
    return out


def frame(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(a) for a in v], 0) for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score int")


def test_recall_and_order_on_clusters(spark):
    rng = np.random.default_rng(3)
    x = (rng.standard_normal((40, 16))[rng.integers(0, 40, 1200)] * 3 + rng.standard_normal((1200, 16)) * 0.3).astype(np.float32).astype(float)
    ids = rng.permutation(5000)[:1200]
    got = ann.neighbours(frame(spark, ids, x), every=5).toPandas()
    want = brute(ids, x)
    hit = 0
    for q, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 11)) and g.score.is_monotonic_increasing and q not in set(g.vec_id)
        hit += len(set(g.vec_id) & {i for i, _ in want[q]})
    assert hit / (10 * len(want)) >= 0.9 and set(got.query_id) == set(want)


def test_copies_ties_and_unsound_vectors(spark):
    rows = [(i, [1.0, 0.0], 1) for i in range(0, 60)] + [(100, [0.0, 1.0], 1), (100, [0.0, 1.0], 1), (200, None, 1), (201, [0.0, 0.0], 1), (202, [float("nan"), 1.0], 1), (203, [None, 1.0], 1), (204, [1.0], 1), (None, [1.0, 1.0], 1), (205, [float("inf"), 1.0], 1)]
    got = ann.neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), every=50).toPandas()
    by = {q: list(zip(g.sort_values("rank").vec_id, g.sort_values("rank").score)) for q, g in got.groupby("query_id")}
    assert set(by) == {0, 50, 100}
    assert by[0] == [(i, 0.0) for i in range(1, 11)] and by[50] == [(i, 0.0) for i in range(10)]
    assert [v for v, _ in by[100]] == list(range(10)) and abs(by[100][0][1] - 2**0.5) < 1e-12


def test_few_rows_and_none(spark):
    got = ann.neighbours(frame(spark, [0, 1, 2], np.eye(3)), every=2).toPandas()
    assert len(got) == 4 and ann.neighbours(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_hilbert_is_a_continuous_bijection():
    n = 4
    cells = np.stack(np.meshgrid(*[np.arange(1 << n)] * 2, indexing="ij"), axis=-1).reshape(-1, 2)
    keys = ann.hilbert(cells, n)
    assert sorted(keys) == list(range(1 << 2 * n))
    path = cells[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()
