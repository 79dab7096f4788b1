import random

from pyspark.sql import functions as F

from recordloom.llm import packing


def padding(lengths, counts, tokens, ends):
    total = 0
    for x, c, t in zip(lengths, counts, tokens):
        total += next(e for e in ends if e >= x) * c - t
    return total


def brute(lengths, counts, tokens, buckets):
    m = len(lengths)
    best = [[0] + [float("inf")] * m]
    for _ in range(buckets):
        row = [0]
        for j in range(1, m + 1):
            row.append(min(best[-1][i] + lengths[j - 1] * sum(counts[i:j]) - sum(tokens[i:j]) for i in range(j)))
        best.append(row)
    return min(r[m] for r in best[1:])


def test_boundaries_are_optimal():
    rng = random.Random(4)
    for _ in range(200):
        lengths = sorted(rng.sample(range(0, 300), rng.randint(1, 14)))
        counts = [rng.randint(1, 9) for _ in lengths]
        tokens = [c * x for c, x in zip(counts, lengths)]
        k = rng.randint(1, 6)
        ends = packing.optimal_boundaries(lengths, counts, tokens, k)
        assert len(ends) <= k and ends[-1] == lengths[-1]
        assert padding(lengths, counts, tokens, ends) == brute(lengths, counts, tokens, k)


def test_batches_keep_to_the_budget_and_lose_nothing(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(["w"] * rng.choice([0, 1, 3, 3, 3, 40, 41, 200])), "x") for i in range(500)] + [(7, None, "y"), (8, "", "y"), (None, "a b", "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, Slot string")
    out = packing.pack(docs, buckets=4, budget=100).toPandas()
    assert len(out) == len(rows) and "Slot" not in out.columns
    assert (out.n_tokens <= out.bucket_len).all() and out.bucket.nunique() <= 4
    for (_, _), g in out.groupby(["bucket", "batch"]):
        assert len(g) == 1 or len(g) * max(1, g.bucket_len.iloc[0]) <= 100
        assert sorted(g.slot) == list(range(len(g)))
    for _, g in out.groupby("bucket"):  # at most one batch of a bucket isn't full
        fits = max(1, 100 // max(1, int(g.bucket_len.iloc[0])))
        assert (g.groupby("batch").size() < fits).sum() <= 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_boundaries_of_long_texts_are_optimal(spark):
    rng = random.Random(6)
    sizes = [rng.randint(4000, 30_000) for _ in range(60)] + [rng.randint(1, 50) for _ in range(60)]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "doc_id long, n long").withColumn("text", F.lit("w"))
    got = packing.pack(docs, length=F.col("n"), buckets=5).collect()
    lengths = sorted(set(sizes))
    counts = [sizes.count(x) for x in lengths]
    assert sum(r["bucket_len"] - r["n_tokens"] for r in got) == brute(lengths, counts, [c * x for c, x in zip(counts, lengths)], 5)
