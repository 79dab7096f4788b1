import random

import numpy as np
from pyspark.sql import functions as F

from recordloom.llm import toxicity


def corpus(spark, n=1500):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("aeioulmnrst") for _ in range(5))
    words = [word() for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(40)]
        bad = i % 8 == 0
        if bad:
            for _ in range(rng.randint(1, 6)):
                w[rng.randrange(40)] = rng.choice(["grumbolt", "Grumbolted,", "VEXXING!", "vexxed"])
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.fit(docs, spark.createDataFrame([x for x in labels if x[0] < 1000] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = toxicity.severity(docs.where("doc_id >= 1000"), model).toPandas().set_index("doc_id")
    truth = {i: t for i, t in labels}
    assert np.mean([got.loc[i, "toxic"] == bool(truth[i]) for i in got.index]) > 0.99
    assert len(model.thresholds) == 3 and (np.diff(model.thresholds) > 0).all()
    assert ((got.expected_severity >= 0) & (got.expected_severity <= 3)).all()


def test_probabilities_are_cumulative_and_gradients_right():
    rng = np.random.default_rng(0)
    n = 400
    x = rng.standard_normal(n)
    grades = np.digitize(x * 2 + rng.logistic(size=n), [-1, 0.5, 2])
    w, t = toxicity.fit_ordinal(np.arange(n), np.zeros(n, int), x, grades, 1, ridge=0.0)

    def loss(w, t):
        a = np.concatenate([np.ones((n, 1)), 1 / (1 + np.exp(t[None] - w * x[:, None])), np.zeros((n, 1))], axis=1)
        return -np.log(a[np.arange(n), grades] - a[np.arange(n), grades + 1]).mean()

    best = loss(w[0], t)
    for k in range(4):  # no step along a coordinate lowers the loss
        for s in (-0.02, 0.02):
            moved = t.copy()
            if k < 3:
                moved[k] += s
            assert loss(w[0] + (s if k == 3 else 0), moved) > best - 1e-4


def test_edges(spark):
    docs, _ = corpus(spark, 50)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(docs, none)
    odd = spark.createDataFrame([(1, None, 1), (1, None, 1), (2, "", 1), (None, "x", 1)], "doc_id long, text string, toxic int")
    assert toxicity.severity(odd, model).where("toxic").count() == 0
    assert toxicity.severity(odd, model).count() == 4
    assert toxicity.harmless(odd, model).count() == 4 and toxicity.severity(docs.limit(0), model).count() == 0
    assert docs.select(F.lit(1)).count() == 50
