import random
import re
from itertools import combinations

import numpy as np
import pytest

from recordloom.llm import near_dedup
from recordloom.llm.components import connected_components

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORDS.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, s), (b, t) in combinations(sets, 2):
        if s and t and 100 * len(s & t) >= 75 * len(s | t):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {i: find(i) for i in up}


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    passage = [word() for _ in range(40)]
    rows = []
    for i in range(n):
        w = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.3:
            w[3:3] = passage
        rows.append(w)
        for _ in range(rng.choice([0, 0, 1, 6])):
            c = list(w)
            for _ in range(rng.randint(0, 6)):
                c[rng.randrange(len(c))] = word()
            rows.append(c)
    texts = [(" " if rng.random() < 0.5 else "\n").join(x) for x in rows]
    texts = [t.upper() if rng.random() < 0.1 and t.isascii() else t for t in texts]
    ids = rng.sample(range(10_000), len(texts))
    return list(zip(ids, texts)) + [(20_001, None), (20_002, ""), (20_003, " \n"), (20_004, "one two"), (20_005, "One  two"), (20_006, "one two three")]


@pytest.mark.parametrize("small", [1500, 6])
def test_against_brute_force(spark, small):
    rows = corpus(3)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = near_dedup.near_duplicates(docs, small=small).toPandas()
    want = brute(rows)
    assert dict(zip(got.doc_id, got.component_id)) == want
    assert dict(zip(got.doc_id, got.n_shingles)) == {i: len(shingles(t)) for i, t in rows}
    assert (got.kept == (got.doc_id == got.component_id)).all()


def test_blocks_of_a_large_cluster(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK_DOCS", 4)
    rows = corpus(8, 20)
    got = near_dedup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).toPandas()
    assert dict(zip(got.doc_id, got.component_id)) == brute(rows)


def test_edges(spark):
    long = " ".join(str(i) for i in range(30_000))
    docs = spark.createDataFrame([(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (9, long), (8, long + " x")], "doc_id long, text string")
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_duplicates(docs).collect()}
    assert got == {(5, 5, True), (None, None, True), (9, 8, False), (8, 8, True)}
    assert near_dedup.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(str(r["doc_id"]) for r in near_dedup.deduplicated(docs).collect()) == ["5", "8", "None"]


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(50)] + [(1000, i) for i in range(1001, 1100)] + [(7, 7), (3, 2), (2, 3)]
    got = {r["id"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {i: 1000 for i in range(1000, 1100)}


def test_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    b = np.concatenate([a[:3000], rng.integers(0, 2**63, 1000, dtype=np.uint64)])
    assert abs((near_dedup.sketch(a) == near_dedup.sketch(b)).mean() - 0.6) < 0.17
