import math
import random
import re

import numpy as np
import pytest

from recordloom.llm import lexical_search

DOCS, ITEMS = "doc_id long, text string, lang string, score string, rank long", "item_id long, text string, doc_id string"


def brute(docs, items, top=10):
    low = str.maketrans(lexical_search.UPPER, lexical_search.LOWER)
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(low))
    bags = [(i, split(t)) for i, t in docs]
    bags = [(i, ts) for i, ts in bags if ts]
    n, total = len(bags), sum(len(ts) for _, ts in bags)
    holding = {}
    for _, ts in bags:
        for t in set(ts):
            holding[t] = holding.get(t, 0) + 1
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(split(t))
    out = []
    for i, terms in asked.items():
        scored = []
        for d, ts in bags:
            m = 10 + (90 * len(ts) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * holding[t] + 1))) * ((10**9 * ts.count(t)) // (1000 * ts.count(t) + 8 * m)) for t in terms if t in ts)
            if s > 0:
                scored.append((-s, d is None, d or 0, d))
        out += [(i, k + 1, x[3], -x[0]) for k, x in enumerate(sorted(scored, key=lambda x: x[:3])[:top])]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def run(spark, docs, items):
    d = spark.createDataFrame([(i, t, "x", "s", 1) for i, t in docs], DOCS)
    it = spark.createDataFrame([(i, t, "y") for i, t in items], ITEMS)
    got = lexical_search.search(d, it)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    return sorted(map(tuple, got.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


@pytest.mark.parametrize("postings", [60, 1_000_000])
def test_against_brute_force(spark, monkeypatch, postings):
    monkeypatch.setattr(lexical_search, "POSTINGS", postings)
    r = random.Random(5)
    words = [f"w{i}" for i in range(60)] + ["Été", "naïve", "ÉTÉ", "X1"]
    docs = [(i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(1, 80)))) for i in range(400)]
    docs += [(500 + i, docs[7][1]) for i in range(150)]  # copies: ties by identifier
    docs += [(3, docs[3][1]), (3, "w1"), (None, docs[7][1]), (900, None), (901, ""), (902, "... --"), (903, "w5 " * 20_000)]
    r.shuffle(docs)
    items = [(i, " ".join(r.choices(words, k=12))) for i in range(20)] + [(20, None), (21, ""), (22, "unseen"), (None, "W3 w4"), (4, "w9"), (30, docs[0][1])]
    assert run(spark, docs, items) == brute(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], [(1, "a")]) == [] and run(spark, [(1, "a")], []) == [] and run(spark, [(1, None)], [(1, "a")]) == []


def test_blocks_of_items_give_the_same(spark, monkeypatch):
    docs = [(i, f"a{i % 7} b{i % 3} c") for i in range(50)]
    items = [(i, f"a{i} b{i % 2}") for i in range(9)]
    whole = run(spark, docs, items)
    monkeypatch.setattr(lexical_search, "ITEM_BYTES", 60)
    assert run(spark, docs, items) == whole == brute(docs, items)


def test_range_maxima_bound_intervals_and_find_their_documents():
    r = np.random.default_rng(1)
    docs = [np.sort(r.choice(12, r.integers(1, 12), False)) for _ in range(300)]
    ends = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    terms, tfs = np.concatenate(docs), r.integers(1, 9, ends[-1])
    s = lexical_search.Shard(list(range(300)), r.integers(1, 50, 300), ends, terms, tfs, np.arange(12) + 5, 300, 9000)
    asked = np.arange(12)
    for a, b in [(0, 300), (5, 6), (17, 250), (40, 44)]:
        lo, hi = s.at(asked, np.array([a])), s.at(asked, np.array([b]))
        bound, split = s.largest(lo, hi)
        parts = [s.impact[x:y] for x, y in zip(lo[0], hi[0])]
        assert bound[0] == sum(p.max() for p in parts if len(p)) and a <= split[0] < b
        assert max(p.max() for p in parts if len(p)) == max(i for x, y in zip(lo[0], hi[0]) for i, d in zip(s.impact[x:y], s.doc[x:y]) if d == split[0])


def test_copies_split_inside_their_interval():
    s = lexical_search.Shard(list(range(4096)), np.full(4096, 3), np.arange(4097), np.zeros(4096, int), np.ones(4096, int), np.array([9]), 4096, 4096 * 3)
    for a, b in [(0, 4096), (100, 2000), (64, 129)]:
        _, split = s.largest(np.array([[a]]), np.array([[b]]))
        assert a + (b - a) / 8 <= split[0] <= b - (b - a) / 8
