import random

import numpy as np
import pytest

from recordloom.llm import repeated_spans as rs

DOCS = "doc_id long, text string, spans string, chunk long"


def brute(docs):
    """The removed bytes of each row, rows in the order that the docstring gives (identifiers differ here)."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0)):
        data = (text or "").encode()
        gone = [False] * len(data)
        for a in range(len(data) - 99):
            s = data[a : a + 100]
            if s in seen:
                gone[a : a + 100] = [True] * 100
            seen.add(s)
        spans, kept = [], bytes(b for b, g in zip(data, gone) if not g)
        for a, g in enumerate(gone):
            if g and spans and spans[-1][1] == a:
                spans[-1] = (spans[-1][0], a + 1)
            elif g:
                spans.append((a, a + 1))
        out[i] = (len(data), spans, kept)
    return out


def run(spark, docs):
    got = rs.repeated_spans(spark.createDataFrame([(i, t, "x", 1) for i, t in docs], DOCS)).collect()
    assert len(got) == len(docs)
    return {r["id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]], bytes(r["kept"])) for r in got}


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdeé ", k=r.randint(2, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passage, line = text(40), text(17)
    docs = [text(r.randint(0, 60)) for _ in range(40)]
    docs += [text(9) + passage + text(r.randint(0, 9)) for _ in range(30)]  # one passage with changing neighbours
    docs += [docs[3]] * 5 + [docs[50][:-1] + "!", docs[50][1:], docs[45] * 3, line + "\n" + line + "\n" + line]
    docs += ["a" * 700, "a" * 99, "a" * 100, "a" * 101, "ab" * 300, "", None, "\0" * 300, "x" * 200 + "\0" * 150, "é" * 130]
    r.shuffle(docs)
    return list(enumerate(docs, -3))


@pytest.mark.parametrize("hot", [1, 4096])
def test_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(rs, "HOT", hot)
    monkeypatch.setattr(rs, "CHUNK", 3000)
    docs = corpus(4) + [(None, corpus(4)[7][1])]
    assert run(spark, docs) == brute(docs)


def test_by_shuffle_and_over_blocks_of_a_long_text(spark, monkeypatch):
    monkeypatch.setattr(rs, "BROADCAST_BYTES", 0)
    r = random.Random(2)
    long = "".join(r.choices("abcdefgh", k=600_000))
    docs = [(5, "y" + long[262_000:263_000]), (1, long), (9, long[100:400] + "z" + long[599_800:])]
    assert run(spark, docs) == brute(docs)


def test_repeated_rows_keep_one(spark):
    t = "".join(random.Random(1).choices("abcdefgh", k=500))
    got = rs.repeated_spans(spark.createDataFrame([(1, t, "", 0)] * 3 + [(1, t[:250] + "w", "", 0), (2, t, "", 0)], DOCS)).collect()
    assert sorted(len(r["kept"]) for r in got if r["n_bytes"] == 500 and r["id"] == 1)[:2] == [0, 0] and [bytes(r["kept"]) for r in got if r["id"] == 2] == [b""]
    assert sum(len(r["kept"]) for r in got) in (500 + 1, 251 + 500 - 250 + 99)  # whichever of the two texts with one identifier comes first


def test_empty_tables(spark):
    assert run(spark, []) == {} and run(spark, [(1, None)]) == {1: (0, [], b"")}


def test_run_index_against_windows():
    r = random.Random(6)
    for _ in range(60):
        base = "".join(r.choices("ab", k=60)).encode()
        texts = list(dict.fromkeys(bytes(r.choice(base[i:] or b"a") if r.random() < 0.05 else x for i, x in enumerate(base[r.randint(0, 9) : r.randint(30, 60)])) for _ in range(r.randint(1, 12))))
        index = rs.RunIndex(texts, 12)
        seen, want = set(), []
        for t in texts:
            for a in range(len(t)):
                s = t[a : a + 12]
                want.append(len(s) == 12 and s in seen)
                seen |= {s} if len(s) == 12 else set()
            want.append(False)
        assert index.repeated().tolist() == want


def test_suffixes_are_in_order():
    r = np.random.default_rng(3)
    for n in (1, 2, 50, 400):
        codes = np.append(r.integers(1, 3, n), 0).astype(np.uint16)
        suffix, rank = rs.suffix_array(codes)
        assert suffix.tolist() == sorted(range(n + 1), key=lambda i: codes[i:].tolist()) and rank[suffix].tolist() == list(range(n + 1))


def test_equal_windows_have_equal_anchors():
    data = bytes(random.Random(9).choices(b"abcd", k=5000))
    whole, part = rs.Windows(data, np.array([5000])), rs.Windows(b"zz" + data[1000:3000], np.array([2002]))
    keys = lambda w: {s + j: k for s, n, k in zip(w.start, w.n, w.key) for j in range(n)}
    a, b = keys(whole), keys(part)
    assert sorted(a) == list(range(4901)) and all(a[998 + p] == k for p, k in b.items() if p >= 2)
