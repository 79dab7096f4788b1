"""The packed forms in which texts and weights of the quality model meet."""

import numpy as np
import pandas as pd
import pytest

from recordloom.llm import quality_lm as q

RNG = np.random.default_rng(3)


@pytest.mark.parametrize("x", [[0], [255, 256, 0], [2**64 - 1, 1], list(range(1000)), RNG.integers(0, 2**63, 500).tolist()])
def test_integers_come_back(x):
    a = np.array(x, np.uint64)
    assert (q.widened(q.narrowed(a)) == a).all() and (q.from_gaps(q.gaps(np.sort(a))) == np.sort(a)).all()
    assert len(q.narrowed(np.array([7, 8], np.uint64))) == 3


def test_logarithms_come_back_to_the_step():
    x = np.concatenate([[0.0, -0.0, 1.5, -1.5, 60.0, -60.0], RNG.standard_normal(500) * 20])
    assert np.abs(q.from_fixed(q.fixed(x)) - x).max() <= 2.0**-17


def test_higher_grams_have_higher_shards():
    for bits in (40, 48, 64):
        g = np.sort(RNG.integers(0, 2 ** min(bits, 63), 5000, dtype=np.int64).astype(np.uint64))
        s = q.shard_of(g, 7, bits)
        assert (np.diff(s) >= 0).all() and s.min() >= 0 and s.max() < 7


def rows(shard, kind, **fields):
    return {"shard": shard, "kind": kind, **fields}


def test_shards_weigh_what_blocks_ask_and_blocks_sum():
    a, b = np.array([3, 9, 12], np.uint64), np.array([20, 21], np.uint64)
    weights = [rows(0, 0, grams=q.gaps(a[:2]), weights=q.fixed(np.array([1.0, 2.0]))), rows(0, 0, grams=q.gaps(a[2:]), weights=q.fixed(np.array([-4.0]))), rows(1, 0, grams=q.gaps(b), weights=q.fixed(np.array([8.0, 16.0])))]
    ask = lambda shard, block, grams, held, texts: rows(shard, 1, block=block, grams=q.gaps(np.array(grams, np.uint64)), held=q.narrowed(np.array(held)), texts=q.narrowed(np.array(texts)))
    asked = [ask(0, 5, [3, 10, 12], [2, 1, 1], [0, 2, 1, 2]), ask(0, 6, [9], [1], [0]), ask(1, 5, [21], [3], [1, 1, 2]), ask(2, 5, [99], [1], [0])]
    facts = [rows(1, 2, block=5, facts='[["7", "en", 10, 2, 0.5], [null, null, 0, 0, 0.0], ["9", "de", 4, 1, -1.0]]'), rows(0, 2, block=6, facts='[["8", "en", 3, 1, 0.0]]')]
    met = sorted([*weights, *asked, *facts], key=lambda r: (r["shard"], r["kind"]))
    frames = [q.meeting(met[i : i + 2]) for i in range(0, len(met), 2)]  # a shard's rows cross batches
    sums = pd.concat(q.weighed(iter(frames))).sort_values("block", kind="stable")
    got = pd.concat(q.summed(iter([sums.iloc[:2], sums.iloc[2:]])))
    assert got["doc_id"].tolist() == ["7", None, "9", "8"]
    assert got["logs"].round(6).tolist() == [1.5, 32.0, 12.0, 2.0]


def test_judged_asks_for_what_is_not_shipped():
    none = q.Known(np.zeros(q.SYMBOLS**q.ORDER, np.float32), np.array([1], np.uint64), 0.5, True, 40, q.gaps(np.array([2**40 - 1], np.uint64)), q.fixed(np.zeros(1)), q.zlib.compress(b"\xff" * (1 << (q.BITMAP - 3)), 1))
    n, logs, asked = none.judged(["a b a b", None, "c"])
    assert n.tolist() == [4, 0, 1] and len(logs) == 3
    (words, of_words), (pairs, of_pairs) = asked
    assert np.bincount(of_words, minlength=3).tolist() == [6, 2, 3] and np.bincount(of_pairs, minlength=3).tolist() == [5, 1, 2]
    assert (np.diff(words.astype(np.int64)) >= 0).all() and (np.diff(pairs.astype(np.int64)) >= 0).all()
