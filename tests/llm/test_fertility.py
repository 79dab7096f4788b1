import random
import re
from collections import Counter

import pandas as pd
import pytest

from recordloom.llm import fertility

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def base(text):
    t = text or ""
    w = WORDS.findall(t)
    windows = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {j for i in range(len(w) - 2) if windows[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORDS.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, len(inside)


TEXTS = ["", None, "one", "a b c a b c", "x\n\nx\n y\nx", "é ü ß # $% |", "a b a b a b a b", "w\x0bv\x0cu\r\nw", "l" * 5000, " \t\n "]


def test_base_counts_against_plain_python(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice("abcd") for _ in range(rng.randint(0, 60))).replace("d d", "d\nd") for _ in range(200)]
    got = fertility.quality_rules(spark.createDataFrame([(i, t, "en", 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, n_words int")).toPandas().set_index("doc_id")
    for i, t in enumerate(texts):
        assert tuple(int(got.loc[i, c]) for c in fertility.BASE) == base(t)
        n, _, _, _, r = base(t)
        assert got.loc[i, "base_failed"] == (n < 50 or 100 * r > 50 * n)
        assert not (got.loc[i, "kept"] and got.loc[i, "base_failed"])


def test_words_are_encoded_as_whole_texts_are():
    encoder = fertility.Encoder(fertility.VOCABULARY)
    text = "Tokenisers split words, for example übermäßig 北京 and zzxqj."
    got = fertility.measure([text], encoder)
    assert got["n_tokens"][0] == len(encoder.model.encode(text))
    assert got["byte_share"][0] >= 0


def test_bands_reject_what_reads_otherwise(spark):
    rng = random.Random(3)
    common = "the of and to in that is was he for it with as his on be at by had not are but from or have".split()
    rows = [(i, " ".join(rng.choice(common) for _ in range(90)), "en") for i in range(200)]
    rows += [(900, " ".join("".join(rng.choice("ᚠᚡᚢᚣᚤ") for _ in range(5)) for _ in range(90)), "en"), (901, None, None)]
    got = fertility.quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).toPandas().set_index("doc_id")
    assert got.loc[:199, "kept"].mean() > 0.99 and not got.loc[900, "kept"] and got.loc[900, "byte_share"] > 0.5 and not got.loc[900, "base_failed"]


def test_empty(spark):
    assert fertility.quality_rules(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0


@pytest.mark.parametrize("texts", [["a b", "c"], [None]])
def test_chunks_cover_every_row(texts):
    assert [i for s in fertility.chunks(pd.Series(texts, dtype=object)) for i in range(len(texts))[s]] == list(range(len(texts)))
