import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from recordloom.llm import quality_lm as q


def kneser_ney(texts):
    """Plain interpolated modified Kneser-Ney over symbol strings."""
    top = Counter()
    for t in texts:
        s = [q.SPACE] * (q.ORDER - 1) + [int(q.TABLE[ord(c)]) for c in t]
        top.update(tuple(s[i : i + q.ORDER]) for i in range(len(s) - q.ORDER + 1))
    counts = {q.ORDER: top}
    for k in range(q.ORDER - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    cut, total, left = {}, {}, {}
    for k, c in counts.items():
        n = [sum(v == i for v in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        cut[k] = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)] if all(n) else [0.5, 0.75, 0.9]
        total[k], left[k] = defaultdict(int), defaultdict(float)
        for g, v in c.items():
            total[k][g[:-1]] += v
            left[k][g[:-1]] += cut[k][min(v, 3) - 1]

    def p(g):
        if not g:
            return 1 / q.SYMBOLS
        k, v = len(g), counts[len(g)][g]
        lower = p(g[1:])
        n = total[k][g[:-1]]
        return lower if not n else (v - cut[k][min(v, 3) - 1] if v else 0) / n + left[k][g[:-1]] / n * lower

    return p


def test_model_against_plain_python(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab cdE.1") for _ in range(rng.randint(0, 80))) for _ in range(60)]
    model = q.train(spark.createDataFrame([(t,) for t in texts], "text string"))
    p = kneser_ney(texts)
    assert np.allclose((2.0 ** model.astype(float)).reshape(-1, q.SYMBOLS).sum(axis=1), 1, atol=1e-4)
    for _ in range(300):
        g = tuple(rng.choice([0, 1, 2, q.SPACE, q.CAPITAL, q.DIGIT, 9]) for _ in range(q.ORDER))
        code = sum(s << q.BITS * (q.ORDER - 1 - i) for i, s in enumerate(g))
        assert 2.0 ** float(model[code]) == pytest.approx(p(g), rel=1e-4)


def test_grams_cover_whole_texts():
    codes, lengths = q.grams(["ab", None, "", "é北"])
    assert list(lengths) == [2, 0, 0, 2] and len(codes) == 4
    assert codes[0] == ((q.SPACE * 32 + q.SPACE) * 32 + q.SPACE) * 32 + 0 and codes[3] % 32 == q.LETTER


def test_junk_goes_and_prose_stays(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(80)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(60)), "en") for i in range(300)]
    rows += [(1000 + i, "".join(rng.choice("#|$%XQZ9") for _ in range(300)), "en") for i in range(5)] + [(2000, None, "en"), (2001, "", None), (2002, rows[0][1], "xx"), (1, rows[1][1], "en")]
    labels = spark.createDataFrame([(i, 1) for i in range(150)] + [(1000, 0), (None, 1), (9, None)], "doc_id long, quality int")
    got = q.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string"), labels).toPandas()
    assert len(got) == len(rows)
    kept = got.groupby("doc_id").kept.min()
    assert kept.loc[:299].mean() > 0.97 and not kept.loc[1000:1004].any() and not kept.loc[2000] and not kept.loc[2001] and kept.loc[2002]


def test_without_labels_or_rows(spark):
    docs = spark.createDataFrame([(1, "some text", "en"), (2, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: r["kept"] for r in q.quality(docs, labels).collect()} == {1: True, 2: False}
    assert q.quality(docs.limit(0), labels).count() == 0


def word_model(texts, letters, with_pairs):
    """Plain interpolated word pairs over words over spellings: log2 of the probability of w after v."""
    pairs = Counter()
    for t in texts:
        s = ["<s>", *t.split(), "</s>"]
        pairs.update(zip(s, s[1:], strict=False))
    words = Counter(w for _, w in pairs) if with_pairs else Counter(w for (_, w), c in pairs.items() for _ in range(c))

    def cuts(c):
        n = [sum(x == i for x in c.values()) for i in range(1, 5)]
        y = n[0] / (n[0] + 2 * n[1]) if all(n) else 0
        d = [min(max(i - (i + 1) * y * n[i] / n[i - 1], 0.05), i - 0.05) for i in (1, 2, 3)] if all(n) else [0.5, 0.75, 0.9]
        return lambda x: d[min(x, 3) - 1] if x else 0

    d1, d2 = cuts(words), cuts(pairs)
    total, left = Counter(), Counter()
    for (v, _), c in pairs.items():
        total[v] += c
        left[v] += d2(c)
    n = sum(words.values())
    share = sum(map(d1, words.values())) / n

    def spelled(w):
        if w == "</s>":
            return 2.0**q.STOP
        codes, _ = q.grams([w + " "])
        return float(2.0 ** letters[codes].astype(float).sum()) * (1 - 2.0**q.STOP)

    def log_p(v, w):
        p = (words[w] - d1(words[w])) / n + share * spelled(w)
        if with_pairs and total[v]:
            p = (pairs[v, w] - d2(pairs[v, w])) / total[v] + left[v] / total[v] * p
        return np.log2(p)

    return log_p


@pytest.mark.parametrize(("with_pairs", "hot"), [(True, 0), (True, 12), (False, 0), (False, 1 << 18)])
def test_perplexity_against_plain_python(spark, with_pairs, hot):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcde\u00e9") for _ in range(rng.randint(1, 5))) for _ in range(30)]
    said = lambda: " ".join(vocabulary[min(int(rng.expovariate(0.15)), 29)] for _ in range(rng.randint(1, 40)))
    rows = [(i, said(), "en") for i in range(80)]
    rows += [(100 + i, rows[0][1], "en") for i in range(30)] + [(200, "zz unseen  words\there", "de"), (201, None, "en"), (202, " \n", "en"), (200, "zz unseen  words\there", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1) for i in range(50)], "doc_id long, quality int")
    held = {r["i"] for r in spark.sql(f"select id as i from range(50) where pmod(xxhash64(id), {q.FOLDS}) = 0").collect()}
    texts = [r[1] for r in rows if r[0] < 50 and r[0] not in held]
    log_p = word_model(texts, q.train(spark.createDataFrame([(t,) for t in texts], "text string")), with_pairs)
    got = q.quality(docs, labels, pairs=with_pairs, hot=hot).collect()
    assert len(got) == len(rows)
    text = dict((r[0], r[1]) for r in rows)
    for r in got:
        w = (text[r["doc_id"]] or "").split()
        assert r["n_words"] == len(w)
        if w:
            s = ["<s>", *w, "</s>"]
            want = 2 ** (-sum(log_p(a, b) for a, b in zip(s, s[1:], strict=False)) / (len(w) + 1))
            assert r["perplexity"] == pytest.approx(want, rel=1e-4)
        else:
            assert r["perplexity"] is None and not r["kept"]


def test_registered_query_sees_word_order(spark, tmp_path):
    from recordloom.llm import queries

    rng = random.Random(8)
    names = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 7))) for _ in range(40)]
    follows = {w: rng.sample(names, 3) for w in names}

    def said():
        out = [rng.choice(names)]
        while len(out) < 60:
            out.append(rng.choice(follows[out[-1]]))
        return out

    texts = [said() for _ in range(200)]
    salad = [rng.sample(t, len(t)) for t in texts[150:]]
    rows = [(i, " ".join(t), "en") for i, t in enumerate(texts)] + [(1150 + i, " ".join(t), "en") for i, t in enumerate(salad)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1) for i in range(150)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r["doc_id"]: r for r in queries.op2_quality(spark, str(tmp_path)).collect()}
    assert all(got[1000 + i]["perplexity"] > 2 * got[i]["perplexity"] for i in range(150, 200))
    assert all(got[i]["kept"] for i in range(150, 200)) and not any(got[1000 + i]["kept"] for i in range(150, 200))
