import math
import random
from collections import Counter, defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recordloom.operators import blocks, classify
from recordloom.plans import queries_documents, queries_operations


def documents(spark, path, rows):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").coalesce(1).write.parquet(f"{path}/documents.parquet")


def expected(sql, path):
    c = duckdb.connect()
    c.execute(f"create view documents as from '{path}/documents.parquet/*.parquet'")
    return sorted(c.execute(sql).fetchall(), key=repr)


def small(monkeypatch):
    """Blocks of a few documents, classes one or two at a time, words a few at a time."""
    for name, most in (("BYTES", 200), ("ROWS", 40), ("CELLS", 30), ("AT_ONCE", 7)):
        monkeypatch.setattr(blocks, name, most)


@pytest.mark.parametrize("name", ["nb_sweep", "nb_leave_one_out"])
def test_blocks_equal_sql(spark, tmp_path, monkeypatch, name):
    small(monkeypatch)
    rng, names = random.Random(8), ["tax", "roll", "deed", "Court", "bid", "permit", "lien", "saleDate"]
    rows = [(i, " ".join([*rng.choices(names[i % 4 : i % 4 + 5], k=rng.randint(0, 12)), *(["lone%d" % i] * (i % 3))]), "abc"[i % 3], "stuv"[i % 4]) for i in range(60)]
    rows += [(100, None, "a", "s"), (101, "", "b", "t"), (102, "the of 7 x", "a", "s"), (None, "tax roll", "a", "s"), (103, "tax deed bid", "a", None)]
    documents(spark, tmp_path, rows)
    held = queries_operations if name == "nb_sweep" else queries_documents
    got = sorted((tuple(r) for r in held.QUERIES[name](spark, str(tmp_path)).collect()), key=repr)
    assert got == expected(held.ORACLE_SQL[name], tmp_path)


def test_blocks_without_known_words(spark, tmp_path):
    documents(spark, tmp_path, [*[(i, None if i % 2 else "lone%d" % i, "ab"[i % 3 == 0], "s") for i in range(40)], (50, "tax deed", "a", "s"), (51, "tax bid", "b", "s")])
    got = sorted((tuple(r) for r in queries_documents.nb_leave_one_out(spark, str(tmp_path)).collect()), key=repr)
    assert len(got) == 42 and got == expected(queries_documents.ORACLE_SQL["nb_leave_one_out"], tmp_path)


def test_bags_and_texts_make_the_same_blocks(spark, monkeypatch):
    small(monkeypatch)
    rng = random.Random(2)
    rows = [(i, "abc"[i % 3], " ".join(rng.choices(["w%d" % j for j in range(12)], k=i % 9))) for i in range(40)]
    rows.append((38, rows[38][1], "w1 w1 w13"))  # two texts of one document
    d = spark.createDataFrame(rows, "doc long, class string, text string")
    labels, bag, texts = d.select("doc", "class"), classify.bags(d, "doc", F.col("text"), "class"), classify.text_blocks(d, "doc", F.col("text"), "class")
    seen = lambda t: sorted((r["doc"], r["class"], r["scores"]) for r in classify.held_out_scores(labels, t, *classify.train(t, labels), [0.5, 2.0]).collect())
    got = seen(texts)
    # the model of all others, fitted anew for each
    for doc, _, text in rows[::7]:
        rest = [r for r in rows if r[0] != doc]
        hits, docs = defaultdict(Counter), Counter(c for _, c, _ in rest)
        for _, c, t in rest:
            hits[c].update(t.split())
        v = len(set().union(*hits.values()))
        for c in "abc":
            (scores,) = [s for i, k, s in got if (i, k) == (doc, c)]
            for a, score in zip([0.5, 2.0], scores):
                known = [w for w in text.split() if any(w in h for h in hits.values())]
                want = math.log(docs[c] / len(rest)) + sum(math.log((hits[c][w] + a) / (sum(hits[c].values()) + a * v)) for w in known)
                assert score == pytest.approx(want, abs=1e-9)
    assert [x[:2] for x in seen(bag)] == [x[:2] for x in got] and all(x[2] == pytest.approx(y[2], abs=1e-9) for x, y in zip(seen(bag), got))


def test_words_go_out_once_for_each_block(spark, tmp_path):
    """Rows that are shuffled don't multiply by the classes that a document's words meet."""
    documents(spark, tmp_path, [(i, "one two three four", "a", f"s{i % 50}") for i in range(400)])
    d = spark.read.parquet(f"{tmp_path}/documents.parquet").select(F.col("doc_id").alias("doc"), F.col("source").alias("class"), "text")
    texts = classify.text_blocks(d, "doc", F.col("text"), "class")
    n = spark.sparkContext.defaultParallelism
    assert blocks.words(texts).count() <= 4 * n and blocks.examples(texts).count() == 400
    plan = queries_operations.nb_sweep(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    dealt = [x for x in plan.splitlines() if "Exchange hashpartitioning(" in x]
    assert any("hashpartitioning(block" in x for x in dealt) and not any("hashpartitioning(doc" in x and "class" in x for x in dealt)


def test_a_block_computed_again_has_the_same_words(monkeypatch):
    class Task:
        partitionId = staticmethod(lambda: 3)

    monkeypatch.setattr(blocks, "TaskContext", type("T", (), {"get": staticmethod(lambda: Task)}))
    rows = [(1, "a", ["x", "y", "x"]), (2, "b", ["z", "y"]), (3, None, []), (4, "a", ["w"])]

    def seen(rows):
        table = pa.table({"doc": pa.array([r[0] for r in rows]), "class": pa.array([r[1] for r in rows], pa.string()), "tokens": pa.array([r[2] for r in rows], pa.list_(pa.string())), "ns": pa.nulls(len(rows), pa.list_(pa.int64()))})
        out = pa.Table.from_batches(blocks.counted(iter(table.to_batches(2)))).to_pylist()
        return [r for r in out if r["word"] is not None], {r["doc"]: r for r in out if r["word"] is None}

    assert seen(rows)[1] == seen(rows[::-1])[1] and [r["token"] for r in seen(rows)[0]] == ["w", "x", "y", "z"]
    assert seen(rows)[1][1]["words"] == [1, 2] and seen(rows)[1][1]["counts"] == [2, 1] and [r["df"] for r in seen(rows)[0]] == [1, 1, 2, 1]
