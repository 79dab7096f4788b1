"""Multinomial naive Bayes over token bags: features, counts, prediction, leave-one-out, class vocabulary, scores.

Everything is a join or an aggregation of (document, token, n) rows; the held-out class of leave-one-out is corrected in
closed form, so n refits become one join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import is_digits, words
from . import blocks
from .shared import written

# Words that carry no class.
STOP = (
    "a an and are as at be by com for from gov has have he her his http https if in is it its no not of on or our she that the their this to was we were "
    "will with www you your"
).split()
BODY_TOKENS = 600


def body_tokens(text: Column, limit: int | None = BODY_TOKENS) -> Column:
    """Words that are no stop words, numbers or single letters: the first `limit`, or all."""
    kept = F.filter(words(F.coalesce(text, F.lit(""))), lambda w: (F.length(w) >= 2) & ~w.isin(*STOP) & ~is_digits(w))
    return kept if limit is None else F.slice(kept, 1, limit)


def tokens(docs: DataFrame, id_col: str, text: Column, class_col: str | None = None, limit: int | None = BODY_TOKENS) -> DataFrame:
    """(doc, class, token, n): each word by itself, n = 1. Texts are dealt out by document, so that a file of few parts keeps all
    cores busy, and a document's words lie together."""
    keep = ["doc", *(["class"] if class_col else [])]
    d = docs.select(F.col(id_col).alias("doc"), *([F.col(class_col).alias("class")] if class_col else []), text.alias("text")).repartition("doc")
    return d.select(*keep, F.explode(body_tokens(F.col("text"), limit)).alias("token")).withColumn("n", F.lit(1).cast("long"))


def bags(docs: DataFrame, id_col: str, text: Column, class_col: str | None = None, limit: int | None = BODY_TOKENS) -> DataFrame:
    """(doc, class, token, n), counted where a document's words lie: the texts are shuffled, not their words."""
    each = tokens(docs, id_col, text, class_col, limit)
    return each.groupBy(*[c for c in each.columns if c != "n"]).agg(F.sum("n").alias("n"))


def text_blocks(docs: DataFrame, id_col: str, text: Column, class_col: str, limit: int | None = BODY_TOKENS) -> DataFrame:
    """What `bags` has, as a table of blocks of documents, for `train`, `leave_one_out` and `sweep`."""
    d = docs.select(F.col(id_col).alias("doc"), F.col(class_col).alias("class"), text.alias("text"))
    return blocks.of_texts(d, body_tokens(F.col("text"), limit), F.col("text"))


def features(docs: DataFrame, limit: int | None = BODY_TOKENS) -> DataFrame:
    """(doc, token, n) of docs (doc, format, labels, title, headings, text, url): format, words of labels (stop words too), of title,
    headings and URL, each with its prefix, and of the text. Labels and headings are arrays."""
    all_words = lambda c: words(F.coalesce(c, F.lit("")))
    kept = lambda c: body_tokens(c, None)
    of_each = lambda c, f: F.flatten(F.transform(F.coalesce(F.col(c), F.array().cast("array<string>")), f))
    named = lambda prefix, c: F.transform(c, lambda w: F.concat(F.lit(prefix), w))
    labels = F.filter(of_each("labels", all_words), lambda w: (F.length(w) >= 2) & ~is_digits(w))
    parts = [F.array(F.concat(F.lit("fmt:"), F.coalesce("format", F.lit("")))), named("label:", labels), named("title:", kept(F.col("title"))), named("h:", of_each("headings", kept)), body_tokens(F.col("text"), limit), named("url:", kept(F.col("url")))]
    return docs.select("doc", F.explode(F.concat(*parts)).alias("token")).groupBy("doc", "token").agg(F.count("*").alias("n"))


def train(bag: DataFrame, labels: DataFrame, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """((class, token, hits), (class, docs, tokens)) from bags, or a table of blocks, and (doc, class) of all examples, empty ones included;
    a model for each value of the columns `by`, if any."""
    key = [*by, "class"]
    if "block" in bag.columns:  # a word's counts of one block travel together; those of a class need not be put together by word
        each = blocks.words(bag).select("token", F.col("hits").alias("of"))
        hits = each.repartition("token").select("token", F.inline("of")).groupBy(*key, "token").agg(F.sum("hits").alias("hits"))
        sums = each.select(F.inline("of")).groupBy(*key).agg(F.sum("hits").alias("tokens"))
    else:
        hits = bag.groupBy(*key, "token").agg(F.sum("n").alias("hits"))
        sums = hits.groupBy(*key).agg(F.sum("hits").alias("tokens"))
    totals = labels.groupBy(*key).agg(F.count("*").alias("docs")).join(sums, key, "left").withColumn("tokens", F.coalesce("tokens", F.lit(0)))
    return hits, totals


def posteriors(scores: DataFrame) -> DataFrame:
    """(doc, class, score) as log odds to probabilities, with place: most probable first, ties by class name."""
    per = Window.partitionBy("doc")
    e = scores.withColumn("top", F.max("score").over(per)).withColumn("e", F.exp(F.col("score") - F.col("top")))
    p = e.withColumn("probability", F.col("e") / F.sum("e").over(per))
    return p.withColumn("place", F.row_number().over(per.orderBy(F.desc("probability"), "class"))).select("doc", "class", "probability", "place")


#: Rows of a model that are broadcast: those of the most frequent words.
COMMON = 20_000


def matched(bag: DataFrame, model: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows of bag with those of model, which has one row (on, df, hits) for each word. The most frequent words' rows are broadcast, so
    that most of a text's words are scored where the text lies; only rarer words are shuffled."""
    common = model.orderBy(F.desc("df"), *on).limit(COMMON)
    near = bag.join(F.broadcast(common), list(on))
    far = bag.join(F.broadcast(common.select(*on)), list(on), "left_anti").join(model, list(on))
    return near.unionByName(far)


def by_token(hits: DataFrame, on: Sequence[str]) -> DataFrame:
    """(on, hits array<struct<class, hits>>): a row for each word."""
    return hits.groupBy(*on).agg(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "hits"))).alias("hits"))


def predict(docs: DataFrame, bag: DataFrame, hits: DataFrame, totals: DataFrame, alpha: float = 1.0, by: Sequence[str] = ()) -> DataFrame:
    """Posteriors of each doc of docs (doc). Tokens outside the vocabulary are skipped. Absent (class, token) pairs share
    one value per class, so only present pairs are joined: score = prior + (tokens known) * ln(alpha / denominator) + sum over hits.
    The table of classes is one row per class. Rows of docs and bag are scored by the model with their values of `by`."""
    key, on = list(by) or None, [*by, "token"]  # no columns: one model, joined to all rows
    model = written(by_token(hits, on).join(hits.groupBy(*on).agg(F.sum("hits").alias("df")), on))
    v = model.groupBy(*by).agg(F.count("*").alias("v"))
    examples = totals.groupBy(*by).agg(F.sum("docs").alias("all_docs"))
    frame = totals.join(F.broadcast(v), key).join(F.broadcast(examples), key).withColumn("denominator", F.col("tokens") + alpha * F.col("v"))
    # an entry without a class counts the words known
    entry = F.array(F.struct(F.lit(None).cast(hits.schema["class"].dataType).alias("class"), F.lit(None).cast("long").alias("hits")))
    each = matched(bag, model, on).select("doc", "n", F.inline(F.concat("hits", entry)))
    sums = each.groupBy("doc", "class").agg(F.sum("n").alias("known"), F.sum(F.col("n") * F.log((F.col("hits") + alpha) / F.lit(alpha))).alias("lift"))
    sizes = F.max(F.when(F.col("class").isNull(), F.col("known")))
    found = sums.groupBy("doc").agg(sizes.alias("known"), F.map_from_entries(F.collect_list(F.when(F.col("class").isNotNull(), F.struct("class", "lift")))).alias("lifts"))
    scored = docs.select("doc", *by).join(found, "doc", "left").join(F.broadcast(frame), key)
    lift = F.coalesce(F.try_element_at("lifts", F.col("class")), F.lit(0.0))
    score = F.log(F.col("docs") / F.col("all_docs")) + F.coalesce("known", F.lit(0)) * F.log(F.lit(alpha) / F.col("denominator")) + lift
    return posteriors(scored.select("doc", "class", score.alias("score")))


def held_out_scores(labels: DataFrame, bag: DataFrame, hits: DataFrame, totals: DataFrame, alphas: Sequence[float]) -> DataFrame:
    """(doc, truth, class, scores): log odds of each example under the model without it, one for each smoothing constant. All
    constants share one pass over the words, which are scored in blocks of documents. bag: bags or a table of blocks. An example has
    one class."""
    table = bag if "block" in bag.columns else blocks.of_bags(bag, labels)
    frame = totals.select("class", "docs", "tokens").orderBy("class").collect()  # a row for each class
    classes = [tuple(c) for c in frame if c["class"] is not None]
    places = labels.sparkSession.createDataFrame([(c, i) for i, (c, _, _) in enumerate(classes)], T.StructType([labels.schema["class"], T.StructField("place", T.IntegerType())]))
    seen = blocks.words(table).groupBy("token").agg(F.sum("df").alias("df"))
    by_place = hits.join(F.broadcast(places), "class").groupBy("token").agg(F.collect_list(F.col("hits") * len(classes) + F.col("place")).alias("hits"))
    model = written(seen.join(by_place, "token", "left"))
    known = model.where("df > 1 and hits is not null").select("token", "hits")
    return blocks.scored(table, known, classes, model.count(), sum(c["docs"] for c in frame), [float(a) for a in alphas])


def leave_one_out(labels: DataFrame, bag: DataFrame, hits: DataFrame, totals: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Posteriors of each example under the model without it. labels: (doc, class)."""
    return posteriors(held_out_scores(labels, bag, hits, totals, [alpha]).select("doc", "class", F.col("scores")[0].alias("score")))


# Smoothing constants that are tried, and what a model has to reach: accuracy left one out, and examples.
ALPHAS = (0.1, 0.3, 0.5, 1.0, 2.0)
LEAST_ACCURACY, LEAST_EXAMPLES = 0.80, 8


def sweep(labels: DataFrame, bag: DataFrame, hits: DataFrame, totals: DataFrame, alphas: Sequence[float] = ALPHAS) -> DataFrame:
    """(alpha, examples, accuracy, best, passes): accuracy left one out for each constant; best: the first of the most accurate;
    passes: it is accurate enough on enough examples."""
    scores = held_out_scores(labels, bag, hits, totals, alphas)
    # the most probable class, ties by name
    best_of = [F.min(F.struct((-F.col("scores")[i]).alias("score"), "class"))["class"] for i in range(len(alphas))]
    guesses = scores.groupBy("doc", "truth").agg(F.array(*best_of).alias("guesses"))
    each = guesses.select("truth", F.posexplode("guesses").alias("turn", "guess"))
    right = F.col("guess").eqNullSafe(F.col("truth")).cast("double")
    alpha = F.element_at(F.array(*[F.lit(float(a)) for a in alphas]), F.col("turn") + 1)
    rows = each.groupBy("turn").agg(F.count("*").alias("examples"), F.avg(right).alias("accuracy")).withColumn("alpha", alpha)
    best = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("accuracy"), "turn")) == 1
    return rows.withColumn("best", best).select("alpha", "examples", "accuracy", "best", ((F.col("accuracy") >= LEAST_ACCURACY) & (F.col("examples") >= LEAST_EXAMPLES)).alias("passes"))


def vocabulary(hits: DataFrame, totals: DataFrame, top: int = 10) -> DataFrame:
    """(class, token, hits, lift, place): a class's tokens by lift * ln(1 + hits), those seen once left out."""
    hits = written(hits)
    corpus = hits.groupBy("token").agg(F.sum("hits").alias("everywhere"))
    size = totals.agg(F.sum("tokens").alias("all_tokens"))
    rows = hits.where("hits >= 2").join(corpus, "token").join(totals, "class").crossJoin(F.broadcast(size))
    rows = rows.withColumn("lift", (F.col("hits") / F.col("tokens")) / (F.col("everywhere") / F.col("all_tokens")))
    place = F.row_number().over(Window.partitionBy("class").orderBy(F.desc(F.round(F.col("lift") * F.log1p("hits"), 9)), "token"))
    return rows.withColumn("place", place).where(F.col("place") <= top).select("class", "token", "hits", "lift", "place")


def confusion(pairs: DataFrame) -> DataFrame:
    """(truth, guess, n)."""
    return pairs.groupBy("truth", "guess").agg(F.count("*").alias("n"))


def scores(pairs: DataFrame) -> DataFrame:
    """(class, precision, recall, f1, support) from (truth, guess); an absent denominator gives 0."""
    by = lambda c: pairs.groupBy(F.col(c).alias("class")).agg(F.count("*").alias(f"n_{c}"))
    right = pairs.where("truth = guess").groupBy(F.col("truth").alias("class")).agg(F.count("*").alias("tp"))
    rows = by("truth").join(by("guess"), "class", "full").join(right, "class", "left").na.fill(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    rows = rows.withColumn("precision", share(F.col("tp"), F.col("n_guess"))).withColumn("recall", share(F.col("tp"), F.col("n_truth")))
    return rows.select("class", "precision", "recall", share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), F.col("n_truth").alias("support"))


def overall(pairs: DataFrame, none: str = "none") -> DataFrame:
    """(macro_f1, positive_accuracy, examples) of (truth, guess): the mean F1 of the classes that occur as truth but `none`, and the
    share of examples of these that are guessed right."""
    f1 = scores(pairs).where((F.col("support") > 0) & (F.col("class") != none)).agg(F.coalesce(F.avg("f1"), F.lit(0.0)).alias("macro_f1"))
    positive = F.col("truth") != none
    right = pairs.agg(F.coalesce(F.avg(F.when(positive, (F.col("truth") == F.col("guess")).cast("double"))), F.lit(0.0)).alias("positive_accuracy"), F.count("*").alias("examples"))
    return right.crossJoin(F.broadcast(f1)).select("macro_f1", "positive_accuracy", "examples")
