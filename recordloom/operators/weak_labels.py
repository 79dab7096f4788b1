"""Weak supervision of column labels: labelling functions vote, an iterated weighted vote decides."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import slug
from ..functions.values import KINDS, validate
from .operations import ranked

# The least weight of a function, that of one that never fired, rounds, the share of weight that is confident, the least
# rate in log odds, and the change that is none.
FLOOR, SILENT, ROUNDS, CONFIDENT, LEAST, SETTLED = 0.05, 0.1, 20, 0.5, 1e-3, 1e-4


def exact_votes(columns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(example, lf, class): columns (example, name) whose slug is a lexicon entry (term, class); several classes abstain."""
    hits = columns.select("example", slug(F.col("name")).alias("term")).join(lexicon, "term").groupBy("example").agg(F.count_distinct("class").alias("n"), F.min("class").alias("class"))
    return hits.where("n = 1").select("example", F.lit("lexicon_exact").alias("lf"), "class")


def token_votes(columns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(example, lf, class): the one class that has a term of two words or more all of which are in the name; several classes abstain."""
    parts = F.split(slug(F.col("term")), "_")
    terms = lexicon.select("class", "term", parts.alias("parts")).where(F.size("parts") >= 2).select("class", "term", F.explode(F.array_distinct("parts")).alias("token"), F.size(F.array_distinct("parts")).alias("wanted"))
    tokens = columns.select("example", F.explode(F.array_distinct(F.split(slug(F.coalesce("name", F.lit(""))), "_"))).alias("token"))
    whole = tokens.join(terms, "token").groupBy("example", "class", "term", "wanted").agg(F.count("*").alias("n")).where("n = wanted")
    one = whole.groupBy("example").agg(F.count_distinct("class").alias("n"), F.min("class").alias("class")).where("n = 1")
    return one.select("example", F.lit("lexicon_token").alias("lf"), "class")


STRONG = ("id", "money", "date", "email", "phone", "number")


def accepted(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """(example, field, kind, passed, n): how many of a column's n values each field takes. columns: (example, values), fields:
    (field, kind), which is configuration."""
    each = columns.select("example", F.size("values").alias("n"), F.explode("values").alias("v"))
    ok = F.coalesce(*[F.when(F.col("kind") == k, validate(k, F.col("v"))) for k in KINDS], F.lit(False))
    kinds = F.broadcast(fields.select("kind").distinct())
    by_kind = each.crossJoin(kinds).groupBy("example", "kind", "n").agg(F.count_if(ok).alias("passed"))
    return by_kind.join(F.broadcast(fields.select("field", "kind")), "kind").select("example", "field", "kind", "passed", "n")


def unique_votes(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """(example, lf, class): columns of two values or more all of which pass exactly one field of a strict kind."""
    hits = accepted(columns, fields).where(F.col("kind").isin(*STRONG) & (F.col("n") >= 2) & (F.col("passed") == F.col("n")))
    one = hits.groupBy("example").agg(F.count("*").alias("claims"), F.min("field").alias("class")).where("claims = 1")
    return one.select("example", F.lit("validator_unique").alias("lf"), "class")


def veto_votes(columns: DataFrame, fields: DataFrame) -> DataFrame:
    """(example, lf, class): none for columns of two values or more of which no field takes any."""
    sums = accepted(columns, fields).where("n >= 2").groupBy("example").agg(F.max("passed").alias("most")).where("most = 0")
    return sums.select("example", F.lit("validator_veto").alias("lf"), F.lit("none").alias("class"))


def told_votes(columns: DataFrame, told: DataFrame) -> DataFrame:
    """(example, lf, class): labels that a language model gave columns of that domain and name, the last one (seq) if several."""
    last = told.where("coalesce(label, '') != ''").groupBy("domain", "name").agg(F.max_by("label", "seq").alias("class"))
    return columns.join(last, ["domain", "name"]).select("example", F.lit("llm").alias("lf"), "class")


def weak_labels(columns: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(example, class, masked) of columns (example, name, display) by lexicon (term, class): the class whose term either name is;
    masked where the names disagree, or where neither is a term but touches one (either holds the other, four letters or more)."""
    slugs = columns.select("example", slug(F.coalesce("name", F.lit(""))).alias("a"), slug(F.coalesce("display", F.lit(""))).alias("b"))
    first = lexicon.groupBy("term").agg(F.min("class").alias("class"))  # a term of several fields names the first
    hit = lambda c: F.broadcast(first.select(F.col("term").alias(c), F.col("class").alias(f"by_{c}")))
    rows = slugs.join(hit("a"), "a", "left").join(hit("b"), "b", "left")
    terms = F.broadcast(lexicon.where(F.length("term") >= 4).agg(F.collect_set("term").alias("terms")))  # configuration
    touches = lambda s: (F.length(s) >= 4) & F.exists("terms", lambda t: s.contains(t) | t.contains(s))
    found = F.coalesce("by_a", "by_b")
    clash = F.coalesce(F.col("by_a") != F.col("by_b"), F.lit(False))
    near = found.isNull() & (touches(F.col("a")) | touches(F.col("b")))
    return rows.crossJoin(terms).select("example", F.when(~clash, found).alias("class"), (clash | near).alias("masked"))


def corpus_counts(corpus: DataFrame) -> DataFrame:
    """(what, value, n) of a corpus of columns (domain, name, label, label_source): rows, and rows for each domain, label and source."""
    parts = F.array(F.struct(F.lit("columns").alias("what"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("what"), F.coalesce(F.col(c), F.lit("")).alias("value")) for c in ("domain", "label", "label_source")])
    return corpus.select(F.explode(parts).alias("x")).groupBy("x.what", "x.value").agg(F.count("*").alias("n"))


def probabilities(votes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(example, class, probability): the share of an example's weight of votes that each class has. Classes without a vote have none."""
    sums = votes.groupBy("example", "class").agg(F.sum(weight_of(weights)).alias("w"))
    return sums.select("example", "class", (F.col("w") / F.sum("w").over(Window.partitionBy("example"))).alias("probability"))


def suspects(votes: DataFrame, truth: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(example, class, given, suspicion_rank) of labelled examples (example, class) whose votes speak for another class: given is the
    probability of their own label, the least first, ties by example. No window sees all of them: ranks come from a range partition."""
    p = probabilities(votes, weights)
    best = p.groupBy("example").agg(F.min_by("class", F.struct(-F.col("probability"), "class")).alias("best"))
    own = truth.join(p.withColumnRenamed("probability", "given"), ["example", "class"], "left")
    odd = own.join(best, "example").where(F.col("best") != F.col("class")).select("example", "class", F.coalesce("given", F.lit(0.0)).alias("given"))
    return ranked(odd, "suspicion_rank", "given", "example")


def audit(votes: DataFrame, truth: DataFrame, weights: dict[str, float]) -> DataFrame:
    """One row: examples, covered (with a vote), agree (whose likeliest class is the given one), suspects, and their shares."""
    p = probabilities(votes, weights)
    best = p.groupBy("example").agg(F.min_by("class", F.struct(-F.col("probability"), "class")).alias("best"))
    j = truth.join(best, "example", "left").agg(F.count("*").alias("examples"), F.count("best").alias("covered"), F.count_if(F.col("best") == F.col("class")).alias("agree"))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    j = j.withColumn("suspects", F.col("covered") - F.col("agree"))
    return j.select("*", share("covered", "examples").alias("coverage"), share("agree", "covered").alias("agreement"), share("suspects", "examples").alias("suspect_share"))


def summary(votes: DataFrame, truth: DataFrame, examples: int) -> DataFrame:
    """(lf, coverage, accuracy) against (example, class)."""
    judged = votes.join(truth.withColumnRenamed("class", "truth"), "example", "left")
    return judged.groupBy("lf").agg((F.count("*") / F.lit(float(examples))).alias("coverage"), F.avg((F.col("class") == F.col("truth")).cast("double")).alias("accuracy"))


def weight_of(weights: dict[str, float]) -> Column:
    return F.coalesce(*[F.when(F.col("lf") == k, w) for k, w in weights.items()], F.lit(0.0))


def tally(votes: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(example, class, confidence): the class with the greatest weight of votes, ties by name. Weights: one for each function."""
    best = F.min_by(F.struct("class", "probability"), F.struct(-F.col("probability"), "class")).alias("b")
    return probabilities(votes, weights).groupBy("example").agg(best).select("example", "b.class", F.col("b.probability").alias("confidence"))


def label_model(votes: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, dict[str, float]]:
    """Consensus and weights by iterated weighted voting: a function's weight is the log odds of its agreement with the consensus
    where that is confident. Votes are first counted by pattern (which function says which class), of which there are few however
    many examples; each round reads these, and one number for each function comes to the driver."""
    votes = votes.groupBy("example", "lf").agg(F.min("class").alias("class"))  # one vote of each function
    names = [r["lf"] for r in votes.select("lf").distinct().orderBy("lf").collect()]
    said = F.map_from_entries(F.array_sort(F.collect_list(F.struct("lf", "class"))))
    patterns = votes.groupBy("example").agg(F.to_json(said).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n")).persist()
    each = patterns.select(F.col("pattern").alias("example"), "n", F.explode(F.from_json("pattern", "map<string, string>")).alias("lf", "class"))
    weights = dict.fromkeys(names, 1.0)
    for _ in range(rounds):
        consensus = tally(each, weights).withColumnRenamed("class", "agreed").where(F.col("confidence") >= CONFIDENT)
        agree = F.sum(F.when(F.col("class") == F.col("agreed"), F.col("n")).otherwise(0)) / F.sum("n")
        rates = {r["lf"]: r["rate"] for r in each.join(consensus, "example").groupBy("lf").agg(agree.alias("rate")).collect()}
        new = {k: SILENT if rates.get(k) is None else max(FLOOR, math.log(max(rates[k], LEAST) / max(1 - rates[k], LEAST))) for k in names}
        settled = all(abs(new[k] - weights[k]) <= SETTLED + 1e-5 * abs(weights[k]) for k in names)
        weights = new
        if settled:
            break
    patterns.unpersist()
    return tally(votes, weights), weights
