"""Mixing sources to target weights by capped water-filling.

Every source asks for a share of the words in proportion to its weight. A source can't give more than
max_epochs times what it has: it is clamped there and its excess goes to the others by weight, until none is
above. With the caps in ascending order of cap / weight the clamped sources are a prefix, so the fixed point of
that loop is found with two running sums over the table of sources instead of a driver loop.

A source's target of e = whole + fraction epochs takes each document `whole` times and a seeded sample of
`fraction` of the words once more. The sample is a range of a seeded hash of the identifier: a histogram of words
by hash slot finds the slot in which the fraction ends, and only that slot's rows (1/4096 of a source) are
ordered to find the exact key. No source is gathered in one task, and a rerun takes the same documents.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import join_small, n_words, without, written

#: Hash keys have 60 bits; the first 12 are the slot.
KEY_HEX, SLOT_SHIFT = 15, 48

ADDED = ("size", "source_size", "target", "taken", "copies")


def hash_key(seed: int, identifier: Column) -> Column:
    """60 seeded bits of an identifier (a null one counts as empty)."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(identifier.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, KEY_HEX), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float], share: float, max_epochs: float) -> DataFrame:
    """(source, source_size) to the same with target. Weights repeat over the sources in code point order, null last."""
    everything = Window.partitionBy(F.lit(0))
    turn = (F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int"))
    rising = everything.orderBy("ratio", F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0)
    level = F.col("cap_to_here") + F.col("ratio") * (F.col("weights") - F.col("weight_to_here"))
    return (
        sizes.select("source", F.col("source_size").cast("long").alias("source_size"), weight.alias("weight"))
        .withColumn("cap", F.lit(float(max_epochs)) * F.col("source_size"))
        .withColumn("ratio", F.col("cap") / F.col("weight"))
        .withColumn("total", F.lit(float(share)) * F.sum("source_size").over(everything))
        .withColumn("weights", F.sum("weight").over(everything))
        .withColumn("cap_to_here", F.sum("cap").over(rising))
        .withColumn("weight_to_here", F.sum("weight").over(rising))
        # filled up to this source's own ratio, all sources together still fall short: it is clamped
        .withColumn("clamped", level < F.col("total"))
        .withColumn("left", F.col("total") - F.sum(F.when(F.col("clamped"), F.col("cap")).otherwise(0.0)).over(everything))
        .withColumn("open", F.sum(F.when(F.col("clamped"), 0.0).otherwise(F.col("weight"))).over(everything))
        .select("source", "source_size", F.when(F.col("clamped"), F.col("cap")).otherwise(F.col("left") * F.col("weight") / F.col("open")).alias("target"))
    )


def mix_sources(docs: DataFrame, *, source_col: str = "source", id_col: str = "doc_id", text_col: str = "text", weights: Sequence[float] = (5, 2, 1), share: float = 1.0, max_epochs: float = 3.0, seed: int = 17) -> DataFrame:
    """docs with size, source_size, target, copies (times the mix takes the row) and taken = copies * size.

    size is the number of words. Columns of docs with these five names are replaced, others stay as they are. A
    null text has size 0; such rows, and those of an all-empty source, follow the same hash range with nothing to
    take. A null source is a source of its own. Rows with equal identifiers share a key and so are taken
    together. An empty table gives an empty table.
    """
    key, source, size = hash_key(seed, F.col(f"`{id_col}`")), F.col(f"`{source_col}`").cast("string"), n_words(F.col(f"`{text_col}`"))
    digest = written(docs.select(source.alias("source"), key.alias("key"), size.alias("size")).groupBy("source", "key").agg(F.sum("size").alias("size")))
    slots = digest.groupBy("source", F.shiftright("key", SLOT_SHIFT).alias("slot")).agg(F.sum("size").alias("slot_size"))
    plan = targets(digest.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    plan = (
        plan.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
        .withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    )
    plan = written(plan)
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    before = Window.partitionBy("source").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    cut = slots.withColumn("slot_before", F.coalesce(F.sum("slot_size").over(before), F.lit(0)))
    p = plan.select(F.col("source").alias("p_source"), "part")
    cut = join_small(cut, p, cut["source"].eqNullSafe(p["p_source"]), "inner").where((F.col("slot_before") < F.col("part")) & (F.col("slot_before") + F.col("slot_size") >= F.col("part")))
    cut = cut.groupBy("source").agg(F.min("slot").alias("cut_slot"), F.min_by("slot_before", "slot").alias("cut_before"), F.first("part").alias("part"))
    cut = written(cut.select(F.col("source").alias("c_source"), "cut_slot", "cut_before", "part"))
    edge = join_small(digest, cut, digest["source"].eqNullSafe(cut["c_source"]), "inner").where(F.shiftright("key", SLOT_SHIFT) == F.col("cut_slot"))
    inside = Window.partitionBy("source").orderBy("key").rowsBetween(Window.unboundedPreceding, -1)
    so_far = F.col("cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0))
    # a key belongs to the sample while that brings the words nearer to the target
    last = edge.withColumn("nearer", so_far + F.col("size") / 2 < F.col("part")).groupBy("source").agg(F.max(F.when(F.col("nearer"), F.col("key"))).alias("last_key"), F.first("cut_slot").alias("cut_slot"))
    last = last.select(F.col("source").alias("l_source"), F.coalesce("last_key", F.shiftleft("cut_slot", SLOT_SHIFT) - 1).alias("last_key"))
    plan = written(plan.join(last, plan["source"].eqNullSafe(last["l_source"]), "left").select("source", "source_size", "target", "whole", F.coalesce("last_key", F.lit(-1)).alias("last_key")))
    plan = plan.select(F.col("source").alias("__mix_source"), *[F.col(c).alias(f"__mix_{c}") for c in plan.columns[1:]])
    out = join_small(docs.withColumns({"__mix_by": source, "__mix_key": key, "__mix_size": size}), plan, F.col("__mix_by").eqNullSafe(F.col("__mix_source")), "left")
    copies = F.col("__mix_whole") + (F.col("__mix_key") <= F.col("__mix_last_key")).cast("long")
    kept = [F.col(f"`{c}`") for c in without(docs, *ADDED).columns]
    return out.select(*kept, F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (copies * F.col("__mix_size")).alias("taken"), copies.alias("copies"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row as many times as the mix takes it; rows it doesn't take are gone."""
    return mixed.where(F.col("copies") > 0).withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).drop("__mix_copy", *ADDED)
