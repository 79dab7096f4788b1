"""Connected components of an edge table by alternating large-star and small-star steps (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import BROADCAST_IDS, drop_written, join_small, written


def joined(edges: DataFrame, least: DataFrame) -> DataFrame:
    least = least.withColumnRenamed("a", "of_a")
    return join_small(edges, least, F.col("a") == F.col("of_a"), "inner", BROADCAST_IDS)


def connected_components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of long identifiers to (id, component): for each vertex of an edge the smallest identifier that it
    reaches. Loops, doubles and either direction are fine. Minima are taken by aggregation with map-side
    combining and written, then joined back: up to BROADCAST_IDS of them are broadcast, beyond that both sides of the join are
    plain shuffles, whose hot keys AQE splits. So no vertex's neighbours have to meet in one task. Each round is a table in the shared folder."""
    e = written(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    while state[0]:
        both = e.union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = written(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")))
        large = joined(both.where("b > a"), least).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        large = written(large)
        lower = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = joined(large, lower).select("b", "m").where("b != m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        new = written(small.union(lower.select("a", F.col("m").alias("b"))).distinct())
        for t in (large, least, lower, e):
            drop_written(t)
        e, before = new, state
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(state) == tuple(before):
            break
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).union(e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
