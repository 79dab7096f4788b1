"""Approximate nearest neighbours on shifted Hilbert curves.

1. Rows with one vector form a class: a query needs the k + 1 smallest identifiers of a class at most, so these stand
   for all its rows. They are found in two steps, salted first, so a vector shared by a third of the rows is no hot spot.
2. CURVES random orthonormal projections to DIMS dimensions, each with a random shift, give every class a Hilbert key.
   The keys are range-partitioned in Spark; sizes of the ranges and row numbers within them give exact ranks.
3. The window is measured, not guessed: for a bounded sample of classes the true neighbours are found by one pass over
   all vectors, and the window is the least rank distance at which the curves together hold `recall` of them. Where
   vectors have structure it is short; on nearly isotropic ones it grows towards all ranks, and the answer stays right.
4. Each query goes to the blocks of ranks that its window touches, on every curve. A block's vectors meet its queries in
   one numpy product; the nearest of each block are merged and reranked by the exact distance of the original vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .text import join_small, written

CURVES, DIMS, BITS = 4, 8, 7
#: Classes of a block of ranks, and queries that meet it at once, about; classes that scales and the window are fitted on.
BLOCK, ASKS, FITTED, TUNED = 4096, 4096, 2000, 96
#: Queries whose distances to a block are held at once.
AT_ONCE = 256


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Hilbert index of integer points (n, dims), by Skilling's transposition; bits * dims stay below 63."""
    x = cells.T.astype(np.int64).copy()
    n = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        for i in range(n):
            high = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & (q - 1)
            x[0] = np.where(high, x[0] ^ (q - 1), x[0] ^ t)
            if i:
                x[i] = np.where(high, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def stacked(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64) if len(vectors) else np.zeros((0, 1))


def nearest(queries: np.ndarray, vectors: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each query (place, ids, distances) of its k nearest vectors, ties to the smaller id. A product picks more than k, exact differences decide."""
    rough = (vectors**2).sum(axis=1)[None] - 2 * queries @ vectors.T
    if allowed is not None:
        rough[~allowed] = np.inf
    for i, row in enumerate(rough):
        some = np.flatnonzero(np.isfinite(row))
        if len(some) > k + 8:
            edge = np.partition(row[some], k)[k]
            some = some[row[some] <= edge + 1e-9 * (1 + abs(edge) + float(queries[i] @ queries[i]))]
        d = np.sqrt(((vectors[some] - queries[i]) ** 2).sum(axis=1))
        best = np.lexsort((ids[some], d))[:k]
        yield i, ids[some][best], d[best]


def classes_of(rows: DataFrame, keep: int) -> DataFrame:
    """(cls, ids, vec): each distinct vector with its `keep` smallest identifiers, cls being the smallest."""
    by = ["h1", "h2"]
    keyed = rows.select("vec_id", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2"), F.pmod(F.xxhash64("vec_id"), F.lit(64)).alias("salt")).distinct()
    for part in ([*by, "salt"], by):
        keyed = keyed.withColumn("n", F.row_number().over(Window.partitionBy(*part).orderBy("vec_id"))).where(F.col("n") <= keep)
    ids = keyed.groupBy(*by).agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).select(F.col("ids")[0].alias("cls"), "ids")
    return ids.join(rows.dropDuplicates(["vec_id"]), F.col("cls") == F.col("vec_id")).select("cls", "ids", "vec")


def ranked(keys: DataFrame) -> DataFrame:
    """(curve, key, cls) with rank, the exact place on the curve: ranges, their sizes, and numbers within ranges."""
    parts = max(8, int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = written(keys.repartitionByRange(parts, "curve", "key", "cls").withColumn("part", F.spark_partition_id()))
    sizes = dealt.groupBy("curve", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("curve").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = written(sizes.select(F.col("curve").alias("of_curve"), F.col("part").alias("of_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")))
    within = dealt.withColumn("row", F.row_number().over(Window.partitionBy("curve", "part").orderBy("key", "cls")))
    out = join_small(within, offsets, (F.col("curve") == F.col("of_curve")) & (F.col("part") == F.col("of_part")))
    return out.select("curve", "cls", (F.col("offset") + F.col("row") - 1).alias("rank"))


def neighbours(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", every: int = 100, k: int = 10, recall: float = 0.97, curves: int = CURVES, seed: int = 17) -> DataFrame:
    """For each row whose identifier is divisible by `every`, its k nearest rows but itself: query_id, rank, vec_id, score.

    score is the Euclidean distance in double precision; ties go to the smaller identifier. Rows whose vector or
    identifier is null, or whose vector is zero, holds null or non-finite components, or hasn't the commonest number of
    components (the smaller, if two are as common), take no part. Rows that repeat an identifier count once. With k
    other rows or fewer all are returned; an empty table gives an empty one. Other columns aren't looked at.
    """
    vec = F.col(f"`{vector_col}`").cast("array<double>")
    sound = ~F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(vec, lambda x: x != 0)
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), vec.alias("vec")).where(F.col("vec_id").isNotNull() & F.coalesce(sound, F.lit(False)))
    rows = written(rows)
    width = rows.groupBy(F.size("vec").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    if width is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score"))
    rows = rows.where(F.size("vec") == width["w"]).dropDuplicates(["vec_id"])
    classes = written(classes_of(rows, k + 1))
    queries = rows.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.xxhash64("vec").alias("q1"), F.hash("vec").alias("q2"))
    queries = written(queries.join(classes.select("cls", F.xxhash64("vec").alias("h1"), F.hash("vec").alias("h2")), (F.col("q1") == F.col("h1")) & (F.col("q2") == F.col("h2"))).select("query_id", "cls"))
    asked = written(queries.select("cls").distinct())
    total = classes.count()

    # scales and projections, fitted on a bounded sample
    share = min(1.0, FITTED / max(1, total))
    fitted = np.stack([np.array(r["vec"]) for r in classes.where(F.pmod(F.xxhash64(F.lit(seed), "cls"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("vec").collect()] or [np.zeros(width["w"])])
    rng = np.random.default_rng(seed)
    dims = min(DIMS, width["w"])
    frames = [np.linalg.qr(rng.standard_normal((width["w"], dims)))[0] for _ in range(curves)]
    boxes = []
    for f in frames:
        low, high = (fitted @ f).min(axis=0), (fitted @ f).max(axis=0)
        room = np.maximum(high - low, 1e-9)
        boxes.append((low - room * rng.random(dims), 2.1 * room))  # the shift moves the curve's cells

    def keyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            v = stacked(b["vec"])
            for c, (f, (low, room)) in enumerate(zip(frames, boxes, strict=True)):
                if len(b):
                    cells = np.clip((v @ f - low) / room * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
                    yield pd.DataFrame({"curve": np.int32(c), "key": hilbert(cells, BITS), "cls": b["cls"].to_numpy()})

    ranks = written(ranked(classes.select("cls", "vec").mapInPandas(keyed, "curve int, key long, cls long")))
    window = fitted_window(classes, ranks, total, k, recall, seed)

    near = F.sequence(F.floor(F.greatest(F.col("rank") - window, F.lit(0)) / BLOCK), F.floor(F.least(F.col("rank") + window, F.lit(total - 1)) / BLOCK))
    with_vec = classes.select("cls", "vec")
    places = ranks.join(with_vec, "cls")
    # where windows are wide, a block's queries are dealt into slices, and its vectors meet each: a group stays bounded
    to_ask = ranks.join(asked, "cls").select("curve", F.explode(near).alias("block"))
    most = to_ask.groupBy("curve", "block").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    slices = max(1, -(-most // ASKS))
    slice_of = F.pmod(F.xxhash64("cls"), F.lit(slices)).cast("int").alias("slice")
    every_slice = F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice")
    given = places.select("curve", F.floor(F.col("rank") / BLOCK).alias("block"), every_slice, "rank", "cls", "vec", F.lit(False).alias("asks"))
    asking = places.join(asked, "cls").select("curve", F.explode(near).alias("block"), slice_of, "rank", "cls", "vec", F.lit(True).alias("asks"))

    def block(group: pd.DataFrame) -> pd.DataFrame:
        q, v = group[group["asks"]], group[~group["asks"]]
        found = []
        if len(q) and len(v):
            vectors, ids, ranked_at = stacked(v["vec"]), v["cls"].to_numpy(), v["rank"].to_numpy()
            for at in range(0, len(q), AT_ONCE):
                some = q.iloc[at : at + AT_ONCE]
                allowed = np.abs(some["rank"].to_numpy()[:, None] - ranked_at[None]) <= window
                for i, near_ids, d in nearest(stacked(some["vec"]), vectors, ids, allowed, k + 1):
                    found.append(pd.DataFrame({"asker": some["cls"].iat[i], "cls": near_ids, "score": d}))
        return pd.concat(found) if found else pd.DataFrame({"asker": pd.Series(dtype="int64"), "cls": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})

    found = given.union(asking).groupBy("curve", "block", "slice").applyInPandas(block, "asker long, cls long, score double")
    found = found.groupBy("asker", "cls").agg(F.min("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "cls"))).where(F.col("n") <= k + 1)
    # rows of a class are at one distance, and those of a farther class come after it
    each = best.join(classes.select("cls", "ids"), "cls").select("asker", "score", F.explode("ids").alias("vec_id"))
    each = each.join(queries, F.col("asker") == queries["cls"]).where(F.col("vec_id") != F.col("query_id"))
    place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return each.select("query_id", "vec_id", "score").withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def fitted_window(classes: DataFrame, ranks: DataFrame, total: int, k: int, recall: float, seed: int) -> int:
    """The least rank distance at which the curves together hold `recall` of the true neighbours of TUNED sampled classes."""
    share = min(1.0, TUNED / max(1, total))
    sample = classes.where(F.pmod(F.xxhash64(F.lit(seed + 1), "cls"), F.lit(1 << 30)) <= int(share * (1 << 30))).select("cls", "vec").collect()
    if not sample:
        return total
    ids, vecs = np.array([r["cls"] for r in sample]), np.array([r["vec"] for r in sample])

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                got = [pd.DataFrame({"asker": ids[i], "cls": c, "score": d}) for i, c, d in nearest(vecs, stacked(b["vec"]), b["cls"].to_numpy(), None, k + 1)]
                yield pd.concat(got)

    true = classes.select("cls", "vec").mapInPandas(scan, "asker long, cls long, score double")
    true = true.withColumn("n", F.row_number().over(Window.partitionBy("asker").orderBy("score", "cls"))).where((F.col("n") <= k + 1) & (F.col("asker") != F.col("cls")))
    true = F.broadcast(written(true.select("asker", "cls")))
    mine = ranks.join(F.broadcast(true.select(F.col("asker").alias("cls")).distinct()), "cls").select(F.col("cls").alias("asker"), "curve", F.col("rank").alias("from_rank"))
    apart = ranks.join(true, "cls").join(mine, ["asker", "curve"]).groupBy("asker", "cls").agg(F.min(F.abs(F.col("rank") - F.col("from_rank"))).alias("apart"))
    gaps = sorted(r["apart"] for r in apart.select("apart").collect())  # TUNED * k rows, about
    return int(gaps[min(len(gaps) - 1, int(np.ceil(recall * len(gaps))))]) if gaps else total
