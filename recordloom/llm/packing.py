"""Packing into optimal length buckets.

Each document is padded to its bucket's length. A histogram of exact lengths over all documents goes to the driver (a row for
each length that occurs: as many as the longest text has words at most, and no more than the root of twice all words,
since different lengths add up), and dynamic programming over it chooses the boundaries that waste the fewest padding tokens. The cost of a bucket (i, j] is
length_j * documents - tokens, so each layer of the recursion is a lower envelope of lines and takes linear time.

Batches of at most `budget` padded tokens form inside each bucket. Rows are numbered without gathering a bucket:
a seeded hash deals them into chunks, the chunks' counts give each chunk its offset, and rows are numbered
within chunks.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .text import join_small, n_words, without, written

#: Rows of a chunk, about.
CHUNK_ROWS = 100_000
ADDED = ("n_tokens", "bucket", "bucket_len", "batch", "slot")


def optimal_boundaries(lengths: list[int], counts: list[int], tokens: list[int], buckets: int) -> list[int]:
    """The bucket lengths, ascending, at most `buckets`, that pad least. lengths: those that occur, ascending;
    counts: documents of each; tokens: their lengths' sum. Exact, in integers."""
    m, n, s = len(lengths), [0], [0]
    for c, t in zip(counts, tokens, strict=True):
        n.append(n[-1] + c)
        s.append(s[-1] + t)
    best: list[float] = [0] + [math.inf] * m
    back: list[list[int]] = []
    for _ in range(min(buckets, m)):
        new, froms = [math.inf] * (m + 1), [0] * (m + 1)
        new[0] = 0
        hull: list[tuple[int, float, int]] = []  # lines -n_i * x + (best_i + s_i), slopes falling
        head = 0
        for j in range(1, m + 1):
            i = j - 1
            if best[i] < math.inf and (i == 0 or n[i] > n[i - 1] or not hull):
                line = (-n[i], best[i] + s[i], i)
                while len(hull) - head >= 2 and (hull[-1][1] - hull[-2][1]) * (hull[-1][0] - line[0]) >= (line[1] - hull[-1][1]) * (hull[-2][0] - hull[-1][0]):
                    hull.pop()
                hull.append(line)
            if not hull:
                continue
            x = lengths[j - 1]
            head = min(head, len(hull) - 1)
            while head + 1 < len(hull) and hull[head + 1][0] * x + hull[head + 1][1] <= hull[head][0] * x + hull[head][1]:
                head += 1
            new[j] = hull[head][0] * x + hull[head][1] + x * n[j] - s[j]
            froms[j] = hull[head][2]
        back.append(froms)
        if new[m] >= best[m]:
            back.pop()
            break
        best = new
    ends, j = [], m
    for froms in reversed(back):
        if j == 0:
            break
        ends.append(lengths[j - 1])
        j = froms[j]
    return sorted(set(ends))


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", length: Column | None = None, buckets: int = 16, budget: int = 65_536, seed: int = 17) -> DataFrame:
    """docs with n_tokens, bucket (from 0), bucket_len, batch (from 0 in its bucket) and slot (place in its batch).

    length: a document's tokens, its words unless given; null counts as 0, and empty documents go to the shortest
    bucket. A batch holds budget // bucket_len rows, one at least (a document longer than the budget is alone). Columns
    of docs with these five names are replaced. Rows with equal identifiers and lengths are interchangeable: which of
    them gets which slot isn't fixed. An empty table gives an empty one.
    """
    size = F.coalesce(length.cast("long"), F.lit(0).cast("long")) if length is not None else n_words(F.col(f"`{text_col}`"))
    order = F.xxhash64(F.lit(seed), F.col(f"`{id_col}`"), F.col("__pack_len"))
    rows = docs.withColumn("__pack_len", size).withColumn("__pack_order", order)
    lengths = written(rows.select("__pack_len", "__pack_order"))  # so that texts are read twice only, here and for the result
    histogram = lengths.groupBy("__pack_len").agg(F.count("*").alias("n"))
    bins = sorted((r["__pack_len"], r["n"], r["__pack_len"] * r["n"]) for r in histogram.collect())  # a row for each length
    ends = optimal_boundaries([b[0] for b in bins], [b[1] for b in bins], [b[2] for b in bins], buckets) or [0]
    total = sum(b[1] for b in bins)
    chunks = max(1, math.ceil(total / CHUNK_ROWS))
    bucket = sum((F.col("__pack_len") > e).cast("int") for e in ends[:-1]) if len(ends) > 1 else F.lit(0)
    bucket_len = F.element_at(F.array(*[F.lit(e).cast("long") for e in ends]), F.col("__pack_bucket") + 1)
    placed = {"__pack_bucket": bucket if isinstance(bucket, Column) else F.lit(bucket), "__pack_chunk": F.pmod(F.shiftright("__pack_order", 20), F.lit(chunks)).cast("int")}
    rows = rows.withColumns(placed)
    before = Window.partitionBy("bucket_of").orderBy("chunk_of").rowsBetween(Window.unboundedPreceding, -1)
    sizes = lengths.withColumns(placed).groupBy(F.col("__pack_bucket").alias("bucket_of"), F.col("__pack_chunk").alias("chunk_of")).agg(F.count("*").alias("n"))
    offsets = written(sizes.select("bucket_of", "chunk_of", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__pack_offset")))
    within = Window.partitionBy("__pack_bucket", "__pack_chunk").orderBy("__pack_order", F.col(f"`{id_col}`"))
    rows = rows.withColumn("__pack_row", F.row_number().over(within))
    out = join_small(rows, offsets, (F.col("__pack_bucket") == F.col("bucket_of")) & (F.col("__pack_chunk") == F.col("chunk_of")))
    place = F.col("__pack_offset") + F.col("__pack_row") - 1
    fits = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / F.greatest(bucket_len, F.lit(1).cast("long"))))
    kept = [F.col(f"`{c}`") for c in without(docs, *ADDED).columns]
    return out.select(*kept, F.col("__pack_len").alias("n_tokens"), F.col("__pack_bucket").alias("bucket"), bucket_len.alias("bucket_len"), F.floor(place / fits).cast("long").alias("batch"), (place % fits).cast("long").alias("slot"))
