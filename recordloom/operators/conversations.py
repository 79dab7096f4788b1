"""Long conversations: the older turns folded into a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Turns that a conversation keeps whole, turns that stay when it has more, characters of the summary's end.
MOST, KEEP, TAIL = 24, 8, 2400


def compacted(turns: DataFrame, *, most: int = MOST, keep: int = KEEP, tail: int = TAIL) -> DataFrame:
    """(conv_id, kept, summary) of turns (conv_id, turn, role, text): a conversation of more than `most` turns keeps its last `keep`; the
    others, as `role: text` lines, become a summary of which the last `tail` characters stay. Ties of turn go by role and text."""
    w = Window.partitionBy("conv_id")
    n = turns.withColumn("n", F.count("*").over(w)).withColumn("at", F.row_number().over(w.orderBy("turn", "role", "text")))
    old = (F.col("n") > most) & (F.col("at") <= F.col("n") - keep)
    said = F.when(old, F.struct("at", F.concat(F.coalesce("role", F.lit("")), F.lit(": "), F.coalesce("text", F.lit(""))).alias("said")))
    folded = n.groupBy("conv_id").agg(F.count_if(~old).alias("kept"), F.array_join(F.transform(F.array_sort(F.collect_list(said)), lambda x: x["said"]), "\n").alias("summary"))
    return folded.select("conv_id", "kept", F.substring("summary", F.greatest(F.length("summary") - tail + 1, F.lit(1)), F.lit(tail)).alias("summary"))
