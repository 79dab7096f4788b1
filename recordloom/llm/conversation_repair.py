"""Repair of conversation structure: the cheapest edits that give roles of the form (system? (user assistant)+)?.

A conversation is read by an automaton of four states: nothing yet, after the system turn, after a user, after an
assistant (first and last are accepting). Each row is kept, gets another role or is deleted, and empty turns are inserted;
among the cheapest scripts the one whose letters (D, I, K, R) are least is taken.

1. Rows are ordered over all partitions by range, so that a conversation of any length is spread over tasks, and each gets
   one letter: initial of its role, and fault. Blocks of at most 2 ** BLOCK_BITS rows of a conversation become strings.
2. A block's cost vectors: for each state before it, the least cost of each state after it, and the order in which
   the cheapest scripts to these four states stand. Blocks of one conversation are joined by their vectors: costs to the end
   run backward over blocks, then each crossing is the least script that keeps the optimum.
3. Within a block Hirschberg's divide and conquer: a forward vector of costs and script orders to the middle and a backward
   vector of costs to the end meet; the crossing with the least sum, and of those the least script, is fixed, and both
   halves recur. Memory is linear in the block.

Scripts to different states at one row are never prefixes of each other (each ends with the row's own letter and has as many
letters that aren't insertions), so that their order decides whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache, lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import WORD, join_small, written

#: Costs of the edits, and what a truncated row costs that isn't deleted.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Rows of a block, as a power of two.
BLOCK_BITS = 15
INITIALS, FAULTS = "suax", "kdt"  # any other initial is x; rows to keep, to delete, truncated ones
STATES, INF = range(4), 1 << 40
#: State and role after an insertion, by the state before it.
INSERTED = {0: (2, "u"), 1: (2, "u"), 2: (3, "a"), 3: (2, "u")}
#: Insertions that end a conversation, by its last state.
ENDING = ("", "IuIa", "Ia", "")
END_COST = tuple(INSERT * len(e) // 2 for e in ENDING)
#: A script is written with two characters for each edit: its letter and the role it gives.
LONG, INT, STRING = T.LongType(), T.IntegerType(), T.StringType()
STRUCTURE = T.StructType().add("costs", T.ArrayType(LONG)).add("orders", T.ArrayType(INT)).add("illegal", LONG).add("first", STRING).add("last", STRING)
CROSSED = T.StructType().add("states", T.ArrayType(INT)).add("cost", LONG).add("illegal", LONG)


def letters(codes: str) -> str:
    return codes[::2]


@cache
def steps(letter: str) -> tuple[tuple[tuple[int, int, str], ...], ...]:
    """For each state the best way over a row to each state: (state after, cost, codes)."""
    initial, fault = INITIALS[(ord(letter) - 65) // 3], FAULTS[(ord(letter) - 65) % 3]
    out = []
    for q in STATES:
        best: dict[int, tuple[int, str, str]] = {}
        at, cost, codes = q, 0, ""
        for _ in range(3):  # two insertions at most: from the start or the system turn to an assistant
            options = [(at, DELETE, "D.")]
            if fault != "d":
                extra = TRUNCATED * (fault == "t")
                for role, after in (("s", 1), ("u", 2), ("a", 3)):
                    if at in {"s": (0,), "u": (0, 1, 3), "a": (2,)}[role]:
                        options += [(after, extra, "K.")] * (initial == role) + [(after, REROLE + extra, f"R{role}")] * (role != "s")
            for after, more, code in options:
                option = (cost + more, letters(codes + code), codes + code)
                best[after] = min(best.get(after, option), option)
            at, role = INSERTED[at]
            cost, codes = cost + INSERT, f"{codes}I{role}"
        out.append(tuple((after, c, codes) for after, (c, _, codes) in sorted(best.items())))
    return tuple(out)


def forward(rows: str, start: int) -> tuple[list[int], list[int]]:
    """Costs of the states after rows, from one before them, and the order of their scripts."""
    costs, orders = [0 if q == start else INF for q in STATES], [0] * 4
    for letter in rows:
        best: dict[int, tuple] = {}
        for q, ways in enumerate(steps(letter)):
            if costs[q] < INF:
                for after, c, codes in ways:
                    option = (costs[q] + c, (orders[q], letters(codes)))
                    if after not in best or option < best[after]:
                        best[after] = option
        ranks = {s: i for i, s in enumerate(sorted(x[1] for x in best.values()))}
        costs = [best[q][0] if q in best else INF for q in STATES]
        orders = [ranks[best[q][1]] if q in best else 0 for q in STATES]
    return costs, orders


def backward(rows: str, costs: list[int]) -> list[int]:
    """Costs from the states before rows to the end, given those from the states after them."""
    for letter in reversed(rows):
        costs = [min(c + costs[after] for after, c, _ in ways) for ways in steps(letter)]
    return costs


@lru_cache(100_000)
def script(rows: str, start: int, end: int) -> tuple[str, ...]:
    """For each row the codes of the least cheapest script from one state to another."""
    if len(rows) == 1:
        return (next(codes for after, _, codes in steps(rows)[start] if after == end),)
    middle = len(rows) // 2
    costs, orders = forward(rows[:middle], start)
    rest = backward(rows[middle:], [0 if q == end else INF for q in STATES])
    crossing = min(STATES, key=lambda q: (costs[q] + rest[q], orders[q]))
    return script(rows[:middle], start, crossing) + script(rows[middle:], crossing, end)


@lru_cache(100_000)
def structure(rows: str) -> tuple[list[int], list[int], int, str, str]:
    """A block's vectors for each state before it, its illegal neighbours, its first and last initial."""
    vectors = [forward(rows, q) for q in STATES]
    initials = "".join(INITIALS[(ord(x) - 65) // 3] for x in rows)
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return [c for v in vectors for c in v[0]], [o for v in vectors for o in v[1]], illegal, initials[0], initials[-1]


@F.pandas_udf(STRUCTURE)
def structures(rows: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([structure(x) for x in rows], columns=["costs", "orders", "illegal", "first", "last"])


@F.pandas_udf(CROSSED)
def crossings(blocks: pd.Series) -> pd.DataFrame:
    """The states between a conversation's blocks, least cost, illegal neighbours."""
    out = []
    for bs in blocks:
        rest = [list(END_COST)]
        for b in reversed(bs):
            rest.append([min(int(b["costs"][4 * q + r]) + rest[-1][r] for r in STATES) for q in STATES])
        rest.reverse()
        states = [0]
        for b, after in zip(bs, rest[1:]):
            q = states[-1]
            states.append(min(STATES, key=lambda r: (int(b["costs"][4 * q + r]) + after[r], b["orders"][4 * q + r])))
        joints = sum(a["last"] + b["first"] not in ("su", "ua", "au") for a, b in zip(bs, bs[1:]))
        out.append((states, rest[0][0], joints + sum(int(b["illegal"]) for b in bs)))
    return pd.DataFrame(out, columns=["states", "cost", "illegal"])


@F.pandas_udf(T.ArrayType(STRING))
def scripts(rows: pd.Series, start: pd.Series, end: pd.Series, last: pd.Series) -> pd.Series:
    out = []
    for r, a, b, z in zip(rows, start, end, last):
        codes = list(script(r, int(a), int(b)))
        if z:
            codes[-1] += ENDING[b]
        out.append(codes)
    script.cache_clear()
    return pd.Series(out, dtype=object)


def marked(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """Rows in order, (conv_id, turn, role, text, at, fault, letter); at is a position over all conversations."""
    filled = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), filled(role_col).alias("role"), filled(text_col).alias("text"))
    same = F.concat(F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")), F.lit(":"), F.length("role"), F.lit(":"), F.col("role"), F.col("text"))
    order = ["conv_id", "turn", "role"]
    placed = rows.withColumn("same", F.unhex(F.sha2(same, 256))).repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    placed = written(placed.withColumn("at", F.monotonically_increasing_id()))
    twice = placed.groupBy("same").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("same").alias("s_same"), "first")
    placed = join_small(placed, twice, placed["same"] == twice["s_same"])
    final = F.element_at(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]"), F.lit(0)), -1)
    fault = F.when(~F.rlike("text", F.lit(WORD)), "blank").when(F.col("at") > F.col("first"), "duplicate").when(~final.isin(".", "!", "?"), "truncated")
    placed = placed.select("conv_id", "turn", "role", "text", "at", fault.alias("fault"))
    first = F.substring("role", 1, 1)
    initial = F.when(first == "s", 0).when(first == "u", 1).when(first == "a", 2).otherwise(3)
    kind = F.when(F.col("fault").isin("blank", "duplicate"), 1).when(F.col("fault") == "truncated", 2).otherwise(0)
    return placed.withColumn("letter", F.char((65 + 3 * initial + kind).cast("long")))


def repair(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of the rows of turns.

    conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit. repaired: conv_id, at, part (together
    the order), edit, role, text.

    Rows go by turn, null first, ties by role and text; equal rows are told apart by place only. A null role or text is
    one space; a null conversation is one of its own. Any other role than those that begin with s, u or a, the empty
    one included, can't be kept. A row's first fault counts: blank, seen earlier in its conversation, no sentence end. A
    conversation whose rows are all deleted has no repaired turn. Texts may be of any length, other columns aren't
    looked at, an empty table gives empty ones.
    """
    rows = written(marked(turns, conv_col, turn_col, role_col, text_col))
    numbered = F.array_sort(F.collect_list(F.struct("at", "letter")))
    blocks = rows.groupBy("conv_id", F.shiftright("at", BLOCK_BITS).alias("block")).agg(numbered.alias("rows"))
    blocks = blocks.select("conv_id", "block", F.col("rows.at").alias("ats"), F.array_join("rows.letter", "").alias("letters"))
    blocks = written(blocks.withColumn("structure", structures("letters")))
    of_conv = F.array_sort(F.collect_list(F.struct("block", "structure.costs", "structure.orders", "structure.illegal", "structure.first", "structure.last")))
    convs = blocks.groupBy("conv_id").agg(of_conv.alias("blocks"))
    convs = written(convs.select("conv_id", F.col("blocks.block").alias("block"), crossings("blocks").alias("crossed")).select("conv_id", "block", "crossed.*"))
    states = convs.select("conv_id", F.posexplode("block").alias("i", "block"), "states").select(
        F.col("conv_id").alias("c_conv"), F.col("block").alias("c_block"), F.element_at("states", F.col("i") + 1).alias("start"), F.element_at("states", F.col("i") + 2).alias("end"), (F.col("i") + 2 == F.size("states")).alias("last")
    )
    crossed = blocks.join(states, blocks["conv_id"].eqNullSafe(states["c_conv"]) & (blocks["block"] == states["c_block"]))
    edits = written(crossed.select("conv_id", "block", "ats", scripts("letters", "start", "end", "last").alias("codes")))
    audit = F.regexp_replace(F.array_join("codes", ""), "(.).", "$1")
    audits = edits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("block", audit.alias("audit")))).alias("parts")).select(F.col("conv_id").alias("a_conv"), F.array_join("parts.audit", "").alias("audit"))
    fault = lambda f: F.count_if(F.col("fault") == f).alias(f)
    by_turn = rows.groupBy("conv_id", "turn").agg(*map(fault, ("blank", "duplicate", "truncated")))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long")
    counts = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    costs = convs.select(F.col("conv_id").alias("k_conv"), "illegal", "cost")
    out = counts.join(costs, F.col("conv_id").eqNullSafe(F.col("k_conv"))).join(audits, F.col("conv_id").eqNullSafe(F.col("a_conv")))
    out = out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    each = edits.select(F.explode(F.arrays_zip("ats", "codes")).alias("x")).select(F.col("x.ats").alias("e_at"), F.posexplode(F.regexp_extract_all("x.codes", F.lit("(..)"), F.lit(1))).alias("part", "code"))
    each = each.where(F.col("code") != "D.")
    letter, gives = F.substring("code", 1, 1), F.when(F.substring("code", 2, 1) == "u", "user").otherwise("assistant")
    repaired = rows.join(each, rows["at"] == each["e_at"]).select(
        "conv_id", "at", "part", letter.alias("edit"), F.when(letter == "K", F.col("role")).otherwise(gives).alias("role"), F.when(letter == "I", "").otherwise(F.col("text")).alias("text")
    )
    return out, repaired


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, sha256) of a conversation's `role:text` lines. A digest is sequential by nature: the task that has a conversation
    streams its sorted lines and holds one batch, whatever the conversation's length."""

    def streamed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        none = object()
        key, state = none, None
        for b in batches:
            done = []
            for conv, role, text in zip(b["conv"], b["role"], b["text"]):
                if conv != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = conv, hashlib.sha256()
                else:
                    state.update(b"\n")
                state.update(f"{role}:{text}".encode())
            if done:
                yield pd.DataFrame(done, columns=["conv", "sha256"])
        if state is not None:
            yield pd.DataFrame([(key, state.hexdigest())], columns=["conv", "sha256"])

    # as text, so that null is a value like others
    named = repaired.withColumn("conv", F.coalesce(F.concat(F.lit("c"), F.col("conv_id").cast("string")), F.lit("n")))
    lines = named.repartition("conv").sortWithinPartitions("conv", "at", "part").select("conv", "role", "text")
    kind = repaired.schema["conv_id"].dataType
    return lines.mapInPandas(streamed, "conv string, sha256 string").select(F.when(F.col("conv") != "n", F.substring("conv", 2, 1 << 20)).cast(kind).alias("conv_id"), "sha256")


def damaged(turns: DataFrame) -> DataFrame:
    """turns with faults planted by crc32 of `conv_id:turn`: one in twenty each is dropped, emptied, loses its sentence ends, is repeated,
    becomes a user's."""
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn"))) % 20
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = turns.select("conv_id", "turn", filled("role").alias("role"), filled("text").alias("text"), kind.alias("kind")).where("kind <> 0")
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    return rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))
