"""Saved criteria as data: compiled to decision graphs, checked, described, walked and held against what is known, all by columns.

A graph is a column struct<entry, nodes array<struct<id, kind, field, op, value, on_pass, on_fail, prompt, action>>>, so that
each row may have its own. kind is condition, approval (on_pass is its next node) or action (match or discard).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.names import plain_number
from ..functions.text import let

# Signals with their names and formats, the words of operators, the question of an approval.
SIGNALS = {
    "owed": ("amount owed", "money"), "assessed": ("assessed value", "money"), "assessedPrior": ("prior assessed value", "money"), "debtToValue": ("debt to value", "ratio"),
    "violations": ("open violations", "count"), "sources": ("corroborating sources", "count"), "days_since_event": ("days since last event", "days"),
}
WORDS = {"gte": "at least", "gt": "more than", "lte": "at most", "lt": "less than", "eq": "exactly"}
PROMPT = "Outreach requires your approval"

NODE = "struct<id: string, kind: string, field: string, op: string, value: double, on_pass: string, on_fail: string, prompt: string, action: string>"
GRAPH = f"struct<entry: string, nodes: array<{NODE}>>"


def node(**parts: Column | str) -> Column:
    fields = ("id", "kind", "field", "op", "value", "on_pass", "on_fail", "prompt", "action")
    made = F.struct(*[(v if isinstance(v := parts.get(f), Column) else F.lit(v)).alias(f) for f in fields])
    return made.cast(NODE)


def chained(conditions: list[tuple[Column, str, str, str, Column]], approval: Column) -> Column:
    """A graph of the conditions (asked, id, field, op, value) that are asked for, in their order, each failing to discard."""
    held = F.filter(F.array(*[F.when(asked, node(id=i, kind="condition", field=f, op=op, value=v, on_fail="discard")) for asked, i, f, op, v in conditions]), lambda n: n.isNotNull())
    leaf = F.when(approval, "needs_approval").otherwise("match")

    def graph(cs: Column) -> Column:
        linked = F.transform(cs, lambda n, i: n.withField("on_pass", F.coalesce(F.get(cs, i + 1)["id"], leaf)))
        asks = F.when(approval, F.array(node(id="needs_approval", kind="approval", prompt=PROMPT, on_pass="match"))).otherwise(F.array().cast(f"array<{NODE}>"))
        ends = F.array(node(id="match", kind="action", action="match"), node(id="discard", kind="action", action="discard"))
        return F.struct(F.coalesce(F.get(cs, F.lit(0))["id"], leaf).alias("entry"), F.concat(linked, asks, ends).alias("nodes"))

    return let(held, graph)


def compiled() -> Column:
    """The graph of criteria in columns min_owed, require_multi_source, min_debt_to_value, max_days_since_event (null: not asked)."""
    some = lambda c: F.coalesce(c, F.lit(False))
    debt, days = F.col("min_debt_to_value"), F.col("max_days_since_event")
    return chained(
        [
            (F.lit(True), "owed_floor", "owed", "gte", F.coalesce("min_owed", F.lit(10_000.0))),
            (some(F.col("require_multi_source")), "multi_source", "sources", "gt", F.lit(1.0)),
            (some(debt > 0), "debt_ratio", "debtToValue", "gte", debt),
            (some(days > 0), "recent_activity", "days_since_event", "lte", days),
        ],
        F.lit(True),
    )


def of_profile() -> Column:
    """The graph of a conversation's profile in columns min_owed, min_assessed, evidence, max_days_since_event, require_approval."""
    owed, assessed, days, evidence = F.col("min_owed"), F.col("min_assessed"), F.col("max_days_since_event"), F.coalesce("evidence", F.lit(""))
    some = lambda c: F.coalesce(c, F.lit(False))
    return chained(
        [
            (some(owed > 0), "owed_floor", "owed", "gte", owed),
            (some(assessed > 0), "assessed_floor", "assessed", "gte", assessed),
            (evidence.isin("multiple_sources", "both"), "multiple_sources", "sources", "gte", F.lit(2.0)),
            (evidence.isin("open_violation", "both"), "open_violation", "violations", "gte", F.lit(1.0)),
            (days.isNotNull(), "recent_activity", "days_since_event", "lte", days),
        ],
        F.coalesce("require_approval", F.lit(True)),
    )


def found(graph: Column, at: Column) -> Column:
    """The last node of an identifier; null if there is none."""
    return F.try_element_at(F.filter(graph["nodes"], lambda n: n["id"] == at), F.lit(-1))


def problems(graph: Column, known: list[str]) -> Column:
    """What is wrong with a graph, in the order of its nodes; empty if nothing is."""
    ids = F.transform(graph["nodes"], lambda n: n["id"])
    missing = lambda to: ~F.coalesce(F.array_contains(ids, to), F.lit(False))
    of = lambda wrong, *said: F.when(wrong, F.concat(*[F.lit(x) if isinstance(x, str) else F.coalesce(x, F.lit("")) for x in said]))
    condition = lambda n: n["kind"] == "condition"
    each = F.transform(
        graph["nodes"],
        lambda n: F.array(
            of(condition(n) & ~n["field"].isin(*known), 'condition "', n["id"], '" uses unknown signal "', n["field"], '"'),
            of(condition(n) & missing(n["on_pass"]), 'condition "', n["id"], '" onPass -> missing "', n["on_pass"], '"'),
            of(condition(n) & missing(n["on_fail"]), 'condition "', n["id"], '" onFail -> missing "', n["on_fail"], '"'),
            of((n["kind"] == "approval") & missing(n["on_pass"]), 'approval "', n["id"], '" next -> missing "', n["on_pass"], '"'),
        ),
    )
    first = F.array(of(missing(graph["entry"]), 'entry "', graph["entry"], '" is not a node'), of(F.size(F.array_distinct(ids)) != F.size(ids), "duplicate node ids"))
    last = F.array(of(~F.exists(graph["nodes"], lambda n: (n["kind"] == "action") & (n["action"] == "match")), "no match action: nothing can ever qualify"))
    return F.filter(F.concat(first, F.flatten(each), last), lambda x: x.isNotNull())


def label(field: Column) -> Column:
    return F.coalesce(*[F.when(field == k, name) for k, (name, _) in SIGNALS.items()], F.replace(field, F.lit("_"), F.lit(" ")))


def shown(field: Column, value: Column) -> Column:
    """A signal's value as text: whole dollars, a ratio with x, days with their unit, others plainly."""
    kind = F.coalesce(*[F.when(field == k, kind) for k, (_, kind) in SIGNALS.items()], F.lit("count"))
    whole = F.floor(value + 0.5)
    dollars = F.concat(F.lit("$"), F.format_number(whole.cast("double"), 0))
    plain = plain_number(value)
    return F.when(kind == "money", dollars).when(kind == "ratio", F.concat(plain, F.lit("x"))).when(kind == "days", F.concat(plain, F.when(value == 1, " day").otherwise(" days"))).otherwise(plain)


def needed(n: Column) -> Column:
    words = F.coalesce(*[F.when(n["op"] == op, w) for op, w in WORDS.items()])
    return F.concat(words, F.lit(" "), shown(n["field"], n["value"]))


def described(graph: Column) -> Column:
    """A graph in words: a line for each step of the way on which all conditions are met."""

    def step(a: Column, _: Column) -> Column:
        def on(n: Column) -> Column:
            line = F.when(n.isNull(), F.concat(F.lit('- broken link to "'), F.coalesce(a["at"], F.lit("")), F.lit('"')))
            line = line.when(n["kind"] == "condition", F.concat(F.lit("- "), label(n["field"]), F.lit(" "), needed(n))).when(n["kind"] == "approval", F.concat(F.lit("- "), F.lower(n["prompt"])))
            done = a["done"] | n.isNull() | (n["kind"] == "action")
            lines = F.when(a["done"] | line.isNull(), a["lines"]).otherwise(F.concat(a["lines"], F.array(line)))
            return F.struct(F.when(done, a["at"]).otherwise(n["on_pass"]).alias("at"), lines.alias("lines"), F.coalesce(done, F.lit(False)).alias("done"))

        return let(found(graph, a["at"]), on)

    start = F.struct(graph["entry"].alias("at"), F.array().cast("array<string>").alias("lines"), F.lit(False).alias("done"))
    return F.array_join(F.aggregate(F.sequence(F.lit(0), F.size(graph["nodes"])), start, step)["lines"], "\n")


TRACE = "array<struct<node: string, kind: string, field: string, op: string, value: double, actual: double, present: boolean, passed: boolean, prompt: string>>"


def walked(graph: Column, signals: Column) -> Column:
    """struct<outcome, reason, requires_approval, trace> of a graph over a map of measured signals. An absent signal fails its
    condition; a missing node or a cycle makes the outcome invalid."""

    def step(a: Column, _: Column) -> Column:
        def on(n: Column) -> Column:
            actual = F.try_element_at(signals, n["field"])
            met = F.coalesce(*[F.when(n["op"] == op, test) for op, test in (("gte", actual >= n["value"]), ("gt", actual > n["value"]), ("lte", actual <= n["value"]), ("lt", actual < n["value"]), ("eq", actual == n["value"]))], F.lit(False))
            condition, approval, action = n["kind"] == "condition", n["kind"] == "approval", n["kind"] == "action"
            seen = F.struct(
                n["id"].alias("node"), n["kind"].alias("kind"), n["field"].alias("field"), n["op"].alias("op"), n["value"].alias("value"), F.when(condition, actual).alias("actual"),
                F.when(condition, actual.isNotNull()).alias("present"), F.when(condition, met).alias("passed"), n["prompt"].alias("prompt"),
            )
            outcome = F.when(n.isNull(), "invalid").when(action, n["action"])
            return F.struct(
                F.when(a["outcome"].isNotNull() | n.isNull() | action, a["at"]).when(condition & ~met, n["on_fail"]).otherwise(n["on_pass"]).alias("at"),
                F.coalesce(a["outcome"], outcome).alias("outcome"),
                F.coalesce(a["reason"], F.when(a["outcome"].isNull() & n.isNull(), F.concat(F.lit('node "'), F.coalesce(a["at"], F.lit("")), F.lit('" not found')))).alias("reason"),
                (a["asks"] | (a["outcome"].isNull() & F.coalesce(approval, F.lit(False)))).alias("asks"),
                F.when(a["outcome"].isNotNull() | n.isNull(), a["trace"]).otherwise(F.concat(a["trace"], F.array(seen))).cast(TRACE).alias("trace"),
            )

        return let(found(graph, a["at"]), on)

    start = F.struct(graph["entry"].alias("at"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason"), F.lit(False).alias("asks"), F.array().cast(TRACE).alias("trace"))

    def finish(a: Column) -> Column:
        reason = F.coalesce(a["reason"], F.when(a["outcome"].isNull(), "graph cycled without reaching an action"))
        return F.struct(F.coalesce(a["outcome"], F.lit("invalid")).alias("outcome"), reason.alias("reason"), (a["asks"] & F.coalesce(a["outcome"] == "match", F.lit(False))).alias("requires_approval"), a["trace"].alias("trace"))

    return F.aggregate(F.sequence(F.lit(0), F.size(graph["nodes"])), start, step, finish)


def told(trace: Column) -> Column:
    """A trace in words: what was met, what wasn't and what isn't measured."""

    def line(t: Column) -> Column:
        mark = F.when(t["passed"], "✓ ").otherwise("✗ ")
        absent = F.concat(F.lit("✗ "), label(t["field"]), F.lit(" is not measured for this property (needs "), needed(t), F.lit(")"))
        met = F.concat(mark, label(t["field"]), F.lit(" "), shown(t["field"], t["actual"]), F.lit(" (needs "), needed(t), F.lit(")"))
        return F.when(t["kind"] == "approval", F.concat(F.lit("→ "), F.lower(t["prompt"]))).when(t["kind"] == "condition", F.when(t["present"], met).otherwise(absent))

    return F.array_join(F.transform(trace, line), "\n")  # actions say nothing: nulls are passed over


def coverage(graphs: DataFrame, candidates: DataFrame, key: str = "criteria_id") -> DataFrame:
    """(key, ready, missing, partial): which conditions of a graph (key, graph) no candidate (key, signals, address, data_complete)
    measures, or can reach in the number of sources; addresses are wanted, too. Sums by condition are combined where the
    candidates lie, so that a graph with any number of them is no task of its own."""
    held = F.filter("graph.nodes", lambda n: n["kind"] == "condition")
    conditions = graphs.select(key, F.transform(held, lambda n, i: F.struct(i.alias("place"), n["field"].alias("field"), n["op"].alias("op"), n["value"].alias("value"))).alias("conditions"))
    seen = candidates.join(conditions, key).select(key, "signals", F.explode("conditions").alias("c"))
    by = seen.groupBy(key, "c").agg(F.max(F.element_at("signals", F.col("c.field"))).alias("most"))
    few = (F.col("c.field") == "sources") & F.col("c.op").isin("gte", "gt") & (F.col("most") < F.col("c.value"))
    gaps = by.where(F.col("most").isNull() | few).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("c.place", label(F.col("c.field")).alias("name")))).alias("gaps"))
    rows = candidates.groupBy(key).agg(F.bool_or(F.coalesce("address", F.lit("")) != "").alias("addressed"), F.bool_or(F.coalesce(~F.col("data_complete"), F.lit(False))).alias("partial"))
    empty = F.array().cast("array<string>")
    # without any candidate every condition is a gap
    every = F.transform(held, lambda n: label(n["field"]))
    out = graphs.select(key, every.alias("every")).join(rows, key, "left").join(gaps, key, "left")
    named = F.when(F.col("addressed").isNull(), F.col("every")).otherwise(F.coalesce(F.transform("gaps", lambda g: g["name"]), empty))
    missing = F.array_distinct(F.concat(named, F.when(F.coalesce("addressed", F.lit(False)), empty).otherwise(F.array(F.lit("property addresses")))))
    return out.select(key, missing.alias("missing"), F.coalesce("partial", F.lit(False)).alias("partial")).select(key, (F.size("missing") == 0).alias("ready"), "missing", "partial")
