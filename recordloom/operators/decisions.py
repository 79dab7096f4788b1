"""Decision graphs over measured signals, saved criteria, coverage and fair top-k."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPERATORS = {"gte": lambda a, b: a >= b, "gt": lambda a, b: a > b, "lte": lambda a, b: a <= b, "lt": lambda a, b: a < b, "eq": lambda a, b: a == b}


def condition(signal: Column, op: str, value: float) -> Column:
    """An absent signal fails every condition."""
    return F.coalesce(OPERATORS[op](signal, F.lit(value)), F.lit(False))


def subject(*names: str) -> Column:
    """A map of the measured signals only."""
    return F.map_filter(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n).cast("double"))]), lambda _, v: v.isNotNull())


def validate_graph(graph: dict[str, Any], known: list[str] | None = None) -> list[str]:
    """What is wrong with a graph {entry, nodes: {id: {kind, ...}}}: missing nodes, odd operators, signals that aren't known, no match.
    Graphs as data, in which identifiers can repeat, are checked by criteria.problems."""
    nodes, wrong = graph["nodes"], []
    if graph["entry"] not in nodes:
        wrong.append(f"missing entry {graph['entry']}")
    for name, node in nodes.items():
        wrong += [f"{name}: no node {node[k]}" for k in ("then", "else", "next") if node.get(k) is not None and node[k] not in nodes]
        if node["kind"] == "condition" and node["op"] not in OPERATORS:
            wrong.append(f"{name}: unknown operator {node['op']}")
        if node["kind"] == "condition" and known is not None and node["signal"] not in known:
            wrong.append(f"{name}: unknown signal {node['signal']}")
    if not any(n["kind"] == "action" and n["name"] == "match" for n in nodes.values()):
        wrong.append("no match action: nothing can ever qualify")
    return wrong


def evaluate(rows: DataFrame, graph: dict[str, Any], signals: str = "signals") -> DataFrame:
    """rows with outcome, requires_approval, trace (nodes walked) and valid.

    Nodes: condition (signal, op, value, then, else), approval (next), action (name, a leaf). The walk is a fold over at
    most nodes + 1 steps; a missing node or a cycle makes the result invalid.
    """
    nodes = graph["nodes"]
    measured = lambda s: F.element_at(F.col(signals), s)

    def following(at: Column) -> Column:
        out = F.lit(None).cast("string")
        for name, n in nodes.items():
            if n["kind"] == "condition":
                to = F.when(condition(measured(n["signal"]), n["op"], n["value"]), F.lit(n["then"])).otherwise(F.lit(n["else"]))
            else:
                to = F.lit(n.get("next")).cast("string")
            out = F.when(at == name, to).otherwise(out)
        return out

    known = lambda at: at.isin(*nodes)
    leaf = lambda at: at.isin(*[k for k, n in nodes.items() if n["kind"] == "action"])
    start = F.struct(F.lit(graph["entry"]).alias("at"), F.array(F.lit(graph["entry"])).alias("trace"), F.lit(False).alias("done"))

    def step(a: Column, _: Column) -> Column:
        done = a["done"] | leaf(a["at"]) | ~known(a["at"])
        to = F.when(done, a["at"]).otherwise(F.coalesce(following(a["at"]), F.lit("")))
        return F.struct(to.alias("at"), F.when(done | (to == ""), a["trace"]).otherwise(F.concat(a["trace"], F.array(to))).alias("trace"), done.alias("done"))

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(len(nodes) + 1)), start, step)
    rows = rows.withColumn("__walk", walk)
    at = F.col("__walk.at")
    valid = leaf(at) & known(at)
    named = F.coalesce(*[F.when(at == k, n["name"]) for k, n in nodes.items() if n["kind"] == "action"], F.lit(None).cast("string"))
    approvals = [k for k, n in nodes.items() if n["kind"] == "approval"]
    asked = F.exists("__walk.trace", lambda t: t.isin(*approvals)) if approvals else F.lit(False)
    return rows.withColumns({"outcome": F.when(valid, named), "requires_approval": asked, "trace": F.col("__walk.trace"), "valid": F.coalesce(valid, F.lit(False))}).drop("__walk")


def strength(owed: Column, violations: Column, sources: Column, assessed: Column) -> Column:
    return F.coalesce(owed, F.lit(0.0)) * 1000 + F.coalesce(violations, F.lit(0)) * 100 + F.coalesce(sources, F.lit(0)) * 10 + F.coalesce(assessed, F.lit(0.0)) / 1e6


def round_robin(rows: DataFrame, market: str, by: str, order: str, limit: int) -> DataFrame:
    """The strongest of each market in turn, markets in the order of their first row (`order`), up to `limit` rows.
    Only the first `limit` of a market can be chosen, so these alone meet in the last sort."""
    within = Window.partitionBy(market).orderBy(F.desc(by), order)
    firsts = rows.groupBy(market).agg(F.min(order).alias("__first"))
    r = rows.withColumn("__turn", F.row_number().over(within)).where(F.col("__turn") <= limit).join(firsts, market)
    top = r.orderBy("__turn", "__first").limit(limit)
    return top.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("__turn", "__first"))).drop("__turn", "__first")


def coverage(rows: DataFrame, conditions: list[tuple[str, str, float]]) -> DataFrame:
    """(signal, op, value, present, reachable): how many rows measure a condition's signal, and whether any could meet it."""
    parts = [F.struct(F.lit(s).alias("signal"), F.lit(op).alias("op"), F.lit(float(v)).alias("value"), F.count(s).alias("present"), F.coalesce(F.bool_or(condition(F.col(s), op, v)), F.lit(False)).alias("reachable")) for s, op, v in conditions]
    return rows.agg(F.array(*parts).alias("c")).select(F.explode("c").alias("c")).select("c.*")
