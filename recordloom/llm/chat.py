"""Chat formatting with Spark expressions only.

A conversation's turns are collected as structs, sorted, and adjacent turns of one role become one run:

    <s>[ROLE]user[/ROLE]first text[SEP]second text of the same role</s><s>[ROLE]assistant[/ROLE]answer</s>

Inside texts and roles a control string gets one backslash after its first character, and one that already has
backslashes there gets one more, so no control string is left in them and taking one backslash away restores
them. The [SEP] mark keeps merged turns apart, so the rows can be read back. The formatted value is the
concatenation of segments, each under the loss mask or not: the mask covers the texts of assistant turns, not the marks.

Turns are collected with map-side combining: a shuffled row is all that a task has of a conversation, so one hot
conversation costs a task its own text, which the formatted value needs in one place anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The template's own control strings, and those of common instruction templates.
CONTROLS = ("<s>", "</s>", "[ROLE]", "[/ROLE]", "[SEP]", "[INST]", "[/INST]")
INNER = r"(/?s>|/?ROLE\]|SEP\]|/?INST\])"
BEGIN, ROLE_END, SEP, END = "<s>[ROLE]", "[/ROLE]", "[SEP]", "</s>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(\\*)" + INNER, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\\(\\*)" + INNER, r"$1$2$3")


def format_chats(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """One row for each conversation: conv_id, formatted, segments array<struct<text, loss>> whose texts make up formatted.

    Rows go by turn, ties by role and then text; repeated rows are turns of their own. A null text or role counts
    as empty, a null turn comes first, rows with a null conversation form one. Other columns aren't looked at. An
    empty table gives an empty one.
    """
    text = lambda c: escape(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")))
    rows = turns.select(F.col(f"`{conv_col}`").alias("conv_id"), F.struct(F.col(f"`{turn_col}`").alias("turn"), text(role_col).alias("role"), text(text_col).alias("text")).alias("turn"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("turn")).alias("turns"))
    turn = lambda i: F.element_at("turns", i + 1)

    def pieces(x: Column, i: Column) -> Column:
        opens = (i == 0) | (turn(F.greatest(i - 1, F.lit(0)))["role"] != x["role"])
        closes = (i == F.size("turns") - 1) | (turn(F.least(i + 1, F.size("turns") - 1))["role"] != x["role"])
        part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
        head = F.when(opens, F.concat(F.lit(BEGIN), x["role"], F.lit(ROLE_END))).otherwise(F.lit(SEP))
        return F.array(part(head, F.lit(False)), part(x["text"], x["role"] == trained_role), part(F.when(closes, F.lit(END)).otherwise(F.lit("")), F.lit(False)))

    chats = chats.select("conv_id", F.flatten(F.transform("turns", pieces)).alias("segments"))
    return chats.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, array<struct<role, text>>."""
    runs = F.filter(F.split(formatted, END), lambda r: r != "")

    def turns(run: Column) -> Column:
        inside = F.substring(run, F.lit(len(BEGIN) + 1), F.length(run))
        role = F.substring_index(inside, ROLE_END, 1)
        body = F.substring(inside, F.length(role) + len(ROLE_END) + 1, F.length(inside))
        return F.transform(F.split(body, r"\[SEP\]", -1), lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(runs, turns))


def loss_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
