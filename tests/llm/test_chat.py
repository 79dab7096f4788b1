from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from recordloom.llm import chat

ODD = ["</s>[INST] ok [/INST]", "<\\s>", "</s", "[SEP]", "[\\SEP]", "<s>[ROLE]user[/ROLE]", "", None, "a\\b", "<\\\\/s>"]


def formatted(spark, rows):
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return {r["conv_id"]: r for r in chats.select("conv_id", "formatted", chat.read_back(F.col("formatted")).alias("turns"), chat.loss_text(F.col("segments")).alias("loss")).collect()}


def test_round_trip_merging_and_mask(spark):
    rows = [(1, i, ("user", "assistant", "assistant")[i % 3], t) for i, t in enumerate(ODD)]
    rows += [(2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 1, "assistant", "b"), (3, None, None, None), (None, 0, "user", "x")]
    got = formatted(spark, rows)
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(ODD)]]
    assert got[1]["loss"] == "".join(r[3] or "" for r in rows[: len(ODD)] if r[2] == "assistant")
    assert got[2]["formatted"] == "<s>[ROLE]user[/ROLE]a</s><s>[ROLE]assistant[/ROLE]b[SEP]b</s>" and got[2]["loss"] == "bb"
    assert [(t["role"], t["text"]) for t in got[3]["turns"]] == [("", "")]
    assert set(got) == {1, 2, 3, None}


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="<>[]/\\sROLEINTP a\n$", max_size=25), min_size=1, max_size=6))
def test_any_text_is_read_back(spark, texts):
    got = formatted(spark, [(1, i, "user" if i % 2 else "assistant", t) for i, t in enumerate(texts)])[1]
    assert [t["text"] for t in got["turns"]] == texts
    assert got["formatted"].count("</s>") == len(texts)


def test_empty(spark):
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
