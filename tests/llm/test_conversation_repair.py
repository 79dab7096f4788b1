import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recordloom.llm import conversation_repair as cr
from recordloom.llm import queries

TURNS = "conv_id long, turn long, role string, text string, at string, cost string"


def brute(rows):
    """All scripts of at most two insertions between rows, tried one by one: (cost, audit, repaired) of the best."""
    best = None
    gaps = [list(p) for n in range(3) for p in itertools.product("ua", repeat=n)]
    name = {"u": "user", "a": "assistant"}

    def go(i, cost, audit, out):
        nonlocal best
        if best and cost > best[0]:
            return
        for g in gaps:
            c, a, o = cost + 3 * len(g), audit + "I" * len(g), out + [(name[x], "") for x in g]
            if i == len(rows):
                if re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in o)):
                    best = min(best or (10**9,), (c, a, o))
                continue
            role, text, fault = rows[i]
            go(i + 1, c + 4, a + "D", o)
            if fault not in ("blank", "duplicate"):
                extra = 3 * (fault == "truncated")
                go(i + 1, c + extra, a + "K", o + [(role, text)])
                for new in ("user", "assistant"):
                    go(i + 1, c + extra + 3, a + "R", o + [(new, text)])

    go(0, 0, "", [])
    return best


def fault_of(rows):
    seen, out = set(), []
    for role, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]", text)
        fault = "blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else None
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def expected(turns):
    out = {}
    for conv in {t[0] for t in turns}:
        rows = sorted((t[1] is not None, t[1] or 0, " " if t[2] is None else t[2], " " if t[3] is None else t[3]) for t in turns if t[0] == conv)
        marked = fault_of([r[2:] for r in rows])
        cost, audit, repaired = brute(marked)
        at = [r[1] for r in rows if r[0]]
        initials = [r[2][:1] for r in rows]
        count = lambda f: sum(x[2] == f for x in marked)
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(at) - min(at) + 1 - len(set(at)) if at else 0, count("blank"), count("duplicate"), count("truncated"), illegal, cost, audit, repaired)
    return out


def run(spark, turns):
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], TURNS)
    convs, repaired = cr.repair(df)
    texts = {}
    for r in repaired.orderBy("at", "part").collect():
        texts.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    shas = {r["conv_id"]: r["sha256"] for r in cr.digests(repaired).collect()}
    for conv, rows in texts.items():
        assert shas.pop(conv) == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in rows).encode()).hexdigest()
    assert not shas
    return {r["conv_id"]: (*r[1:], texts.get(r["conv_id"], [])) for r in convs.collect()}


def some(seed, convs, most):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "and", "", " \n", "What?", "Well. ", "Ok."]
    return [(c, r.choice([t, t, t, None]), r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), r.choice([*texts, None])) for c in range(convs) for t in range(r.randint(1, most))]


@pytest.mark.parametrize("bits", [0, 1, 15])
def test_against_all_scripts(spark, monkeypatch, bits):
    monkeypatch.setattr(cr, "BLOCK_BITS", bits)
    turns = some(3, 40, 5) + [(None, 1, "user", "Hi."), (None, 2, "assistant", "Ho.")]
    turns += [(99, t, "user" if t % 2 else "assistant", f"{t}.") for t in range(6)] + [(98, 0, "user", "x" * 1_000_000 + ".")]
    assert run(spark, turns) == expected(turns)


def test_the_middle_of_a_long_conversation_is_met_from_both_sides():
    r = random.Random(8)
    for _ in range(300):
        rows = "".join(chr(65 + r.randint(0, 11)) for _ in range(r.randint(2, 40)))
        for start in cr.STATES:
            costs, _ = cr.forward(rows, start)
            for end in cr.STATES:
                if costs[end] < cr.INF:
                    codes = cr.script(rows, start, end)
                    # carried whole, without halves
                    best = {start: (0, "")}
                    for x in rows:
                        new = {}
                        for q, (c, a) in best.items():
                            for after, more, code in cr.steps(x)[q]:
                                new[after] = min(new.get(after, (10**9, "")), (c + more, a + cr.letters(code)))
                        best = new
                    assert (costs[end], "".join(map(cr.letters, codes))) == best[end]
                    assert cr.backward(rows, [0 if q == end else cr.INF for q in cr.STATES])[start] == costs[end]


def test_empty(spark):
    assert run(spark, []) == {}


def test_planted_faults(spark):
    turns = [(c, t, "assistant", "One. Two!") for c in range(30) for t in range(4)] + [(None, None, None, None)]
    df = spark.createDataFrame([(*t, "x", "y") for t in turns], TURNS)
    got = sorted(cr.damaged(df).select(F.coalesce("conv_id", F.lit(-1)), F.coalesce("turn", F.lit(-1)), "role", "text").collect())
    want = []
    for c, t, role, text in turns:
        role, text = role or " ", text or " "
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        row = (-1 if c is None else c, -1 if t is None else t, "user" if k == 4 else role, "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text)
        want += [row] * {0: 0, 3: 2}.get(k, 1)
    assert sorted(map(tuple, got)) == sorted(want)


def test_conversations_without_rows_are_reported(spark, tmp_path):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    spark.createDataFrame([(gone, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    assert [tuple(r) for r in queries.QUERIES["op12_repair"](spark, str(tmp_path)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
