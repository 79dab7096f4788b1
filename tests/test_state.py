import random
import time

import pytest

from recordloom.operators import operations
from recordloom.streaming import state


@pytest.fixture
def session(spark):
    wanted = {"spark.sql.streaming.stateStore.providerClass": state.PROVIDER, "spark.sql.streaming.noDataMicroBatches.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def run(session, folder, schema, make, rows):
    """One more batch of a query that is started anew each time."""
    session.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = make(session.readStream.schema(schema).parquet(f"{folder}/in"))
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").trigger(availableNow=True).start()
    assert q.awaitTermination(100)
    return session.read.parquet(f"{folder}/out")


def rows_of(seed, sources=4, each=14):
    r = random.Random(seed)
    out = []
    for s in range(sources):
        for i in range(each):
            if r.random() < 0.15:
                out.append((f"s{s}", i, "override", None, None, None, None, None, None, None, r.choice("ab"), f"l{i}"))
                continue
            bad = r.random() < 0.3
            out.append((f"s{s}", i, "run", f"h{r.randint(0, 9)}", f"f{i}", 0 if r.random() < 0.1 else 5, 0.1 if bad else r.uniform(0.7, 1), f"m{i}", r.choice([0.3, 0.95]), r.uniform(0.5, 1), None, None))
    return out


def by_hand(rows):
    """Plain rules over sorted rows of one source."""
    out, mapping, base, good, last, over, print_ = [], "", 0.0, 0, None, set(), ""
    for _, seq, kind, body, fp, n, rate, new, conf, new_rate, field, _ in sorted(rows, key=lambda x: x[1]):
        if kind == "override":
            over.add(field)
            out.append((seq, "override", base, good, mapping, print_, len(over)))
            continue
        if body == last:
            out.append((seq, "unchanged", base, good, mapping, print_, len(over)))
            continue
        last, what = body, "ok"
        if mapping == "":
            mapping, rate, what = new, new_rate, "learned"
        elif good and (n == 0 or rate < 0.6 * base):
            if not (new_rate >= 0.7 * base and 0.5 * conf + 0.5 * min(1, new_rate / base) >= 0.75):
                out.append((seq, "drift", base, good, mapping, print_, len(over)))
                continue
            mapping, good, rate, what = new, 0, new_rate, "repaired"
        base, good, print_ = (rate if good == 0 else 0.7 * base + 0.3 * rate), good + 1, fp
        out.append((seq, what, base, good, mapping, print_, len(over)))
    return out


def told(df):
    got = {}
    for r in df.orderBy("source_id", "seq").collect():
        got.setdefault(r["source_id"], []).append((r["seq"], r["outcome"], pytest.approx(r["baseline"]), r["good_runs"], r["mapping"], r["fingerprint"], r["overrides"]))
    return got


def test_sources_learn_over_restarts_as_in_a_batch(session, tmp_path):
    rows = rows_of(5)
    want = {s: by_hand([r for r in rows if r[0] == s]) for s in {r[0] for r in rows}}
    assert told(state.folded(session.createDataFrame(rows, state.RUNS))) == want
    for part in ([r for r in rows if r[1] < 5], [r for r in rows if 5 <= r[1] < 9], [r for r in rows if r[1] >= 9]):
        out = run(session, tmp_path, state.RUNS, state.source_states, part)
    assert told(out) == want
    assert {o[1] for w in want.values() for o in w} == {"override", "unchanged", "ok", "learned", "drift", "repaired"}


def test_silent_sources_are_told(session, tmp_path):
    row = lambda s, i: (s, i, "run", f"h{i}", "f", 5, 0.9, "m", 0.9, 0.9, None, None)
    make = lambda stream: state.source_states(stream, silent_ms=1)
    run(session, tmp_path, state.RUNS, make, [row("a", 1), row("b", 1)])
    time.sleep(0.1)
    out = run(session, tmp_path, state.RUNS, make, [row("c", 1)])
    assert {"a", "b"} <= {r["source_id"] for r in out.where("outcome = 'silent'").collect()}


def test_budgets_over_restarts_as_in_a_batch(session, tmp_path):
    r = random.Random(2)
    schema = "host string, at_s long, id long"
    rows = sorted(((r.choice("ab"), r.randint(0, 60), i) for i in range(120)), key=lambda x: x[1])
    make = lambda s: state.host_budgets(s, per_window=4, window_s=10, gap_s=2.0)
    at = [max(i for i, x in enumerate(rows) if x[1] <= t) + 1 for t in (19, 41)]
    for part in (rows[: at[0]], rows[at[0] : at[1]], rows[at[1] :]):
        out = run(session, tmp_path, schema, make, part)
    want = operations.host_budget(session.createDataFrame(rows, schema), 4, 10, 2.0)
    assert sorted(map(tuple, out.select("host", "at_s", "id", "allowed", "wait_s").collect())) == sorted(map(tuple, want.select("host", "at_s", "id", "allowed", "wait_s").collect()))
