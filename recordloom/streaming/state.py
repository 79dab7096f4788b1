"""What is learned of each source and each host, kept as state of a stream with timers.

transformWithState keeps it in the checkpoint: a query that is stopped and started again goes on with it. The session needs a state
store with column families: spark.sql.streaming.stateStore.providerClass = ...state.RocksDBStateStoreProvider (see PROVIDER).

With timers or a time to live a query runs batches without data, too, by the clock. To have one that ends by itself (availableNow),
set spark.sql.streaming.noDataMicroBatches.enabled to false: timers that are due then fire with the next rows.

Each stream has its batch form, which folds the same steps over sorted rows of a whole table and holds one key's state at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.operations import ALPHA, DRIFT, REPAIR_CONFIDENCE, REPAIR_RATE

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

#: Rows of a source: runs (its document read by the mapping that it has, and the mapping that would be inferred anew with its confidence
#: and rate), and overrides of a field (kind = override, label is the source's label).
RUNS = "source_id string, seq long, kind string, body_hash string, fingerprint string, records long, rate double, mapping string, mapping_confidence double, new_rate double, field string, label string"
OUTCOMES = "source_id string, seq long, outcome string, rate double, baseline double, good_runs long, mapping string, fingerprint string, overrides int"


@dataclass
class Source:
    """Learned state: the mapping in use, the fingerprint of its document's structure, baseline and number of good runs."""

    mapping: str = ""
    fingerprint: str = ""
    body_hash: str = ""
    baseline: float = 0.0
    good_runs: int = 0
    overrides: dict[str, str] = field(default_factory=dict)


def after(s: Source, r: dict) -> tuple[str, float | None]:
    """A source's state after one of its rows, in place; what came of it and at which rate."""
    if r["kind"] == "override":
        s.overrides[r["field"]] = r["label"]
        return "override", None
    if s.body_hash and r["body_hash"] == s.body_hash:
        return "unchanged", None
    s.body_hash = r["body_hash"]
    rate, outcome = r["rate"], "ok"
    if not s.mapping:
        s.mapping, rate, outcome = r["mapping"] or "", r["new_rate"], "learned"
    elif s.good_runs > 0 and (r["records"] == 0 or rate < DRIFT * s.baseline):
        gain = min(1.0, r["new_rate"] / s.baseline) if s.baseline > 0 else r["new_rate"]
        enough = r["new_rate"] >= REPAIR_RATE * s.baseline if s.baseline > 0 else r["new_rate"] > 0
        if not (r["mapping"] and enough and 0.5 * r["mapping_confidence"] + 0.5 * gain >= REPAIR_CONFIDENCE):
            return "drift", rate  # a repair is pending: the state stays as it was
        s.mapping, s.good_runs, rate, outcome = r["mapping"], 0, r["new_rate"], "repaired"
    s.baseline = rate if s.good_runs == 0 else (1 - ALPHA) * s.baseline + ALPHA * rate
    s.good_runs += 1
    s.fingerprint = r["fingerprint"]
    return outcome, rate


def told(source_id: str, seq: int | None, outcome: str, rate: float | None, s: Source) -> tuple:
    return source_id, seq, outcome, rate, s.baseline, s.good_runs, s.mapping, s.fingerprint, len(s.overrides)


def frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in OUTCOMES.split(", ")])
    return out.astype({"seq": "Int64", "rate": "Float64"})


def records(batch: pd.DataFrame) -> Iterator[dict]:
    for r in batch.to_dict("records"):
        yield {k: None if v is None or v != v else v for k, v in r.items()}


class Sources(StatefulProcessor):
    """Value state for a source's own values, map state for the overrides of its fields; a processing-time timer tells that a source
    has been silent for `silent_ms`. State that isn't touched for `ttl_ms` is forgotten."""

    def __init__(self, silent_ms: int, ttl_ms: int | None):
        self.silent_ms, self.ttl_ms = silent_ms, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.learned = handle.getValueState("learned", "mapping string, fingerprint string, body_hash string, baseline double, good_runs long", self.ttl_ms)
        self.overrides = handle.getMapState("overrides", "field string", "label string", self.ttl_ms)

    def held(self) -> Source:
        s = Source(*self.learned.get()) if self.learned.exists() else Source()
        s.overrides = {k[0]: v[0] for k, v in self.overrides.iterator()} if self.overrides.exists() else {}
        return s

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        s, out = self.held(), []
        for r in records(pd.concat(list(rows)).sort_values("seq", kind="stable")):  # a source's rows of one micro-batch
            outcome, rate = after(s, r)
            if outcome == "override":
                self.overrides.updateValue((r["field"],), (r["label"],))
            out.append(told(key[0], r["seq"], outcome, rate, s))
        self.learned.update((s.mapping, s.fingerprint, s.body_hash, s.baseline, s.good_runs))
        if self.silent_ms:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.silent_ms)
        yield frame(out)

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield frame([told(key[0], None, "silent", None, self.held())])

    def close(self) -> None:
        pass


def source_states(stream: DataFrame, silent_ms: int = 0, ttl_ms: int | None = None) -> DataFrame:
    """Outcomes (see OUTCOMES) of a stream of RUNS, with each source's state kept between batches. A run is unchanged (its body's hash is
    that of the last one), learned (the first mapping), ok, repaired (a mapping inferred anew took the old one's place) or drift (none
    could); overrides count, and silent sources are told after silent_ms without a row."""
    mode = "processingTime" if silent_ms or ttl_ms else "none"
    return stream.groupBy("source_id").transformWithStateInPandas(Sources(silent_ms, ttl_ms), OUTCOMES, "append", mode)


def folded(runs: DataFrame) -> DataFrame:
    """The same outcomes of a whole table of RUNS: sorted rows stream through each partition, one source's state is held at a time."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, s = None, Source()
        for b in batches:
            out = []
            for r in records(b):
                if r["source_id"] != key:
                    key, s = r["source_id"], Source()
                outcome, rate = after(s, r)
                out.append(told(key, r["seq"], outcome, rate, s))
            yield frame(out)

    return runs.repartition("source_id").sortWithinPartitions("source_id", "seq").mapInPandas(walk, OUTCOMES)


class Budget(StatefulProcessor):
    """Value state: when a host's window began, what of it is used, and when the host was last asked; forgotten after ttl_ms."""

    def __init__(self, per_window: int, window_s: int, gap_s: float, ttl_ms: int | None):
        self.per_window, self.window_s, self.gap_s, self.ttl_ms = per_window, window_s, gap_s, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.window = handle.getValueState("window", "opened long, used long, last double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        opened, used, last = self.window.get() if self.window.exists() else (None, 0, None)
        out = []
        for r in pd.concat(list(rows)).sort_values(["at_s", "id"], kind="stable").itertuples():
            if opened is None or r.at_s >= opened + self.window_s:
                opened, used = r.at_s, 0
            may = used < self.per_window
            wait = max(0.0, self.gap_s - (r.at_s - last)) if may and last is not None else 0.0
            if may:
                used, last = used + 1, r.at_s + wait
            out.append((key[0], r.at_s, r.id, may, wait if may else None))
        self.window.update((opened, used, last))
        yield pd.DataFrame(out, columns=["host", "at_s", "id", "allowed", "wait_s"]).astype({"wait_s": "Float64"})

    def close(self) -> None:
        pass


def host_budgets(stream: DataFrame, per_window: int = 60, window_s: int = 60, gap_s: float = 0.0, ttl_ms: int | None = None) -> DataFrame:
    """A stream of requests (host string, at_s long, id long) with allowed and wait_s, as operations.host_budget gives for a table: the
    host's window is state, and goes on over batches and restarts; hosts that aren't asked for ttl_ms are forgotten (it should be
    longer than a window)."""
    schema = "host string, at_s long, id long, allowed boolean, wait_s double"
    return stream.groupBy("host").transformWithStateInPandas(Budget(per_window, window_s, gap_s, ttl_ms), schema, "append", "processingTime" if ttl_ms else "none")
