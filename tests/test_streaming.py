from recordloom.operators import operations
from recordloom.operators.lifecycle import states
from recordloom.streaming import ingest

SCHEMA = "id string, property_key string, kind string, event_date string, recorded_at string"


def test_states_follow_batches_in_any_order(spark, tmp_path):
    inbox, table, out = str(tmp_path / "in"), str(tmp_path / "events"), str(tmp_path / "states")
    rows = [("1", "p", "tax_delinquency", "2024-01-01", "a"), ("3", "p", "sold_at_auction", "2024-03-01", "a"), ("2", "p", "deed_transfer", "2024-02-01", "b"), ("4", "q", "permit_issued", "2024-01-01", "a")]
    sink = ingest.keep_states(table, out)
    for batch in (rows[:2] + rows[:1], rows[2:], rows):
        spark.createDataFrame(batch, SCHEMA).write.mode("append").parquet(inbox)
        ingest.run_available(ingest.read_events(spark, inbox, SCHEMA), sink, str(tmp_path / "checkpoint"))
    assert spark.read.parquet(table).count() == 4
    want = {r["property_key"]: r["state"] for r in states(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert {r["property_key"]: r["state"] for r in ingest.latest_states(spark, out).collect()} == want == {"p": "SOLD_AT_AUCTION", "q": "NORMAL"}


def test_baselines_as_state_match_the_batch(spark, tmp_path):
    schema = "source_id string, seq long, rate double, repaired boolean"
    rows = [("a", i, 0.5 + i / 20, i == 4) for i in range(8)]
    inbox, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(inbox)
        stream = ingest.source_baselines(spark.readStream.schema(schema).parquet(inbox))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    last = max(spark.read.parquet(out).collect(), key=lambda r: r["seq"])
    want = operations.baselines(spark.createDataFrame(rows, schema)).first()
    assert abs(last["baseline"] - want["baseline"]) < 1e-12 and last["good_runs"] == want["good_runs"]
