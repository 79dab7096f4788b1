"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from recordloom import queries as library

HEADLINE = (
    "lifecycle_state", "lifecycle_transitions", "resolve_fields", "resolve_conflicts", "edition_history", "property_signals", "entity_groups", "uniqueness_guard", "content_ids",
    "decision_match", "idempotent_ingest", "latest_run", "ewma_baseline", "counties_rollup", "state_ratio", "mdape", "money_parse", "date_parse", "nb_counts", "nb_predict", "json_flatten", "page_projection",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1_000_000).selectExpr("id % 10 as k", "id").groupBy("k").count().collect()  # the session's start isn't a query's time
    timed = {}
    for name in HEADLINE:
        start = time.perf_counter()
        library.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timed[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timed.values()), 3), "unit": "sec", "queries": timed, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
