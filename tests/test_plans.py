import re

import pytest

from recordloom import queries

SF = "/root/testdata/sf0.001"
NATIVE = "lifecycle_state lifecycle_transitions property_signals entity_groups uniqueness_guard content_ids decision_match idempotent_ingest latest_run ewma_baseline counties_rollup state_ratio mdape money_parse date_parse nb_counts nb_leave_one_out json_flatten page_projection resolve_fields resolve_conflicts edition_change nb_predict".split()


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_stays_in_the_jvm_without_cartesian_products(spark, name):
    text = plan(queries.QUERIES[name](spark, SF))
    assert not re.search("Python|Pandas|ArrowEval|CartesianProduct", text)


def test_columns_are_pruned_and_states_are_not_sorted(spark):
    text = plan(queries.QUERIES["lifecycle_state"](spark, SF))
    assert "o_totalprice" not in text and "c_name" not in text
    assert "Window" not in text


def test_events_are_not_dealt_by_their_nation(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the tables were large
    try:
        text = plan(queries.QUERIES["enrichment_semi"](spark, SF))
        assert text.count("hashpartitioning(join_key") <= 1  # of the distinct scopes only
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_addresses_are_parsed_once(spark):
    files = queries.QUERIES["uniqueness_guard"](spark, SF).inputFiles()
    assert files and all("/recordloom-" in f for f in files)


def test_a_countys_groups_are_found_once(spark):
    assert any("/recordloom-" in f for f in queries.QUERIES["compiled_county"](spark, SF).inputFiles())
