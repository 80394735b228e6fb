import os
import re

import pytest

import __spark_entry__ as contract
from precinct.functions.predicates import in_window
from precinct.operators import relational as rel
from precinct.operators.splits import time_split
from precinct.plans import quality_queries
from precinct.plans.registry import ORACLES, QUERIES
from precinct.sources.testviews import load
from conftest import SF
from pyspark.sql import functions as F

MODELS = {"logistic_regression", "decision_tree", "random_forest", "interim_forest", "boosted_trees", "boosted_trees_final",
          "score_requests_final", "tuned_selection", "class_decision_weights", "feature_importance", "batch_prediction", "previous_and_final", "score_requests_interim",
          "boosting_losses", "boosted_importance"}
EVERY = os.environ.get("ALL_ORACLES")
SAMPLE = ["missing_profile", "cardinality", "duplicate_profile", "repeated_key_rows", "validity_checks", "clean_dedup",
          "quartiles_exact", "snapshot_digest", "class_distribution", "class_imbalance", "matched_calendar_window",
          "month_counts", "weekday_exposure", "daily_iqr_flags_events", "sparse_groups", "density_grid", "category_mix_all",
          "zone_mix", "findings", "overview", "trend_grid", "area_profile_top3", "time_split_coverage", "stratified_split",
          "mix_features_all", "overall_with_unseen", "topk_accuracy", "select_winner", "validate_requests", "expand_requests",
          "score_summary", "encode_assemble", "csv_round_trip", "overlapping_parts", "resolved_source", "catalog_listing", "described_schema",
          "saved_and_stored", "decision_tree_facts", "run_manifest", "sketched_distinct", "sketched_quantiles", "scoring_work", "rewritten_table",
          "leakage_check"]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_contract_is_consistent():
    assert set(contract.oracle_sql()) <= set(contract.queries()) and len(contract.queries()) > 150
    assert set(QUERIES) <= set(contract.queries())
    assert set(QUERIES) - set(ORACLES) <= MODELS | {"approx_distinct_review", "approx_quartiles"}


def test_entry_has_rows_and_a_schema(spark):
    df = contract.entry(spark)
    assert df.columns == ["group_value", "primary_type", "count", "within_group_pct"] and df.count() > 0


@pytest.fixture(scope="module")
def engine():
    from oracle import connect
    return connect(SF)


@pytest.mark.parametrize("name", sorted(ORACLES) if EVERY else SAMPLE)
def test_query_equals_its_sql(spark, engine, name):
    from oracle import compare
    assert compare(spark, engine, name, contract.queries()[name], contract.oracle_sql()[name], SF) is None


@pytest.mark.parametrize("name", ["missing_profile", "class_distribution", "month_counts", "hotspots", "category_mix_all", "confusion",
                                  "mix_features_all", "average_probabilities", "repeated_key_rows", "zone_mix", "per_class_metrics",
                                  "select_winner", "score_summary", "recommendations", "class_imbalance", "csv_round_trip", "valid_requests", "findings"])
def test_plans_hold_no_cross_join_and_no_python(spark, name):
    text = plan(contract.queries()[name](spark, SF))
    assert not re.search(r"CartesianProduct|BroadcastNestedLoopJoin|ArrowEvalPython|BatchEvalPython|FlatMapGroups", text)


def test_time_split_reaches_the_scan(spark):
    orders = load(spark, SF, "orders").select("o_orderkey", "o_orderdate")
    train, _, _ = time_split(orders, "1999-07-01", "2000-07-01", "o_orderdate")
    text = plan(train)
    assert "LessThan(o_orderdate" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in text
    both = plan(orders.filter(in_window(F.col("o_orderdate"), "1999-01-01", "1999-02-01")))
    assert "GreaterThanOrEqual(o_orderdate" in both


def test_group_counts_read_one_column_and_aggregate_before_the_shuffle(spark):
    text = plan(rel.value_counts(load(spark, SF, "orders"), "o_orderpriority"))
    assert "ReadSchema: struct<o_orderpriority:string>" in text
    assert text.index("partial_count") > text.index("Exchange hashpartitioning")


def test_small_mix_tables_are_broadcast_and_rows_stay_in_place(spark):
    text = plan(contract.queries()["mix_features_all"](spark, SF))
    assert "SortMergeJoin" not in text


def test_registered_rules_name_every_code():
    assert len(quality_queries.RULES) == 6
