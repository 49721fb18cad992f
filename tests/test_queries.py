"""Registered queries against their SQL at the smallest size (all of them: tests.run_oracle)."""

import pytest

import __spark_entry__ as entry_points
from tests.compare import difference
from tests.conftest import SMALL
from tests.run_oracle import connect

CHECKED = ["make_cohort", "entry_period", "stratified_folds", "util_window_wide",
           "lab_counts_wide", "feature_long_cond", "node_counts_by_fold", "expand_cuts_dedup",
           "merge_sets", "scrub_person_info", "metrics_one_vs_rest", "youden_sweep"]


@pytest.fixture(scope="module")
def con():
    return connect(SMALL)


def test_registry_is_consistent():
    missing = set(entry_points.queries()) - set(entry_points.oracle_sql())
    assert {n for n in missing if not n.startswith("op") and n != "pipeline"} == {
        "train_cv", "train_full", "grid_search"}
    assert {n for n in missing if n.startswith("op")} <= {
        "op2_toxicity", "op3_embedding_dedup", "op4_suffix_dedup", "op5_quality_model", "op6_simhash",
        "op7_mixing", "op8_sharding", "op9_bpe", "op12_packing"}
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


@pytest.mark.parametrize("name", CHECKED)
def test_query_matches_sql(spark, con, name):
    df = entry_points.queries()[name](spark, SMALL)
    assert difference(df, con.execute(entry_points.oracle_sql()[name])) is None


def test_results_do_not_depend_on_partitions(spark):
    query = entry_points.queries()["util_window_sparse"]
    before = sorted(tuple(r) for r in query(spark, SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(tuple(r) for r in query(spark, SMALL).collect()) == before
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
