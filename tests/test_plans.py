"""What the physical plans of the registered queries must and must not hold."""

import re

import pytest

import __spark_entry__ as contract
from linkrank.catalog import REGISTRY

SF = "/root/testdata/sf0.001"
QUERIES = {key: contract.queries()[key] for key in REGISTRY}

# Running sums over one row per slot.
ONE_TASK_WINDOWS = {
    "page_build": "one row per slot",
    "percent_rank_global": "one row per slot",
    "composite_score": "one row per slot",
}


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("key", sorted(QUERIES))
def test_no_pairs_and_no_python_rows(spark, key):
    plan = plan_of(QUERIES[key](spark, SF))
    for banned in ("CartesianProduct", "BroadcastNestedLoopJoin", "EvalPython", "PythonUDF", "InPandas"):
        assert banned not in plan
    one_task = re.search(r"Window \[[^\n]*\n[\s:+|-]*(Sort[^\n]*\n[\s:+|-]*)?Exchange SinglePartition", plan)
    assert not one_task or key in ONE_TASK_WINDOWS, plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = plan_of(QUERIES["play_floor_diff"](spark, SF))
    lines = [line for line in plan.splitlines() if "FileScan" in line and "l_shipdate" in line]
    assert len(lines) == 2 and all(re.search(r"PushedFilters: \[[^]]*(LessThan|GreaterThanOrEqual)\(l_shipdate", x) for x in lines)
    scan = plan_of(QUERIES["table_scan"](spark, SF))
    assert "ReadSchema: struct<o_orderkey:bigint,o_totalprice:double>" in scan


def test_collapse_and_anti_join_share_one_shuffle(spark):
    """The key aggregate already has the partitioning the anti-join needs."""
    plan = plan_of(QUERIES["gems_build"](spark, SF))
    assert plan.count("Exchange hashpartitioning(artist_key") == 2
    assert "LeftAnti" in plan


def test_best_n_is_cut_before_the_shuffle(spark):
    for key in ("best_per_group", "top_n_per_group", "top_k_per_decade", "group_dedup"):
        plan = plan_of(QUERIES[key](spark, SF))
        assert re.search(r"WindowGroupLimit [^\n]*Partial", plan), key
    assert "TakeOrderedAndProject" in plan_of(QUERIES["topk"](spark, SF))


def test_stored_keys_join_without_a_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        plan = plan_of(QUERIES["stored_keys_join"](spark, SF))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_each_reply_is_parsed_once(spark):
    for key in ("parse_trackinfo_json", "decade_match_report", "group_match_rate", "blend_year"):
        plan = plan_of(QUERIES[key](spark, SF))
        branches = plan.count("from_json(")
        assert branches == plan.count(" AS reply#"), key
