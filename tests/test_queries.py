"""Every registered query against its SQL, on the given tables."""

import pytest
from checking import compare, duck

import __spark_entry__ as contract
from linkrank.catalog import REGISTRY

SF = "/root/testdata/sf0.01"
QUERIES = {key: contract.queries()[key] for key in REGISTRY}
ORACLES = {key: sql for key, sql in contract.oracle_sql().items() if key in REGISTRY}


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_matches_sql(spark, con, key):
    assert compare(QUERIES[key](spark, SF), con, ORACLES[key]) == []


@pytest.mark.parametrize("key", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, key):
    assert QUERIES[key](spark, SF).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry_has_rows(spark):
    df = contract.entry(spark)
    assert df.columns == ["artist", "track", "listeners", "playcount", "plays_per_listener", "tier"]
    assert df.count() > 0


HOT_QUERIES = [
    "left_join_compound",
    "anti_join",
    "inner_join_ci",
    "inner_join_mapping",
    "left_join_subquery",
    "one_to_many_lookup",
    "percent_rank_global",
    "percent_rank_partitioned",
    "composite_score",
    "punctuation_false_gems",
    "tag_fallback",
    "range_and_ratio",
    "decade_build",
]


@pytest.mark.parametrize("key", HOT_QUERIES)
def test_matches_sql_with_hot_keys_split_off(spark, con, key, monkeypatch):
    """The same results when every key with a few rows is treated as hot."""
    monkeypatch.setattr("linkrank.operators.joins.hot_shares", lambda spark: 2_000)
    assert compare(QUERIES[key](spark, SF), con, ORACLES[key]) == []
