"""Skew paths, match counting and percent ranks against the plain operators."""

from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkrank.operators import joins as jn
from linkrank.operators import rank
from linkrank.operators.review import false_merge_check


def rows(df):
    return Counter(tuple(r) for r in df.collect())


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows under one key, a twelfth NULL, the rest spread out."""
    n = 60_000
    key = (
        F.when(F.col("id") % 2 == 0, F.lit("hot"))
        .when(F.col("id") % 12 == 1, F.lit(None))
        .otherwise(F.concat(F.lit("k"), (F.col("id") % 997).cast("string")))
    )
    return spark.range(n).select(key.alias("k"), F.col("id").alias("v"))


@pytest.fixture(scope="module")
def lookup(spark):
    return spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 997, 2)], "k string, w bigint")


def test_hot_keys_are_found(spark, skewed):
    """Half of the rows are more than a partition's share; a twelfth is not, among eight partitions."""
    expected = {r[0] for r in spark.createDataFrame([("hot",)], "k string").select(F.xxhash64("k")).collect()}
    assert set(jn.hot_hashes(skewed, ["k"])) == expected
    assert jn.hot_hashes(skewed.where("k <> 'hot'"), ["k"]) == []


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_lookup_join_equals_plain_join(skewed, lookup, how):
    got = jn.lookup_join(skewed, lookup, ["k"], how)
    plan = got._jdf.queryExecution().toString()
    assert "Union" in plan
    assert rows(got) == rows(skewed.join(lookup, ["k"], how))


def test_lookup_join_without_hot_keys_is_the_plain_join(skewed, lookup):
    even = skewed.where("k <> 'hot'")
    assert "Union" not in jn.lookup_join(even, lookup, ["k"])._jdf.queryExecution().toString()


def test_partners_that_are_many_are_not_broadcast(skewed, monkeypatch):
    monkeypatch.setattr("linkrank.operators.joins.MAX_HOT", 8)
    many = skewed.where("k = 'hot' AND v < 100").select("k", F.col("v").alias("w"))
    few = skewed.where("k = 'hot' AND v < 20").unionByName(skewed.where("k = 'k7' AND v < 9000"))
    got = jn.lookup_join(few, many, ["k"], "inner", hot=jn.hot_hashes(skewed, ["k"]))
    assert rows(got) == rows(few.join(many, ["k"]))
    assert "ResolvedHint" not in got._jdf.queryExecution().analyzed().toString()


def test_lookup_join_aligns_key_types(frame):
    left = frame([(1, "a"), (2, "b")], "k int, v string")
    right = frame([(1, "x"), (5_000_000_000, "y")], "k bigint, w string")
    for a, b in ((left, right), (right, left)):
        assert rows(jn.lookup_join(a, b, ["k"], "inner")) == rows(a.join(b, ["k"]))


def test_unmatched_keeps_null_keys(frame):
    left = frame([("a",), (None,), ("b",)], "k string")
    right = frame([("a",), ("a",), (None,)], "k string")
    assert rows(jn.unmatched(left, right, ["k"])) == Counter({(None,): 1, ("b",): 1})


def test_match_rate_counts_fanout_without_pairs(frame):
    left = frame([("a", "x")] * 3 + [("b", "y"), (None, "z")], "artist_key string, title_key string")
    right = frame([("a", "x"), ("a", "x"), (None, "z")], "artist_key string, title_key string")
    keys = ["artist_key", "title_key"]
    got = jn.match_rate(left, right, keys).first()
    assert (got["total"], got["matched"], got["matched_pct"]) == (8, 6, 75.0)
    assert tuple(jn.fanout_report(left, right, keys).first()) == (5, 8, 1)


def test_match_rate_of_nothing(frame):
    empty = frame([], "k string")
    assert tuple(jn.match_rate(empty, empty, ["k"]).first()) == (0, 0, None)


def test_orphans(frame):
    child = frame([(1,), (1,), (2,), (3,)], "k int")
    assert tuple(jn.orphan_report(child, frame([(2,)], "k int"), ["k"]).first()) == (3, 2)


def plain_rank(df, col, *parts):
    return df.withColumn("pr", F.percent_rank().over(W.partitionBy(*parts).orderBy(F.col(col).asc_nulls_first())))


def test_percent_rank_with_ties_nulls_and_a_hot_value(spark):
    value = F.when(F.col("id") % 3 == 0, 7.5).when(F.col("id") % 11 == 0, None).otherwise(F.col("id") % 501)
    df = spark.range(20_000).select("id", value.cast("double").alias("x"))
    got = rank.percent_rank_at_scale(df, "x", "pr")
    assert rows(got.select("id", "x", "pr")) == rows(plain_rank(df, "x").select("id", "x", "pr"))


def test_percent_rank_per_group_with_one_big_group(spark):
    small = F.when(F.col("id") % 21 > 0, F.concat(F.lit("g"), (F.col("id") % 7).cast("string")))
    group = F.when(F.col("id") % 3 > 0, "big").otherwise(small)  # NULL is a group too
    df = spark.range(9_000).select("id", group.alias("g"), (F.col("id") * 37 % 2_003).alias("x"))
    got = rank.percent_rank_at_scale(df, "x", "pr", ("g",))
    assert rows(got.select("id", "g", "pr")) == rows(plain_rank(df, "x", "g").select("id", "g", "pr"))


@pytest.mark.parametrize("values", [[5.0], [None], [], [1.0, 1.0], [None, 2.0]])
def test_percent_rank_small_inputs(frame, values):
    df = frame([(v,) for v in values], "x double")
    assert rows(rank.percent_rank_at_scale(df, "x", "pr")) == rows(plain_rank(df, "x"))


@settings(max_examples=6, deadline=None)
@given(st.lists(st.one_of(st.none(), st.integers(-20, 20)), min_size=1, max_size=300))
def test_percent_rank_property(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "x bigint")
    assert rows(rank.percent_rank_at_scale(df, "x", "pr")) == rows(plain_rank(df, "x"))


def test_top_n_ties_fall_to_the_names(frame):
    df = frame([("a", "z", 1.0), ("a", "y", 1.0), ("a", "x", 0.5), ("b", "q", 0.1)], "artist string, track string, s double")
    best = rank.top_n_per_group(df, ["artist"], [F.desc("s"), F.asc("track")], 2)
    assert rows(best.select("artist", "track")) == Counter({("a", "y"): 1, ("a", "z"): 1, ("b", "q"): 1})


def test_top_n_is_cut_before_the_shuffle(skewed):
    plan = rank.top_n_per_group(skewed, ["k"], [F.desc("v")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")


def test_false_merges(frame):
    songs = frame(
        [("A", "The"), ("A", "?"), ("A", "Go"), ("B", "Paint It, Black"), ("B", "Paint It Black")],
        "primary_artist string, title string",
    )
    found = {(r["artist_key"], r["title_key"]): (r["titles"], r["first_title"], r["last_title"]) for r in false_merge_check(songs).collect()}
    assert found == {
        ("a", ""): (2, "?", "The"),
        ("b", "paint it black"): (2, "Paint It Black", "Paint It, Black"),
    }


def test_long_lists_match_the_plain_window(skewed):
    """Above Spark's early cut the rows are numbered slot by slot."""
    order = [F.desc("v")]
    number = F.row_number().over(W.partitionBy("k").orderBy(*order))
    for n in (1_000, 1_001, 25_000):
        got = rank.top_n_per_group(skewed, ["k"], order, n, rank="rk")
        expected = skewed.withColumn("rk", number).where(F.col("rk") <= n)
        assert got.dtypes == expected.dtypes
        assert rows(got) == rows(expected)


@settings(max_examples=5, deadline=None)
@given(
    st.lists(st.tuples(st.sampled_from("aaaab"), st.integers(0, 9)), min_size=1, max_size=80),
    st.lists(st.sampled_from("abc"), unique=True, max_size=3),
)
def test_lookup_join_property(spark, left, right):
    a = spark.createDataFrame(left, "k string, v int")
    b = spark.createDataFrame([(k, k * 2) for k in right], "k string, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(jn.lookup_join(a, b, ["k"], how)) == rows(a.join(b, ["k"], how))


def test_numbered_rows_are_shuffled_once(frame):
    """Row numbers follow from places in sorted slots; the rows meet one row per group and slot."""
    rows = [(g, v) for g in ("a", "b", None) for v in range(200)] + [("c", None), ("c", 1)]
    df = frame(rows, "g string, v int").repartition(7)
    got = rank.numbered(df, ["g"], [F.desc("v")], "n")
    want = [("c", 1, 1), ("c", None, 2)] + [(g, v, 200 - v) for g in ("a", "b", None) for v in range(200)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    plan = got._jdf.queryExecution().toString()
    assert "Window" not in plan and "hashpartitioning" not in plan


def test_numbered_with_many_groups(frame, monkeypatch):
    """More groups than are broadcast."""
    monkeypatch.setattr(rank, "MOST_SLOTS", 10)
    rows = [(g, v) for g in range(50) for v in range(4)]
    got = rank.numbered(frame(rows, "g int, v int"), ["g"], [F.col("v")], "n", 3)
    assert sorted(map(tuple, got.collect())) == [(g, v, v + 1) for g in range(50) for v in range(3)]
