"""Exact percentiles from sketched brackets, stored profiles, SQL functions, all cutoffs at once."""

import math
import random

import pytest
from pyspark.sql import functions as F

from linkrank.functions import keys as ky
from linkrank.functions import sql
from linkrank.functions import text as tx
from linkrank.operators import profile as pf
from linkrank.operators.quantiles import exact_quantiles
from linkrank.plans import gems as plan
from linkrank.runtime import materialize


def plain(rows, shares):
    out = set()
    for g in {g for g, _ in rows}:
        values = sorted(v for x, v in rows if x == g and v is not None)
        for s in shares if values else ():
            out.add((g, s, len(values), values[max(1, math.ceil(round(s * len(values), 6))) - 1]))
    return out


@pytest.mark.parametrize(("margin", "most"), [(0.02, 10**6), (0.0, 10**6), (0.3, 5)])
def test_exact_quantiles(frame, margin, most):
    """With no margin brackets miss and grow; with few values allowed inside they are halved."""
    rng = random.Random(3)
    rows = [("hot", rng.randrange(10**6)) for _ in range(3000)] + [("ties", rng.choice([1, 1, 1, 9])) for _ in range(400)]
    rows += [(None, k) for k in range(7)] + [("one", -5), ("none", None), ("none", None)]
    shares = [0.0, 0.5, 0.9, 0.99, 1.0]
    got = exact_quantiles(frame(rows, "g string, v long"), ["g"], "v", shares, k=64, margin=margin, most_inside=most)
    assert got.columns == ["g", "share", "rows", "value"]
    assert {tuple(r) for r in got.collect()} == plain(rows, shares)


def test_quantiles_of_an_empty_table(frame):
    assert exact_quantiles(frame([], "g string, v long"), ["g"], "v", [0.5]).collect() == []


def test_merged_profiles_equal_one_profile(frame):
    rows = [(k % 700, None if k % 5 == 0 else f"v{k % 13}", "" if k % 2 else "x") for k in range(3000)]
    df = frame(rows, "a int, b string, c string")
    stored = materialize(pf.profile_sketches(df.where("a < 300"))).unionByName(materialize(pf.profile_sketches(df.where("a >= 250"))))
    merged = {r["column_name"]: r for r in pf.merged_profile(stored).collect()}
    both = {r["column_name"]: r for r in pf.profile_table(df.where("a < 300").unionByName(df.where("a >= 250"))).collect()}
    for name, r in both.items():
        m = merged[name].asDict()
        distinct = m.pop("distinct_count")
        assert m == {k: v for k, v in r.asDict().items() if k != "distinct_count"}
        assert abs(distinct - r["distinct_count"]) <= 4 * 1.04 / 2**7 * max(1, r["distinct_count"])


TEXTS = ["A Featuring B", "X A Duet With Y Duet With Z", "It's The (Sun) - Live (Feat. C)", "a\\b 'q' (with D)", "", "  ", None, "Ünïcode VERSION", "an a the"]


def test_sql_functions_equal_the_columns(spark, frame):
    sql.register(spark)
    frame([(k, x) for k, x in enumerate(TEXTS)], "k long, t string").createOrReplaceTempView("some_texts")
    got = spark.sql(
        """SELECT k, primary_entity(t) a, title_cut_tail(t) b, title_cut_dash(t) c, match_key(t, 0) d, match_key(t, 1) e, match_key(t, 2) f,
        match_key(t, 3) g, song_key(t, 2) h, song_key(t, 3) i, is_variant(t) j, tier_label(k, 2, 5) l, duration_text(k * 31000) m FROM some_texts"""
    )
    t, k = F.col("t"), F.col("k")
    columns = [ky.primary_entity(t), ky.title_cut_tail(t), ky.title_cut_dash(t), *(ky.match_key(t, n) for n in range(4))]
    columns += [ky.song_key(t, 2), ky.song_key(t, 3), tx.has_any_marker(t), tx.tier(k, 2, 5), tx.duration_text(k * 31000)]
    expected = spark.table("some_texts").select("k", *[c.alias(f"c{n}") for n, c in enumerate(columns)])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, expected.collect()))


def test_script_and_columns_have_one_plan(spark):
    import __spark_entry__ as contract

    def operators(key):
        text = contract.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        return [sum(line.lstrip(" :+-").startswith(x) for line in text.splitlines()) for x in ("Aggregate", "Join", "Window", "Generate")]

    assert operators("gems_build_sql") == operators("gems_build")


def test_all_cutoffs_in_one_pass_equal_each_alone(frame):
    rng = random.Random(9)
    cut = plan.Cutoffs(worst_peak=40, per_artist=2, roster_size=5)
    songs = materialize(frame([(f"{'aA'[k % 2]}{k % 9}", f"s{k}", rng.randrange(1, 60), 1) for k in range(120)], "primary_artist string, title string, best_peak int, total_weeks int"))
    rows = [(f"A{k % 11}", f"t{k}", k, 2 * k, float(k % 7), rng.choice(tx.TIER_LABELS[:2])) for k in range(200)]
    found = materialize(frame(rows, "artist string, track string, listeners long, playcount long, plays_per_listener double, tier string"))
    cutoffs = (1, 5, 7, 8, 99)
    got = plan.rosters_compared(found, songs, cut, cutoffs)
    expected = []
    for n in cutoffs:
        from linkrank.operators.aggregates import known_artists

        expected += [(*r, n) for r in map(tuple, plan.top_gems(found, known_artists(songs, n), cut).collect())]
    assert sorted(map(tuple, got.collect())) == sorted(expected)
