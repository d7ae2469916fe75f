"""The stages of the analysis and the quality reports on hand-written rows."""

import datetime

import pytest
from pyspark.sql import functions as F

from linkrank.functions.text import has_nondigit
from linkrank.operators import aggregates as ag
from linkrank.operators import profile as pf
from linkrank.operators import review as rv
from linkrank.plans import gems as plan
from linkrank.sources.standins import Inputs

CHART = "chart_week string, current_week int, title string, performer string, last_week string, peak_pos string, wks_on_chart int"
TRACKS = "artist string, track string, playcount bigint, listeners bigint"
CUT = plan.Cutoffs(min_songs=2)


@pytest.fixture
def chart(frame):
    return frame(
        [
            ("1979-01-06", 3, "One", "Tyler, The Creator", "NA", "3", 1),
            ("1979-01-13", 2, "One", "Tyler, The Creator", "3", "2", 2),
            ("1981-01-06", 9, "Two", "Tyler, The Creator Featuring Q", "NA", "9", 1),
            ("1985-01-06", 8, "Three", "Tyler, the Creator", "0", "8", 1),
            ("1985-01-13", 30, "Four", "Tyler, the Creator", "NA", "30", 1),
            ("1990-01-06", 50, "Low", "Deep Cut", "NA", "50", 1),
            ("1990-01-13", 60, "Lower", "Deep Cut", "NA", "60", 1),
            ("1990-01-13", 61, "Once", "Visitor", "NA", "61", 1),
        ],
        CHART,
    )


@pytest.fixture
def tracks(frame):
    return frame(
        [
            ("Tyler, The Creator", "One - 2004 Remaster", 90_000, 9_000),
            ("Tyler, The Creator", "Gem", 20_000, 2_000),
            ("Tyler, The Creator", "Gem (feat. Z)", 40_000, 3_000),
            ("Tyler, The Creator", "Gem B", 16_000, 2_000),
            ("Tyler, The Creator", "Gem C", 14_000, 2_000),
            ("Tyler, The Creator", "Gem D", 13_000, 2_000),
            ("Tyler, The Creator", "Gem live", 50_000, 2_000),
            ("Tyler, The Creator", "Few", 9_990, 999),
            ("Tyler, The Creator", "Nearly", 5_960, 1_000),
            ("Tyler, The Creator", "Zero", 5, 0),
            ("Tyler, The Creator", "Big", 9_000_000, 1_000_000),
            ("Deep Cut", "Deep", 70_000, 1_000),
            ("Visitor", "Hidden", 70_000, 1_000),
        ],
        TRACKS,
    )


def test_song_grain_and_roster(chart):
    songs = ag.song_grain(chart)
    one = songs.where("title = 'One'").first()
    assert (one["performer"], one["best_peak"], one["total_weeks"]) == ("Tyler, The Creator", 2, 2)
    roster = {r["primary_artist"]: (r["songs_charted"], r["career_peak"]) for r in ag.known_artists(songs, 2).collect()}
    assert roster == {"Tyler, The Creator": (2, 2), "Tyler, the Creator": (2, 8), "Deep Cut": (2, 50)}
    assert [tuple(r) for r in ag.case_twins(ag.known_artists(songs, 2)).collect()] == [("tyler, the creator", 2)]


def test_floors_test_the_raw_ratio(tracks):
    kept = {r["track"]: r["plays_per_listener"] for r in plan.devoted(tracks, CUT).collect()}
    assert "Few" not in kept and "Nearly" not in kept and "Zero" not in kept
    assert kept["Gem (feat. Z)"] == 13.3


def test_gems(chart, tracks):
    songs = ag.song_grain(chart)
    found = {r["track"]: r for r in plan.gems(tracks, songs, CUT).collect()}
    assert set(found) == {"Gem", "Gem B", "Gem C", "Gem D", "Big", "Deep", "Hidden"}
    assert (found["Gem"]["listeners"], found["Gem"]["playcount"], found["Gem"]["plays_per_listener"]) == (3_000, 40_000, 13.3)
    assert found["Big"]["tier"] == "buried anthem"


def test_roster_lists_each_gem_once_and_three_per_artist(chart, tracks):
    songs = ag.song_grain(chart)
    top = plan.top_gems(plan.gems(tracks, songs, CUT), ag.known_artists(songs, 2), CUT)
    assert [r["track"] for r in top.collect()] == ["Gem", "Gem B", "Gem C"]


def test_page(chart, tracks, frame):
    songs = ag.song_grain(chart)
    top = plan.top_gems(plan.gems(tracks, songs, CUT), ag.known_artists(songs, 2), CUT)
    details = frame(
        [
            ("Tyler, The Creator", "Gem", "LP", "rap|pop", 61_000),
            ("Tyler, The Creator", "Gem", "LP", "rap|pop", 61_000),
            ("Tyler, The Creator", "Gem B", "", "", 0),
        ],
        "artist string, track string, album string, tags string, duration_ms bigint",
    )
    page = plan.gem_page(top, details, plan.first_last_seen(chart, CUT))
    found = {r["track"]: (r["genre"], r["duration"], r["debut_decade"], r["gem_score"]) for r in page.collect()}
    assert found == {
        "Gem": ("rap", "1:01", "1970s", 100.0),
        "Gem B": ("", "", "1970s", 35.0),
        "Gem C": ("", "", "1970s", 0.0),
    }


def test_known_credits_only_map_gives_later_debuts(chart, frame):
    mapping = frame([("Tyler, the Creator", "Tyler, the Creator")], "performer string, primary_artist string")
    found = plan.first_last_seen(chart, CUT, mapping).collect()
    assert [tuple(r) for r in found] == [("Tyler, the Creator", "1985-01-06", "1985-01-13")]


def test_ledger_shrinks_and_tiers_sum_up(chart, tracks):
    counts = {r["stage"]: r["row_count"] for r in plan.shrink_ledger(chart, tracks, CUT).collect()}
    assert counts["chart_entries"] == 8 and counts["tracks"] == 13
    assert counts["devoted_tracks"] >= counts["unmatched_collapsed"] >= counts["gems"] >= counts["top_gems"] == 3
    found = plan.gems(tracks, ag.song_grain(chart), CUT)
    assert found.groupBy("tier").count().agg(F.sum("count")).first()[0] == counts["gems"]


def test_uplift_never_falls(chart, tracks):
    rates = {r["key_level"]: r["matched"] for r in rv.key_rule_uplift(tracks, ag.song_grain(chart)).collect()}
    assert rates == {0: 0, 1: 0, 2: 1, 3: 1}


def test_punctuation_gems(frame, spark):
    songs = frame([("B", "Paint It, Black")], "primary_artist string, title string")
    tracks = frame([("B", "Paint It Black"), ("B", "Other")], "artist string, track string")
    assert [r["track"] for r in rv.punctuation_false_gems(tracks, songs).collect()] == ["Paint It Black"]


def test_bands_sum_to_the_total(tracks):
    names = ["a", "b", "c"]
    row = ag.bands(tracks, "listeners", [1_000, 10_000], names).first()
    assert sum(row) == tracks.count()
    cuts = ag.survivors(tracks, "listeners", {"x": 1_000, "y": 1_000_000}).first()
    assert (cuts["x"], cuts["y"]) == (11, 1)


def test_group_match_rate_rounds_half_to_even(frame):
    df = frame([("a", 1)] + [("a", 0)] * 7, "g string, matched int")
    found = {r["g"]: (r["matched"], r["total"], r["pct"]) for r in ag.group_match_rate(df, "g").collect()}
    assert found == {"a": (1, 8, 12.0), "all": (1, 8, 12.0)}


def test_roundtrip(frame):
    df = frame([("07",), ("7",), ("NA",), ("NA",), (None,)], "v string")
    found = {r["v"]: (r["problem"], r["rows_with_value"]) for r in pf.roundtrip_cast_check(df, "v").collect()}
    assert found == {"07": ("rewritten", 1), "NA": ("not a number", 2)}


def test_profile(frame):
    df = frame([("a", 1), ("a", 2), ("", None), (None, 2)], "s string, n int")
    expected = {"s": (4, 1, 1, 2, "", "a", 2), "n": (4, 1, 0, 2, "1", "2", 0)}
    for report in (pf.profile_table(df), pf.profile_table_approx(df)):
        assert {r["column_name"]: tuple(r)[1:] for r in report.collect()} == expected


def test_markers_blanks_and_oddities(frame):
    df = frame([("NA", "1"), ("0", ""), ("5", "x")], "last_week string, peak_pos string")
    assert pf.count_blank(df, ["last_week", "peak_pos"]).first()[0] == 1
    odd = pf.oddity_counts(df, {"na": F.col("last_week") == "NA", "weird": has_nondigit(F.col("peak_pos"))}).first()
    assert tuple(odd) == (3, 1, 1)
    found = {(r["column_name"], r["marker"]): r["marked_rows"] for r in pf.missing_markers(df, ["last_week", "peak_pos"]).collect()}
    assert found == {("last_week", "NA"): 1, ("last_week", "0"): 1, ("peak_pos", ""): 1}


def test_completeness(frame):
    df = frame([("w1",), ("w1",), ("w2",)], "w string")
    assert tuple(ag.completeness(df, "w", 2).first()) == (3, 4, 1)


def test_six_dimensions_report_each_defect(frame):
    df = frame([("w1", 1, "x"), ("w1", 1, ""), ("w2", 500, "y")], "w string, p int, t string")
    report = pf.six_dimensions(
        df,
        expected_rows=4,
        blank=F.col("t") == "",
        invalid=F.col("p") > 100,
        inconsistent=F.lit(False),
        identity=["w", "p"],
        inaccurate=F.col("t") == "y",
        date_col="w",
        stale_before="w3",
    )
    assert {r["dimension"]: r["failures"] for r in report.collect()} == {
        "completeness": 2,
        "validity": 1,
        "consistency": 0,
        "uniqueness": 1,
        "accuracy": 1,
        "timeliness": 1,
    }


def test_whole_analysis_from_files(spark, folder, chart, tracks, frame):
    from linkrank.plans.analysis import run
    from linkrank.sources import files

    chart_csv = files.write_dated_csv(chart, f"{folder}/chart", "2026-07-13")
    files.write_dated_csv(tracks.limit(1), f"{folder}/tracks", "2026-06-14")
    files.write_dated_csv(tracks, f"{folder}/tracks", "2026-07-14")
    details = frame(
        [("Tyler, The Creator", "Gem", "LP", "rap|pop", 61_000)],
        "artist string, track string, album string, tags string, duration_ms bigint",
    )
    files.write_dated_csv(details, f"{folder}/details", "2026-07-15")
    for _ in range(2):
        tables = run(
            spark, chart_csv, f"{folder}/tracks", f"{folder}/details", f"{folder}/out", CUT, "2026-07-14"
        )
    counts = {name: df.count() for name, df in tables.items()}
    assert counts == {
        "rejected_chart_rows": 0,
        "rejected_track_rows": 0,
        "rejected_detail_rows": 0,
        "chart_entries": 8,
        "artist_songs": 7,
        "known_artists": 3,
        "song_keys": 7,
        "devoted_tracks": 10,
        "gems": 7,
        "top_gems": 3,
        "gem_page": 3,
    }
    assert tables["gem_page"].columns == [
        "artist", "track", "listeners", "playcount", "plays_per_listener", "album", "genre", "tags",
        "duration", "debut_decade", "gem_score",
    ]


def test_song_grain_reduces_weeks_by_credit_first(frame):
    """A week without a peak comes first, as it does among single weeks; only numbers are added up."""
    rows = [
        ("A With B", "t", "3", 1), ("A With C", "t", "2", 4), ("A With C", "t", "NA", 2), ("A With B", "t", "1", 7),
        ("Z", "u", "4", 1), ("Z With Q", "u", "4", 3), ("Z With Q", "u", "9", 2), (None, "u", "NA", None), (None, "u", "5", None),
    ]
    got = ag.song_grain(frame(rows, "performer string, title string, peak_pos string, wks_on_chart int"))
    want = [("A", "t", "A With C", 1, 7), ("Z", "u", "Z", 4, 3), (None, "u", None, 5, None)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def test_both_stats_are_the_two_snapshots(spark, folder):
    """One pass gives what two give, also for NULL dates, buyers and units and for lines without an order."""
    lines = [
        (k, p, s, q, None if d is None else datetime.datetime(d, 6, 1))
        for k in (1, 2, 3, 4, None, 9) for p in (1, 2, 3, None) for s in ("F", "O", None)
        for q, d in ((2.0, 1997), (None, 1998), (3.0, 1999), (1.0, None)) if p != 3 or d != 1997
    ]
    spark.createDataFrame(lines, "l_orderkey long, l_partkey long, l_linestatus string, l_quantity double, l_shipdate timestamp_ntz").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(1, 10), (2, 10), (3, None), (4, 11), (4, 11)], "o_orderkey long, o_custkey long").write.parquet(f"{folder}/orders.parquet")
    parts = [(1, "b", "x", "SMALL", 5), (2, "b", "y", "PROMO", 40), (2, "b", "y", "PROMO", 40), (3, "c", "z", "LARGE", 18)]
    spark.createDataFrame(parts, "p_partkey long, p_brand string, p_name string, p_type string, p_size int").write.parquet(f"{folder}/part.parquet")
    t = Inputs(spark, folder)
    for one, two in zip(t.both_stats, (t.early_stats, t.stats), strict=True):
        assert one.columns == two.columns and one.dtypes == two.dtypes
        assert one.count() > 0 and sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
