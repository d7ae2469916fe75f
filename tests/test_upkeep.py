"""Snapshots that land, lists kept up to date, tables rebuilt beside the old ones, replies of unknown shape."""

import os

import pytest
from pyspark.sql import functions as F

from linkrank.operators import joins as jn
from linkrank.operators import review as rv
from linkrank.plans import gems as plan
from linkrank.plans import upkeep
from linkrank.runtime import materialize
from linkrank.sources import files
from linkrank.sources import replies as rp
from linkrank.streaming.snapshots import follow_snapshots, snapshot_table

TRACKS = "artist string, track string, playcount long, listeners long"
CUT = plan.Cutoffs(min_listeners=10, min_ratio=2.0, low_tier=50, high_tier=90)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.fixture
def landing(spark, frame, folder):
    root, table, state = f"{folder}/landing", f"{folder}/table", f"{folder}/state"

    def land(date, rows):
        files.write_dated_csv(frame(rows, TRACKS), root, date)
        return follow_snapshots(spark, root, files.TRACKS, table, state)

    return land, lambda: snapshot_table(spark, table, files.TRACKS), root, state


def test_each_run_loads_new_folders_only(spark, landing):
    land, table, root, state = landing
    assert land("2026-01-01", [("a", "x", 1, 2), ("b", "", 3, 4)]) == ["2026-01-01"]
    assert land("2026-01-08", [("a", "x", 5, 6)]) == ["2026-01-08"]
    assert follow_snapshots(spark, root, files.TRACKS, "/nowhere", state) == []
    found = rows_of(table().select("artist", "track", "playcount", "loaded_in_run", F.col("snapshot_date").cast("string")))
    assert found == [("a", "x", 1, 0, "2026-01-01"), ("a", "x", 5, 1, "2026-01-08"), ("b", "", 3, 0, "2026-01-01")]


def test_a_second_delivery_replaces_its_date(landing):
    land, table, root, _ = landing
    land("2026-01-01", [("a", "x", 1, 2), ("b", "y", 3, 4)])
    land("2026-01-08", [("a", "x", 5, 6)])
    assert land("2026-01-01", [("a", "x", 9, 9)]) == ["2026-01-01"]
    assert rows_of(table().select("playcount", "loaded_in_run")) == [(5, 1), (9, 2)]


def test_rows_that_break_the_contract_are_left_out(spark, landing, folder):
    land, table, root, state = landing
    land("2026-01-01", [("a", "x", 1, 2)])
    os.makedirs(f"{root}/snapshot_date=2026-02-01")
    with open(f"{root}/snapshot_date=2026-02-01/part.csv", "w") as out:
        out.write("artist,track,playcount,listeners\na,x,many,2\na,y,7,2\n")
    assert follow_snapshots(spark, root, files.TRACKS, f"{folder}/table", state) == ["2026-02-01"]
    assert rows_of(table().select("track", "playcount")) == [("x", 1), ("y", 7)]


def archive(frame):
    return materialize(frame([("A", "known", 1, 3), ("A", "late", 2, 2)], "primary_artist string, title string, best_peak int, total_weeks int"))


def test_only_changed_keys_are_worked_out_again(frame):
    same = [("A", f"song {k}", 100 + k, 20 + k) for k in range(20)] + [("a", "Song 3", 90, 30), ("A", "known", 900, 20), (None, "x", 99, 20)]
    before = same + [(None, "y", 99, 20), ("B", "gone", 80, 20), ("B", "moves", 80, 20), ("C", "twice", 50, 20), ("C", "twice", 50, 20)]
    after = same + [(None, "y", 98, 20), ("B", "moves", 200, 95), ("C", "twice", 50, 20), ("D", "new", 70, 20), ("D", "new - live", 70, 20), ("E", "quiet", 9, 9)]
    songs = archive(frame)
    old, new = materialize(frame(before, TRACKS)), materialize(frame(after, TRACKS))
    stored = materialize(upkeep.gems_by_key(old, songs, CUT))
    got, touched = upkeep.refreshed_gems(stored, old, new, songs, songs, CUT)
    assert rows_of(got) == rows_of(plan.gems(new, songs, CUT).select(*got.columns))
    assert rows_of(touched) == [("b", "gone"), ("b", "moves"), ("c", "twice"), ("d", "new"), (None, "y")]
    changes = upkeep.list_changes(stored, got, rv.KEYS, ["listeners", "playcount", "tier"]).where("change <> 'kept'")
    assert rows_of(changes.select("title_key", "change", "listeners")) == [
        ("gone", "dropped", 20),
        ("moves", "changed", 95),
        ("new", "added", 20),
        ("y", "changed", 20),
    ]


def test_a_new_archive_entry_takes_its_key_off_the_list(frame):
    tracks = materialize(frame([("A", "fresh", 100, 20), ("A", "stays", 100, 20)], TRACKS))
    songs = archive(frame)
    more = materialize(songs.unionByName(frame([("A", "Fresh!", 9, 1)], songs.schema)))
    stored = materialize(upkeep.gems_by_key(tracks, songs, CUT))
    got, touched = upkeep.refreshed_gems(stored, tracks, tracks, songs, more, CUT)
    assert rows_of(touched) == [("a", "fresh")] and rows_of(got.select("track")) == [("stays",)]
    assert rows_of(got) == rows_of(plan.gems(tracks, more, CUT).select(*got.columns))


def test_changed_keys_of_empty_tables(frame):
    none, one = frame([], "k long, v string"), frame([(1, None), (1, None)], "k long, v string")
    assert rows_of(upkeep.changed_keys(none, none, ["k"])) == []
    assert rows_of(upkeep.changed_keys(none, one, ["k"])) == rows_of(upkeep.changed_keys(one, none, ["k"])) == [(1,)]
    assert rows_of(upkeep.changed_keys(one, one.distinct(), ["k"])) == [(1,)]


def test_a_broken_rebuild_leaves_the_old_table(spark, frame, folder):
    first = frame([(1, "a"), (2, None), (3, "b live")], "id long, track string")
    table = files.VersionedTable(spark, f"{folder}/versioned", first.schema)
    assert rows_of(table.current()) == [] and rows_of(table.history()) == []
    table.replace(first)
    with pytest.raises(Exception, match="broken"):
        table.replace(first.withColumn("id", F.raise_error(F.lit("broken")).cast("long")))
    assert rows_of(table.current()) == rows_of(first)
    rest = table.delete(F.col("track").contains("live"))
    assert rows_of(rest) == [(1, "a"), (2, None)]
    assert rows_of(table.history().select("version", "before", "after")) == [(1, 0, 3), (2, 3, 2)]
    assert rows_of(table.delete(F.lit(True))) == []


def test_given_files_are_listed_without_reading_them(spark):
    root = "/root/testdata/sf0.001/orders.parquet"
    listed = files.input_files(spark, root)
    plan_text = listed._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in plan_text
    assert rows_of(listed) == [("orders.parquet", os.path.getsize(root))]
    assert rows_of(files.file_verdicts(listed, 1, 10).select("verdict")) == [("too large",)]


def test_duplicate_keys_and_merged_titles_are_listed(frame):
    left, right = frame([(1,), (1,), (2,), (3,)], "k long"), frame([(1,), (1,), (1,), (2,), (None,), (None,)], "k long")
    assert rows_of(jn.fanning_keys(left, right, ["k"])) == [(1, 2, 3, 4)]
    songs = frame([("A", "The Sun"), ("a", "Sun!"), ("A", "Sun"), ("A", "Moon"), ("B", "Sun")], "primary_artist string, title string")
    got = rv.merged_titles(songs)
    assert set(map(tuple, got.collect())) == {("a", "sun", 3, x) for x in ("Sun", "Sun!", "The Sun")}


def test_shapes_of_unknown_replies(frame):
    bodies = ['{"a": 1}', '{"a": "x"}', None, "", "<html>", '{"a": 1}', "[1, null]", "null"]
    df = frame([(x,) for x in bodies], "body string")
    census = dict((r["shape"], r["replies"]) for r in rp.shape_census({"s": df}).collect())
    assert census["not JSON"] == 2 and census["no reply"] == 1 and census["OBJECT<a: BIGINT>"] == 2 and sum(census.values()) == len(bodies)
    merged = rp.merged_shapes({"s": df}).first()
    assert (merged["readable"], merged["replies"]) == (5, 8)
    assert rp.shape_census({"s": df.where("false")}).collect() == []


def test_variant_path_gives_the_rows_of_the_schema_path(frame):
    track = '{"toptracks": {"track": [%s]}}'
    bodies = [
        track % '{"name": "a", "playcount": "3"}, {"name": null, "listeners": "4"}, {}',
        track % "",
        track % '{"name": "b", "playcount": "1", "listeners": "2", "more": [1]}',
        '{"toptracks": {}}',
        None,
        "no",
    ]
    df = frame([(f"artist {k}", x) for k, x in enumerate(bodies)], "artist string, body string")
    assert rows_of(rp.parse_toptracks_variant(df)) == rows_of(rp.parse_toptracks(df))
