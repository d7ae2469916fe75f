"""File contracts, rebuilds and nested replies on hand-written rows."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from linkrank.functions import nested as ns
from linkrank.sources import files
from linkrank.sources import replies as rp

HEADER = "chart_week,current_week,title,performer,last_week,peak_pos,wks_on_chart\n"


def write(folder, text, name="x.csv"):
    path = Path(folder) / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_contract_splits_good_and_bad_rows(spark, folder):
    path = write(
        folder,
        HEADER
        + '1958-08-04,1,"Hey, You, There",Ricky,NA,1,1\n'
        + '1958-08-04,2,"Say ""Hi""",Perez,0,2,8\n'
        + "1958-08-04,3,,Nat,,3,2\n"
        + "1958-08-04,4,too,many,fields,4,5,6,7\n"
        + "1958-08-04,5,too few\n"
        + "1958-08-04,six,not a number,X,NA,1,1\n",
    )
    good, bad = files.read_csv_contract(spark, path, files.CHART_ENTRIES)
    found = {r["current_week"]: (r["title"], r["last_week"]) for r in good.collect()}
    assert found == {1: ("Hey, You, There", "NA"), 2: ('Say "Hi"', "0"), 3: ("", "")}
    assert bad.count() == 3
    assert good.select("title").count() == 3


def test_contract_rejects_another_header(spark, folder):
    path = write(folder, "artist,song,playcount,listeners\na,b,1,2\n")
    with pytest.raises(Exception, match="header|CSV"):
        files.read_csv_contract(spark, path, files.TRACKS).good.collect()


def test_snapshots_replace_and_prune(spark, folder, frame):
    ddl = "artist string, track string, playcount bigint, listeners bigint"
    files.write_dated_csv(frame([("a", "x", 1, 1)], ddl), folder, "2026-06-01")
    files.write_dated_csv(frame([("a", 'say "y"', 2, 2), ("b", "", 3, 3)], ddl), folder, "2026-07-01")
    files.write_dated_csv(frame([("a", ' say "y", ok', 5, 5)], ddl), folder, "2026-07-01")
    every = files.read_snapshots(spark, folder, files.TRACKS, every=True).good
    assert sorted((r["track"], str(r["snapshot_date"])) for r in every.collect()) == [
        (' say "y", ok', "2026-07-01"),
        ("x", "2026-06-01"),
    ]
    one = files.read_snapshots(spark, folder, files.TRACKS, "2026-06-01").good
    assert [r["track"] for r in one.collect()] == ["x"]
    assert "PartitionFilters: [isnotnull(snapshot_date" in one._jdf.queryExecution().executedPlan().toString()
    newest = files.read_snapshots(spark, folder, files.TRACKS)
    assert [r["track"] for r in newest.good.collect()] == [' say "y", ok'] and newest.bad.count() == 0


def test_snapshots_hand_over_what_they_reject(spark, folder):
    header = "artist,track,playcount,listeners\n"
    (Path(folder) / "snapshot_date=2026-07-01").mkdir()
    write(folder, header + 'a,"x\ny",1,2\nb,z,many,3\n', "snapshot_date=2026-07-01/x.csv")
    good, bad = files.read_snapshots(spark, folder, files.TRACKS)
    assert [(r["track"], r["playcount"]) for r in good.collect()] == [("x\ny", 1)]
    assert [r[files.CORRUPT].strip() for r in bad.collect()] == ["b,z,many,3"]


def test_texts_with_line_breaks_come_back(spark, folder, frame):
    rows = [("a\nb", 'x\r\n"y",\n', 1, 2), ("\n", " z ", 3, 4), ("c", "", 5, 6)]
    df = frame(rows, "artist string, track string, playcount bigint, listeners bigint")
    path = files.write_dated_csv(df, folder, "2026-07-14")
    good, bad = files.read_csv_contract(spark, path, files.TRACKS)
    assert sorted(map(tuple, good.collect())) == sorted(rows) and bad.count() == 0


def test_freeze_overwrites(spark, folder):
    path = f"{folder}/t"
    files.freeze(spark.range(5), path)
    assert files.freeze(spark.range(3), path).count() == 3


def test_delete_keeps_rows_whose_test_is_null(frame):
    df = frame([("Song remix",), ("Song",), (None,)], "track string")
    kept = files.delete_where(df, F.contains("track", F.lit("remix")))
    assert sorted(str(r["track"]) for r in kept.collect()) == ["None", "Song"]


def test_json_and_playlist(spark, folder, frame):
    df = frame([("a", "x, y", None)], "artist string, track string, album string")
    files.write_json(df, f"{folder}/j")
    line = "".join(p.read_text() for p in Path(f"{folder}/j").glob("*.json"))
    assert json.loads(line) == {"artist": "a", "track": "x, y", "album": None}
    files.write_playlist_csv(df, f"{folder}/p")
    lines = {x for p in Path(f"{folder}/p").glob("*.csv") for x in p.read_text().splitlines()}
    assert lines == {"artist,track", 'a,"x, y"'}


def test_file_sizes(spark, folder):
    write(folder, "x" * 10, "a.csv")
    write(folder, "x" * 5_000, "b.csv")
    assert [tuple(r) for r in files.suspicious_files(spark, folder, 1_000, 10_000).collect()] == [("a.csv", 10)]


def test_roster_scan(frame):
    df = frame([("b",), ("a",), ("c",)], "name string")
    assert [r["name"] for r in files.roster_scan(df, "name").collect()] == ["a", "b", "c"]
    assert [r["name"] for r in files.roster_scan(df, "name", 2).collect()] == ["a", "b"]


def test_toptracks(frame):
    bodies = {
        "full": '{"toptracks":{"track":[{"name":"x","playcount":"5","listeners":"2"},{"name":"y"}]}}',
        "empty": '{"toptracks":{"track":[]}}',
        "bare": "{}",
        "broken": '{"toptracks":{"tra',
        "none": None,
        "blank": "",
        "page": "<html>",
        "number": "12",
        "other shape": '{"toptracks":{"track":"x"}}',
        "extra": '{"toptracks":{"track":[{"name":"z","playcount":7,"more":[1]}],"attr":{"page":1}}}',
    }
    df = frame(list(bodies.items()), "artist string, body string")
    found = sorted(tuple(r) for r in rp.parse_toptracks(df).collect())
    assert found == [("extra", "z", "7", ""), ("full", "x", "5", "2"), ("full", "y", "", "")]
    failed = sorted(r["artist"] for r in rp.failures(df).collect())
    assert failed == ["blank", "broken", "none", "number", "other shape", "page"]


def test_trackinfo_and_fallback(frame):
    tags = [{"name": n} for n in ("rock", "pop", "folk", "jazz")]
    bodies = [
        ("a", "full", json.dumps({"track": {"album": {"title": "LP"}, "toptags": {"tag": tags}, "duration": "61000"}})),
        ("a", "untagged", json.dumps({"track": {"toptags": {"tag": []}}})),
        ("z", "no owner", json.dumps({"track": {}})),
        ("a", "failed", None),
        ("a", "broken", "<html>"),
    ]
    items = rp.parse_trackinfo(frame(bodies, "artist string, track string, body string"))
    owners = rp.parse_toptags(
        frame([("a", '{"toptags":{"tag":[{"name":"soul"}]}}'), ("a", None)], "artist string, body string"), "artist"
    )
    found = {
        r["track"]: (r["album"], r["tags"], r["duration_ms"], r["failed"])
        for r in rp.tag_fallback(items, owners, "artist").collect()
    }
    assert found == {
        "full": ("LP", "rock|pop|folk", "61000", False),
        "untagged": ("", "soul", "0", False),
        "no owner": ("", "", "0", False),
        "failed": ("", "", "0", True),
        "broken": ("", "", "0", True),
    }


def rec(score=None, first=None, dates=None):
    out = {}
    if score is not None:
        out["score"] = score
    if first is not None:
        out["first-release-date"] = first
    if dates is not None:
        out["releases"] = [{"date": d} if d is not None else {} for d in dates]
    return out


def test_release_years(frame):
    cases = {
        "first date": ([rec(95, "1971-05", ["1980"])], 1971, 95, "1970s", 1),
        "release date": ([rec(90, "", ["1999-01-01", "unknown", None])], 1999, 90, "1990s", 1),
        "low score": ([rec(89, "1960", [])], None, 89, "", 0),
        "mixed": ([rec(100, "2001"), rec(50, "1950"), rec(92, None, ["1998"])], 1998, 100, "1990s", 1),
        "no score": ([rec(None, "1950", ["1950"])], None, 0, "", 0),
        "score as text": ([rec("91", "1950")], 1950, 91, "1950s", 1),
        "empty": ([], None, 0, "", 0),
    }
    rows = [(k, json.dumps({"recordings": v[0]})) for k, v in cases.items()]
    rows += [("missing", "{}"), ("broken", "{"), ("null", None)]
    found = {
        r["k"]: (r["release_year"], r["mb_score"], r["release_decade"], r["matched"])
        for r in rp.release_years(frame(rows, "k string, body string")).collect()
    }
    expected = {k: (v[1], v[2], v[3], v[4]) for k, v in cases.items()}
    expected |= {k: (None, 0, "", 0) for k in ("missing", "broken", "null")}
    assert found == expected


def test_blend(frame):
    df = frame([("1970s", "1980s"), ("", "1980s"), (None, "1980s")], "r string, d string")
    blended = df.select(ns.blend_decade(F.col("r"), F.col("d")).alias("b"))
    assert [r["b"] for r in blended.collect()] == ["1970s", "1980s", "1980s"]
