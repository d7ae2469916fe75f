"""The whole analysis from files to stored tables.

    spark-submit linkrank/plans/analysis.py CHART_CSV TRACKS_DIR DETAILS_DIR OUT_DIR

Each step overwrites its table, so a run can be repeated from the top.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession

from linkrank.operators.aggregates import known_artists, song_grain
from linkrank.operators.review import with_song_keys
from linkrank.plans import gems as plan
from linkrank.runtime import write_table
from linkrank.sources import files


def run(
    spark: SparkSession,
    chart_csv: str,
    tracks_dir: str,
    details_dir: str,
    out_dir: str,
    cut: plan.Cutoffs = plan.Cutoffs(),
    snapshot: str | None = None,
) -> dict[str, DataFrame]:
    """Every derived table by name, stored under ``out_dir``."""
    tables: dict[str, DataFrame] = {}

    def store(name: str, df: DataFrame) -> DataFrame:
        tables[name] = write_table(df, f"{out_dir.rstrip('/')}/{name}")
        return tables[name]

    chart, rejected = files.read_csv_contract(spark, chart_csv, files.CHART_ENTRIES)
    store("rejected_chart_rows", rejected)
    chart = store("chart_entries", chart)
    songs = store("artist_songs", song_grain(chart, cut.rungs))
    roster = store("known_artists", known_artists(songs, cut.min_songs))
    keys = store("song_keys", with_song_keys(songs, cut.key_level).drop("performer"))
    tracks, rejected = files.read_snapshots(spark, tracks_dir, files.TRACKS, snapshot)
    store("rejected_track_rows", rejected)
    tracks = tracks.drop(files.SNAPSHOT)
    devoted = store("devoted_tracks", plan.devoted(tracks, cut))
    found = plan.without_variants(plan.absent_from_archive(plan.collapse(devoted, cut), keys))
    found = store("gems", found.drop(*plan.KEYS))
    top = store("top_gems", plan.top_gems(found, roster, cut))
    details, rejected = files.read_snapshots(spark, details_dir, files.DETAILS)
    store("rejected_detail_rows", rejected)
    details = details.drop(files.SNAPSHOT)
    eras = plan.first_last_seen(chart, cut)
    store("gem_page", plan.gem_page(top, details, eras))
    return tables


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    for name in ("chart_csv", "tracks_dir", "details_dir", "out_dir"):
        parser.add_argument(name)
    parser.add_argument("--snapshot", help="date of the track snapshot; the newest when left out")
    args = parser.parse_args()
    spark = SparkSession.builder.appName("linkrank").getOrCreate()
    run(spark, args.chart_csv, args.tracks_dir, args.details_dir, args.out_dir, snapshot=args.snapshot)
    spark.stop()


if __name__ == "__main__":
    main()
