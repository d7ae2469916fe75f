"""The analysis end to end: archive + track statistics -> roster -> page.

Each stage is a lazy DataFrame. Aggregation by the match key comes before the
anti-join, and the best-N cut before the roster join, so that every join in the
chain meets one row per key and needs no special path for hot keys.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.functions.keys import CREDIT_RUNGS, primary_entity
from linkrank.functions.nested import blend_decade, first_tag
from linkrank.functions.text import decade_of_date, duration_text, has_any_marker, ratio, tier
from linkrank.operators.aggregates import group_match_rate, known_artists, song_grain
from linkrank.operators.joins import lookup_join, one_row_per_key
from linkrank.operators.profile import ledger
from linkrank.operators.rank import (
    composite_score,
    top_k,
    top_n_per_group,
)
from linkrank.operators.review import KEYS, with_song_keys, with_track_keys
from linkrank.runtime import materialize
from linkrank.sources.files import delete_where
from linkrank.sources.replies import release_years

# Weights of the composite score.
SCORE_WEIGHTS = {"plays_per_listener": 0.7, "listeners": 0.3}


@dataclass(frozen=True)
class Cutoffs:
    """Every number the analysis depends on; the defaults are fixed values."""

    min_listeners: int = 1_000
    min_ratio: float = 6.0
    min_songs: int = 5
    low_tier: int = 200_000
    high_tier: int = 1_000_000
    worst_peak: int = 40
    per_artist: int = 3
    roster_size: int = 500
    key_level: int = 3
    rungs: tuple[str, ...] = CREDIT_RUNGS


def devoted(tracks: DataFrame, cut: Cutoffs) -> DataFrame:
    """Tracks over both floors, with keys. The floor tests the raw ratio, the ranking
    column is the rounded one."""
    plays = ratio(F.col("playcount"), F.col("listeners"))
    kept = tracks.where((F.col("listeners") >= cut.min_listeners) & (plays >= cut.min_ratio))
    return with_track_keys(kept.withColumn("plays_per_listener", F.round(plays, 1)), cut.key_level)


def collapse(devoted_tracks: DataFrame, cut: Cutoffs) -> DataFrame:
    """One row per match key: first spelling, best figures, tier."""
    return one_row_per_key(
        devoted_tracks,
        KEYS,
        F.min("artist").alias("artist"),
        F.min("track").alias("track"),
        F.max("listeners").alias("listeners"),
        F.max("playcount").alias("playcount"),
        F.max("plays_per_listener").alias("plays_per_listener"),
    ).withColumn("tier", tier(F.col("listeners"), cut.low_tier, cut.high_tier))


def absent_from_archive(collapsed: DataFrame, song_keys: DataFrame) -> DataFrame:
    """Keys never seen in the archive. Both sides meet with one row per key."""
    return collapsed.join(one_row_per_key(song_keys, KEYS), KEYS, "left_anti")


def gems(tracks: DataFrame, songs: DataFrame, cut: Cutoffs, drop_variants: bool = True) -> DataFrame:
    song_keys = with_song_keys(songs, cut.key_level)
    found = absent_from_archive(collapse(devoted(tracks, cut), cut), song_keys)
    return without_variants(found) if drop_variants else found


def without_variants(found: DataFrame) -> DataFrame:
    return delete_where(found, has_any_marker(F.col("track")))


def devotion_order() -> list[Column]:
    """Most devoted first, then widest; names break ties."""
    return [F.desc("plays_per_listener"), F.desc("listeners"), F.asc("artist"), F.asc("track")]


def best_of_each(found: DataFrame, cut: Cutoffs) -> DataFrame:
    """The most devoted few finds of each artist, with the lower-cased name."""
    return top_n_per_group(
        found.where(F.col("tier") == "hidden gem").withColumn("artist_lower", F.lower("artist")),
        ["artist_lower"],
        devotion_order(),
        cut.per_artist,
    )


def top_gems(found: DataFrame, roster: DataFrame, cut: Cutoffs) -> DataFrame:
    """Best few of each well-known artist, at most ``roster_size`` in all.

    The join keeps or drops whole artists, so cutting to the best few first gives
    the same rows and leaves a handful per artist for the join.
    """
    known = one_row_per_key(
        roster.where(F.col("career_peak") <= cut.worst_peak).select(
            F.lower("primary_artist").alias("artist_lower")
        ),
        ["artist_lower"],
    )
    kept = best_of_each(found, cut).join(known, ["artist_lower"], "left_semi")
    return top_k(kept, devotion_order(), cut.roster_size).select(
        "artist", "track", "listeners", "playcount", "plays_per_listener"
    )


def rosters_compared(
    found: DataFrame, songs: DataFrame, cut: Cutoffs, cutoffs: tuple[int, ...] = (3, 10)
) -> DataFrame:
    """The final list under each roster cutoff, labelled with it, in one pass for all of them.

    The best few of an artist do not depend on the cutoff, so they are cut once. Each joins its
    artist's number of songs, counts towards the cutoffs that number passes, and the lists are
    cut to size side by side.
    """
    known = one_row_per_key(
        known_artists(songs, min(cutoffs)).where(F.col("career_peak") <= cut.worst_peak).withColumn("artist_lower", F.lower("primary_artist")),
        ["artist_lower"],
        F.max("songs_charted").alias("most_songs"),
    )
    joined = best_of_each(found, cut).join(known, ["artist_lower"])
    passed = F.filter(F.array(*map(F.lit, cutoffs)), lambda n: F.col("most_songs") >= n)
    names = ["artist", "track", "listeners", "playcount", "plays_per_listener"]
    counted = joined.select(*names, F.explode(passed).alias("min_songs"))
    return top_n_per_group(counted, ["min_songs"], devotion_order(), cut.roster_size).select(*names, "min_songs")


def first_last_seen(chart: DataFrame, cut: Cutoffs, mapping: DataFrame | None = None) -> DataFrame:
    """First and last archive week per lead artist.

    Weeks are reduced per credit first. By default the lead artist comes from every
    credit; ``mapping`` (performer, primary_artist) limits it to known credits.
    """
    spans = one_row_per_key(
        chart,
        ["performer"],
        F.min("chart_week").alias("first_chart"),
        F.max("chart_week").alias("last_chart"),
    )
    if mapping is None:
        spans = spans.withColumn("primary_artist", primary_entity(F.col("performer"), cut.rungs))
    else:
        spans = spans.join(mapping.select("performer", "primary_artist").distinct(), "performer")
    return spans.groupBy("primary_artist").agg(
        F.min("first_chart").alias("first_chart"), F.max("last_chart").alias("last_chart")
    )


def gem_page(top: DataFrame, details: DataFrame, eras: DataFrame) -> DataFrame:
    """One scored row per frozen top row, with details and debut decade.

    The plan is the same for a list of any length: Spark picks the joins by size and the
    ranks are counted slot by slot.
    """
    names = top.select("artist", "track").distinct()
    wanted = one_row_per_key(
        details.join(names, ["artist", "track"], "left_semi"),
        ["artist", "track"],
        F.min(F.struct("album", "tags", "duration_ms")).alias("d"),
    ).select("artist", "track", "d.*")
    artists = top.select(F.lower("artist").alias("artist_lower")).distinct()
    debut = one_row_per_key(
        eras.withColumn("artist_lower", F.lower("primary_artist")).join(
            artists, ["artist_lower"], "left_semi"
        ),
        ["artist_lower"],
        F.min("first_chart").alias("first_chart"),
    )
    page = (
        top.withColumn("artist_lower", F.lower("artist"))
        .join(wanted, ["artist", "track"], "left")
        .join(debut, ["artist_lower"], "left")
    )
    page = composite_score(page, SCORE_WEIGHTS, "gem_score")
    return page.select(
        "artist",
        "track",
        "listeners",
        "playcount",
        "plays_per_listener",
        "album",
        first_tag(F.col("tags")).alias("genre"),
        "tags",
        duration_text(F.col("duration_ms")).alias("duration"),
        decade_of_date(F.col("first_chart")).alias("debut_decade"),
        "gem_score",
    )


def decade_scores(found: DataFrame) -> DataFrame:
    """Composite score within the debut decade. Inferred: only the column name is known."""
    return composite_score(found, SCORE_WEIGHTS, "decade_score", ("debut_decade",))


def decade_worklist(scored: DataFrame, k: int = 2) -> DataFrame:
    """Best k per decade, ranked."""
    return top_n_per_group(
        scored,
        ["debut_decade"],
        [F.desc("decade_score"), F.asc("artist"), F.asc("track")],
        k,
        rank="rk",
    )


def resolve_years(worklist: DataFrame, replies: DataFrame, min_score: int = 90) -> DataFrame:
    """Release year of every work-list row, blended with its debut decade.

    Only the replies the list asks for are parsed.
    """
    names = ["artist", "track"]
    wanted = lookup_join(replies, one_row_per_key(worklist, names), names, "left_semi")
    years = one_row_per_key(
        release_years(wanted, "body", min_score),
        names,
        F.min("release_year").alias("release_year"),
        F.max("mb_score").alias("mb_score"),
    )
    year = F.col("release_year")
    decade = F.when(year.isNull(), "").otherwise(decade_of_date(year.cast("string")))
    return worklist.join(years, names, "left").select(
        *names,
        "debut_decade",
        "release_year",
        decade.alias("release_decade"),
        F.coalesce("mb_score", F.lit(0)).alias("mb_score"),
        F.when(year.isNull(), 0).otherwise(1).alias("matched"),
        blend_decade(decade, F.col("debut_decade")).alias("decade"),
    )


def decade_match_report(years: DataFrame) -> DataFrame:
    return group_match_rate(years, "debut_decade")


def shrink_ledger(chart: DataFrame, tracks: DataFrame, cut: Cutoffs) -> DataFrame:
    """Named row counts along the build; the two costly stages are stored once."""
    songs = materialize(song_grain(chart, cut.rungs))
    roster = known_artists(songs, cut.min_songs)
    kept = devoted(tracks, cut)
    found = materialize(gems(tracks, songs, cut, drop_variants=False))
    clean = without_variants(found)
    return ledger(
        {
            "chart_entries": chart,
            "distinct_credits": chart.select("performer").distinct(),
            "artist_songs": songs,
            "known_artists": roster,
            "tracks": tracks,
            "devoted_tracks": kept,
            "unmatched_collapsed": found,
            "gems": clean,
            "top_gems": top_gems(clean, roster, cut),
        }
    )
