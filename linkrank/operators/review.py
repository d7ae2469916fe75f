"""Reports that show what a matching rule changed, gained or merged by mistake."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.functions.keys import artist_key, match_key, primary_entity, song_key
from linkrank.operators.joins import lookup_join, match_rate, one_row_per_key, unmatched
from linkrank.runtime import materialize

KEYS = ["artist_key", "title_key"]
LEVELS = (0, 1, 2, 3)


def rule_preview(df: DataFrame, credit: str, ladders: dict[int, tuple[str, ...]]) -> DataFrame:
    """Distinct credits that each of several ladders changes, next to what it makes of them."""
    leads = F.array(
        *[
            F.struct(F.lit(n).alias("rungs"), primary_entity(F.col(credit), rungs).alias("primary_artist"))
            for n, rungs in ladders.items()
        ]
    )
    found = df.select(credit).distinct().select(credit, F.inline(leads))
    return found.where(F.col("primary_artist") != F.col(credit)).select("rungs", credit, "primary_artist")


def with_track_keys(df: DataFrame, level: int, artist: str = "artist", track: str = "track") -> DataFrame:
    return df.withColumns(
        {"artist_key": artist_key(F.col(artist)), "title_key": match_key(F.col(track), level)}
    )


def with_song_keys(
    df: DataFrame, level: int, artist: str = "primary_artist", title: str = "title"
) -> DataFrame:
    return df.withColumns(
        {"artist_key": artist_key(F.col(artist)), "title_key": song_key(F.col(title), level)}
    )


def key_rule_uplift(tracks: DataFrame, songs: DataFrame, levels=LEVELS) -> DataFrame:
    """Match rate of every key level, one row each: both sides unfold their keys and meet once."""

    def unfolded(df: DataFrame, entity: str, title: str, key) -> DataFrame:
        keys = F.array(
            *[F.struct(F.lit(n).alias("key_level"), key(F.col(title), n).alias("title_key")) for n in levels]
        )
        return df.select(artist_key(F.col(entity)).alias("artist_key"), F.inline(keys))

    left = unfolded(tracks, "artist", "track", match_key)
    right = unfolded(songs, "primary_artist", "title", song_key)
    return match_rate(left, right, ["key_level", *KEYS], ("key_level",))


def false_merge_check(songs: DataFrame, level: int = 3) -> DataFrame:
    """Keys under which one entity owns several titles, with the first and last of them.

    Copies go first, so keys are worked out once per distinct title. The count and
    the two witnesses fit in a fixed-size buffer; the titles of a key are never
    collected.
    """
    spellings = songs.select(artist_key(F.col("primary_artist")).alias("artist_key"), "title").distinct()
    return (
        spellings.withColumn("title_key", song_key(F.col("title"), level))
        .groupBy(*KEYS)
        .agg(
            F.count("*").alias("titles"),
            F.min("title").alias("first_title"),
            F.max("title").alias("last_title"),
        )
        .where(F.col("titles") > 1)
    )


def merged_titles(songs: DataFrame, level: int = 3) -> DataFrame:
    """Every title that shares its key with another title of the same entity, one row each.

    The titles stay rows, so a key may have any number of them; keys with several come from the
    two-phase count and are met again in a join that splits hot keys.
    """
    spellings = songs.select(artist_key(F.col("primary_artist")).alias("artist_key"), "title").distinct()
    keyed = materialize(spellings.withColumn("title_key", song_key(F.col("title"), level)))
    several = keyed.groupBy(*KEYS).agg(F.count("*").alias("titles")).where(F.col("titles") > 1)
    return lookup_join(keyed, several, KEYS, "inner").select(*KEYS, "titles", "title")


def punctuation_false_gems(tracks: DataFrame, songs: DataFrame) -> DataFrame:
    """Tracks that look absent from the archive at level 2 and are found at level 3."""
    missed = unmatched(with_track_keys(tracks, 2), with_song_keys(songs, 2), KEYS)
    per_key = one_row_per_key(with_song_keys(songs, 3), KEYS)
    again = with_track_keys(missed.drop(*KEYS), 3)
    return lookup_join(again, per_key, KEYS, "left_semi")
