"""Keeping a finished list up to date from one snapshot to the next.

Whether a match key is in the list depends only on the tracks and songs with that key. So a new
snapshot is compared with the one before key by key, and only keys whose rows differ are worked
out again; all others are taken over.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.operators.joins import lookup_join, one_row_per_key
from linkrank.operators.review import KEYS, with_song_keys
from linkrank.plans import gems as plan
from linkrank.runtime import materialize


KEY = "__key"


def _keyed(df: DataFrame, keys: list[str]) -> DataFrame:
    """With all keys in one struct: there NULL equals NULL, also in a join."""
    return df.withColumn(KEY, F.struct(*keys))


def _contents(df: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key: how many rows it has, and two sums over hashes of them.

    Sums of hashes can be added up before the shuffle and do not depend on the order of rows.
    """
    rest = sorted(set(df.columns).difference(keys))
    hashes = [F.xxhash64(F.lit(k), *[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in rest]) for k in (1, 2)]
    return _keyed(df, keys).groupBy(KEY).agg(F.count("*").alias("n"), *(F.sum(h.cast("decimal(20,0)")).alias(f"h{k}") for k, h in enumerate(hashes)))


def changed_keys(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows are not the same in both tables, each once. Repeated rows count."""
    a = _contents(before, keys).withColumnsRenamed({c: f"{c}_a" for c in ("n", "h0", "h1")})
    both = a.join(_contents(after, keys), KEY, "full")
    same = (F.col("n_a") == F.col("n")) & (F.col("h0_a") == F.col("h0")) & (F.col("h1_a") == F.col("h1"))
    return both.where(~F.coalesce(same, F.lit(False))).select(f"{KEY}.*")


def gems_by_key(tracks: DataFrame, songs: DataFrame, cut: plan.Cutoffs) -> DataFrame:
    """The finished list with its match keys, to be stored for the next snapshot."""
    return plan.gems(tracks, songs, cut)


def refreshed_gems(
    stored: DataFrame,
    tracks_before: DataFrame,
    tracks_after: DataFrame,
    songs_before: DataFrame,
    songs_after: DataFrame,
    cut: plan.Cutoffs,
) -> tuple[DataFrame, DataFrame]:
    """The list after a new snapshot, and the keys that were worked out again.

    ``stored`` is ``gems_by_key`` of the tables before. Equal to a full build from the tables
    after; store the first four tables first, as each is read twice.
    """
    names = [*KEYS, "artist", "track", "listeners", "playcount", "plays_per_listener"]
    old, new = (plan.devoted(t, cut).select(*names) for t in (tracks_before, tracks_after))
    old_songs, new_songs = (one_row_per_key(with_song_keys(s, cut.key_level), KEYS) for s in (songs_before, songs_after))
    touched = changed_keys(old, new, KEYS)
    if songs_before is not songs_after:
        touched = touched.unionByName(changed_keys(old_songs, new_songs, KEYS)).distinct()
    touched = materialize(touched)
    which = _keyed(touched, KEYS).select(KEY)
    again = lookup_join(_keyed(new, KEYS), which, [KEY], "left_semi").drop(KEY)
    found = plan.without_variants(plan.absent_from_archive(plan.collapse(again, cut), new_songs))
    kept = _keyed(stored, KEYS).join(which, KEY, "left_anti").drop(KEY)
    return kept.unionByName(found.select(*stored.columns)), touched


def list_changes(before: DataFrame, after: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """Two finished lists, one row per key each: kept, changed, added or dropped.

    A key is changed when it is on both lists with other values; NULL equals NULL. Values are
    those of the later list, or of the earlier one where the key was dropped.
    """
    a = _keyed(before, keys).select(KEY, F.struct(*values).alias("old"))
    b = _keyed(after, keys).select(KEY, F.struct(*values).alias("new"))
    change = (
        F.when(F.col("new").isNull(), "dropped")
        .when(F.col("old").isNull(), "added")
        .when(F.col("old").eqNullSafe(F.col("new")), "kept")
        .otherwise("changed")
    )
    both = a.join(b, KEY, "full")
    shown = F.coalesce("new", "old")
    return both.select(f"{KEY}.*", change.alias("change"), *(shown[c].alias(c) for c in values))
