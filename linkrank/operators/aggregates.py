"""Grain, roster, distribution and cutoff reports; every one is a partial aggregate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.functions.keys import CREDIT_RUNGS, primary_entity
from linkrank.functions.text import contains_ci

ROSTER_MIN_SONGS = 5


def coverage(df: DataFrame, week: str = "chart_week") -> DataFrame:
    return df.agg(
        F.countDistinct(week).alias("weeks"),
        F.min(week).alias("first_week"),
        F.max(week).alias("last_week"),
    )


def completeness(df: DataFrame, group: str, expected: int | None = None) -> DataFrame:
    """Do distinct groups times the expected size give the row count, group by group?

    Without an expected size, every group should be as large as the largest.
    """
    sizes = df.groupBy(group).agg(F.count("*").alias("n"))
    size = F.max("n") if expected is None else F.lit(expected).cast("long")
    return (
        sizes.groupBy("n")
        .agg(F.count("*").alias("groups"))
        .agg(
            F.coalesce(F.sum(F.col("n") * F.col("groups")), F.lit(0)).alias("actual_rows"),
            F.coalesce(F.sum("groups"), F.lit(0)).alias("all_groups"),
            size.alias("size"),
            F.coalesce(F.sum(F.when(F.col("n") == expected, F.col("groups")) if expected is not None else F.lit(0)), F.lit(0)).alias("at_size"),
            F.max_by("groups", "n").alias("at_largest"),
        )
        .select(
            "actual_rows",
            F.coalesce(F.col("all_groups") * F.col("size"), F.lit(0)).alias("expected_rows"),
            (F.col("all_groups") - F.coalesce(F.col("at_largest" if expected is None else "at_size"), F.lit(0))).alias("uneven_groups"),
        )
    )


def titles_per_credit(df: DataFrame, credit: str = "performer", title: str = "title") -> DataFrame:
    return df.groupBy(credit).agg(F.countDistinct(title).alias("songs_charted"))


def credit_variants(df: DataFrame, needle: str, credit: str = "performer") -> DataFrame:
    return titles_per_credit(df.where(contains_ci(F.col(credit), needle)), credit)


def pattern_counts(df: DataFrame, col: str, patterns: dict[str, str]) -> DataFrame:
    """Rows in total and rows holding each pattern, in one pass."""
    return df.agg(
        F.count("*").alias("total"),
        *[F.count_if(contains_ci(F.col(col), p)).alias(name) for name, p in patterns.items()],
    )


def song_grain(chart: DataFrame, rungs=CREDIT_RUNGS) -> DataFrame:
    """One row per lead artist and title; the kept credit is the best-peaking one.

    Weeks are reduced to one row per credit and title first, with numbers only, which Spark adds up
    by hash; the lead artist is cut from, and the best credit picked among, those few rows.
    """
    peak = F.col("peak_pos").try_cast("int")
    per_credit = (
        chart.select("performer", "title", peak.alias("peak"), "wks_on_chart")
        .groupBy("performer", "title")
        .agg(
            F.min("peak").alias("peak"),
            F.bool_or(F.col("peak").isNull()).alias("without"),
            F.max("wks_on_chart").alias("weeks"),
        )
    )
    first = F.when(~F.col("without"), F.col("peak"))  # a week without a peak comes before all others
    return (
        per_credit.withColumn("primary_artist", primary_entity(F.col("performer"), rungs))
        .groupBy("primary_artist", "title")
        .agg(
            F.min_by("performer", F.struct(first.alias("first"), F.col("performer"))).alias("performer"),
            F.min("peak").alias("best_peak"),
            F.max("weeks").alias("total_weeks"),
        )
    )


def entity_sizes(songs: DataFrame) -> DataFrame:
    return songs.groupBy("primary_artist").agg(
        F.count("*").alias("songs_charted"), F.min("best_peak").alias("career_peak")
    )


def known_artists(songs: DataFrame, min_songs: int = ROSTER_MIN_SONGS) -> DataFrame:
    return entity_sizes(songs).where(F.col("songs_charted") >= min_songs)


def count_histogram(sizes: DataFrame, size: str, out: str) -> DataFrame:
    return sizes.groupBy(size).agg(F.count("*").alias(out))


def survivors(df: DataFrame, col: str, cutoffs: dict[str, float]) -> DataFrame:
    """Rows left at each candidate cutoff."""
    return df.agg(*[F.count_if(F.col(col) >= c).alias(name) for name, c in cutoffs.items()])


def bands(df: DataFrame, col: str, edges: list[float], names: list[str], *also: Column) -> DataFrame:
    """Half-open band counts; ``names`` has one more entry than ``edges``."""
    x = F.col(col)
    tests: list[Column] = [x < edges[0]]
    tests += [(x >= lo) & (x < hi) for lo, hi in zip(edges, edges[1:])]
    tests.append(x >= edges[-1])
    return df.agg(*also, *[F.count_if(t).alias(n) for t, n in zip(tests, names, strict=True)])


def case_twins(roster: DataFrame, name: str = "primary_artist") -> DataFrame:
    return (
        roster.groupBy(F.lower(name).alias("artist_lower"))
        .agg(F.count("*").alias("roster_rows"))
        .where(F.col("roster_rows") > 1)
    )


def group_match_rate(df: DataFrame, group: str, flag: str = "matched") -> DataFrame:
    """Matched and total per group plus one overall row labelled 'all'."""
    counts = df.groupBy(group).agg(F.sum(flag).alias("matched"), F.count("*").alias("total"))
    overall = counts.agg(F.sum("matched").alias("matched"), F.sum("total").alias("total"))
    return (
        counts.unionByName(overall.select(F.lit("all").alias(group), "matched", "total"))
        .withColumn("pct", F.bround(F.try_divide(F.col("matched") * F.lit(100.0), F.col("total")), 0))
    )
