"""Captured API replies, one row per request with the reply text in ``body``."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.functions.nested import (
    LIST_OF_RECORDINGS,
    RECORDINGS,
    TOP_TAGS,
    TOP_TRACKS,
    TRACK_INFO,
    as_variant,
    best_score,
    earliest_year,
    is_failed,
    parse,
    shape_of,
    top_names,
)
from linkrank.functions.text import decade_of_date
from linkrank.operators.joins import lookup_join, one_row_per_key


def _text(col, default: str = ""):
    return F.coalesce(col, F.lit(default))


def parse_toptracks(df: DataFrame, artist: str = "artist", body: str = "body") -> DataFrame:
    """One row per track of every readable reply; missing members become ''."""
    return (
        df.select(artist, parse(F.col(body), TOP_TRACKS).alias("reply"))
        .where(~is_failed(F.col("reply")))
        .select(artist, F.inline("reply.toptracks.track"))
        .select(
            artist,
            _text(F.col("name")).alias("track"),
            _text(F.col("playcount")).alias("playcount"),
            _text(F.col("listeners")).alias("listeners"),
        )
    )


def parse_trackinfo(df: DataFrame, body: str = "body") -> DataFrame:
    """Album, first three tags and duration; a failed reply keeps its row with defaults."""
    keep = [c for c in df.columns if c != body]
    read = df.select(*keep, parse(F.col(body), TRACK_INFO).alias("reply")).withColumn(
        "failed", is_failed(F.col("reply"))
    )
    info = F.when(~F.col("failed"), F.col("reply.track"))
    return read.select(
        *keep,
        _text(info["album"]["title"]).alias("album"),
        top_names(info["toptags"]["tag"]).alias("tags"),
        _text(info["duration"], "0").alias("duration_ms"),
        "failed",
    )


def parse_toptags(df: DataFrame, owner: str, body: str = "body") -> DataFrame:
    """First three tags of each owner, one row per owner."""
    reply = F.col("reply")
    tags = F.when(~is_failed(reply), reply["toptags"]["tag"])
    return one_row_per_key(
        df.select(owner, parse(F.col(body), TOP_TAGS).alias("reply")).select(
            owner, top_names(tags).alias("tags")
        ),
        [owner],
        F.max("tags").alias("owner_tags"),
    )


def parse_recordings(df: DataFrame, body: str = "body") -> DataFrame:
    """The recordings list of each reply, an empty list where there is none."""
    keep = [c for c in df.columns if c != body]
    reply = F.col("reply")
    found = F.when(~is_failed(reply), reply["recordings"])
    return df.select(*keep, parse(F.col(body), RECORDINGS).alias("reply")).select(
        *keep, F.coalesce(found, F.array().cast(LIST_OF_RECORDINGS)).alias("recordings")
    )


def release_years(df: DataFrame, body: str = "body", min_score: int = 90) -> DataFrame:
    """Earliest trusted release year, its decade, best score and match flag per reply."""
    parsed = parse_recordings(df, body)
    keep = [c for c in parsed.columns if c != "recordings"]
    year = F.col("release_year")
    return parsed.select(
        *keep,
        earliest_year(F.col("recordings"), min_score).alias("release_year"),
        best_score(F.col("recordings")).alias("mb_score"),
    ).select(
        *keep,
        "release_year",
        F.when(year.isNull(), "").otherwise(decade_of_date(year.cast("string"))).alias("release_decade"),
        "mb_score",
        F.when(year.isNull(), 0).otherwise(1).alias("matched"),
    )


def tag_fallback(items: DataFrame, owners: DataFrame, owner: str, tags: str = "tags") -> DataFrame:
    """Item tags where there are any, else the owner's.

    ``owners`` has one row per owner (see :func:`parse_toptags`), so each owner's
    tags are worked out once however many items need them. A failed item reply
    (``failed`` true, when the column is there) keeps its empty tags.
    """
    joined = lookup_join(items, owners, [owner], "left")
    own = F.nullif(F.col(tags), F.lit(""))
    if "failed" in items.columns:
        own = F.when(F.col("failed"), F.lit("")).otherwise(own)
    return joined.withColumn(tags, F.coalesce(own, "owner_tags", F.lit(""))).drop("owner_tags")


def shape_census(sources: dict[str, DataFrame], body: str = "body") -> DataFrame:
    """How many replies of each source have which shape: for replies nobody has described yet.

    Replies that are missing or no JSON are counted as such.
    """
    rows = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), F.col(body).alias("body"), as_variant(F.col(body)).alias("reply"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("source", shape_of(F.col("reply"), F.col("body")).alias("shape")).agg(F.count("*").alias("replies"))


def merged_shapes(sources: dict[str, DataFrame], body: str = "body") -> DataFrame:
    """The schema that holds all JSON replies of each source: what to declare for it."""
    rows = None
    for name, df in sources.items():
        one = df.select(F.lit(name).alias("source"), as_variant(F.col(body)).alias("reply"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy("source").agg(F.schema_of_variant_agg("reply").alias("shape"), F.count("reply").alias("readable"), F.count("*").alias("replies"))


def parse_toptracks_variant(df: DataFrame, artist: str = "artist", body: str = "body") -> DataFrame:
    """The rows of ``parse_toptracks`` without a declared schema: a VARIANT per reply, read by path."""
    tracks = df.select(artist, as_variant(F.col(body)).alias("reply")).select(
        artist, F.explode(F.try_variant_get("reply", "$.toptracks.track", "array<variant>")).alias("track")
    )
    return tracks.select(
        artist,
        _text(F.try_variant_get("track", "$.name", "string")).alias("track"),
        _text(F.try_variant_get("track", "$.playcount", "string")).alias("playcount"),
        _text(F.try_variant_get("track", "$.listeners", "string")).alias("listeners"),
    )


def failure_totals(df: DataFrame, body: str = "body") -> DataFrame:
    """Requests, failed requests, and the rows that the others bring."""
    parsed = df.select(parse(F.col(body), TOP_TRACKS).alias("reply"))
    failed = is_failed(F.col("reply"))
    rows = F.when(~failed, F.size(F.col("reply")["toptracks"]["track"])).otherwise(0)
    return parsed.agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failed"), F.sum(rows).alias("rows_written")
    )


def failures(df: DataFrame, body: str = "body", shape: str = TOP_TRACKS) -> DataFrame:
    """Requests without a usable reply of the given shape; count these rows for the report."""
    keep = [c for c in df.columns if c != body]
    return (
        df.select(*keep, parse(F.col(body), shape).alias("reply"))
        .where(is_failed(F.col("reply")))
        .select(*keep)
    )
