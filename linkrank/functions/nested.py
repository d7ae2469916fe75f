"""Columns over nested API replies and over lists kept in one string."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from linkrank.functions.text import year4

TOP_TRACKS = "struct<toptracks: struct<track: array<struct<name: string, playcount: string, listeners: string>>>>"
TRACK_INFO = (
    "struct<track: struct<album: struct<title: string>,"
    " toptags: struct<tag: array<struct<name: string>>>, duration: string>>"
)
TOP_TAGS = "struct<toptags: struct<tag: array<struct<name: string>>>>"
LIST_OF_RECORDINGS = (
    "array<struct<score: string, `first-release-date`: string, releases: array<struct<date: string>>>>"
)
RECORDINGS = f"struct<recordings: {LIST_OF_RECORDINGS}>"

LIST_MARK = "|"
# Member of a parsed reply that holds the text of an unreadable one.
UNREADABLE = "_unreadable"


def parse(body: Column, shape: str) -> Column:
    """Reply text as a struct. Keep it in a column of its own, so that it is parsed once."""
    marked = f"{shape.removesuffix('>')}, {UNREADABLE}: string>"
    return F.from_json(body, marked, {"columnNameOfCorruptRecord": UNREADABLE})


def is_failed(reply: Column) -> Column:
    """No reply, or a reply that is not JSON of the expected shape."""
    return reply.isNull() | reply[UNREADABLE].isNotNull()


def _score(recording: Column) -> Column:
    return F.coalesce(recording["score"].try_cast("int"), F.lit(0))


def top_names(tags: Column, n: int = 3) -> Column:
    """First n tag names in one string; empty text when there are none."""
    names = F.transform(F.slice(tags, 1, n), lambda t: F.coalesce(t["name"], F.lit("")))
    return F.coalesce(F.array_join(names, LIST_MARK), F.lit(""))


def first_tag(tags: Column) -> Column:
    return F.coalesce(F.substring_index(tags, LIST_MARK, 1), F.lit(""))


def has_tag(tags: Column, tag: str) -> Column:
    return F.array_contains(F.split(tags, "[|]"), tag)


def earliest_year(recordings: Column, min_score: int = 90) -> Column:
    """Smallest year of any dated release among confidently matched recordings."""
    trusted = F.filter(recordings, lambda r: _score(r) >= min_score)
    dates = F.flatten(
        F.transform(
            trusted,
            lambda r: F.concat(
                F.array(r["first-release-date"]),
                F.coalesce(
                    F.transform(r["releases"], lambda d: d["date"]),
                    F.array().cast("array<string>"),
                ),
            ),
        )
    )
    return F.array_min(F.transform(dates, year4))


def best_score(recordings: Column) -> Column:
    return F.coalesce(F.array_max(F.transform(recordings, _score)), F.lit(0))


def blend_decade(release_decade: Column, debut_decade: Column) -> Column:
    """Release decade where known, else the debut decade."""
    return F.coalesce(F.nullif(release_decade, F.lit("")), debut_decade)


# Replies whose shape is not known beforehand.


def as_variant(body: Column) -> Column:
    """Reply text as a VARIANT; NULL if it is no JSON. Keep it in a column of its own."""
    return F.try_parse_json(body)


def shape_of(reply: Column, body: Column) -> Column:
    """The schema of one reply, or why it has none."""
    shape = F.schema_of_variant(reply)
    return F.when(body.isNull(), "no reply").when(reply.isNull(), "not JSON").otherwise(shape)
