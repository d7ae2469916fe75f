"""The rules as SQL functions, for those who write the analysis as one SQL script.

``register`` creates temporary functions in a session. Their bodies are SQL expressions, so a
query with them is planned like one that spells the rules out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import SparkSession

from linkrank.functions.keys import CREDIT_RUNGS, DELETED_CHARS, DROPPED_WORDS, SPACED_CHARS, TITLE_TAILS
from linkrank.functions.text import TIER_LABELS, VARIANT_MARKERS, any_case


def text(value: str) -> str:
    """A SQL literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _ladder(col: str) -> str:
    steps = " ".join(f"WHEN contains({col}, {text(r)}) THEN substring_index({col}, {text(r)}, 1)" for r in CREDIT_RUNGS)
    return f"CASE {steps} ELSE {col} END"


def _cut_tail(col: str) -> str:
    steps = " ".join(f"WHEN {col} RLIKE {text(any_case(t))} THEN split({col}, {text(any_case(t))}, 2)[0]" for t in TITLE_TAILS)
    return f"CASE {steps} ELSE {col} END"


def _fold(col: str) -> str:
    swept = f"' ' || translate(lower({col}), {text(SPACED_CHARS + DELETED_CHARS)}, {text(' ' * len(SPACED_CHARS))}) || ' '"
    sweeps = [f" {word} " for word in DROPPED_WORDS] + ["  "]
    return f"trim({reduce(lambda x, s: f'replace({x}, {text(s)}, {text(chr(32))})', sweeps, f'({swept})')})"


def _any_marker(col: str) -> str:
    return " OR ".join(f"contains(lower({col}), {text(m)})" for m in VARIANT_MARKERS)


_FEW, _MIDDLE, _MANY = (text(x) for x in TIER_LABELS)

#: Name and parameters, type of the result, body.
SCALARS = (
    ("primary_entity(credit STRING)", "STRING", _ladder("credit")),
    ("title_cut_tail(title STRING)", "STRING", _cut_tail("title")),
    ("title_cut_dash(title STRING)", "STRING", "substring_index(title, ' - ', 1)"),
    ("fold_title(title STRING)", "STRING", _fold("title")),
    (
        "match_key(title STRING, level INT)",
        "STRING",
        """CASE WHEN level <= 0 THEN lower(title) WHEN level = 1 THEN lower(trim(title_cut_tail(title)))
        WHEN level = 2 THEN lower(trim(title_cut_dash(title_cut_tail(title)))) ELSE fold_title(title_cut_dash(title_cut_tail(title))) END""",
    ),
    ("song_key(title STRING, level INT)", "STRING", "CASE WHEN level >= 3 THEN fold_title(title) ELSE lower(title) END"),
    ("is_variant(title STRING)", "BOOLEAN", _any_marker("title")),
    (
        "tier_label(listeners BIGINT, low BIGINT, high BIGINT)",
        "STRING",
        f"CASE WHEN listeners < low THEN {_FEW} WHEN listeners >= high THEN {_MANY} ELSE {_MIDDLE} END",
    ),
    (
        "duration_text(millis BIGINT)",
        "STRING",
        "CASE WHEN millis IS NULL OR millis = 0 THEN '' ELSE (millis div 60000) || ':' || lpad(millis div 1000 % 60, 2, '0') END",
    ),
)


def register(spark: SparkSession) -> None:
    for signature, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")


def register_tables(spark: SparkSession, chart: str, tracks: str) -> None:
    """Table functions over two named tables or views: ``artist_songs()``, ``known_artists(min_songs)``,
    ``devoted_tracks(min_listeners, min_ratio)`` and ``gems(min_listeners, min_ratio, low, high)``."""
    register(spark)
    tables = (
        (
            "artist_songs()",
            "primary_artist STRING, title STRING, performer STRING, best_peak INT, total_weeks INT",
            f"""SELECT primary_artist, title, min_by(performer, struct(peak, performer)), min(peak), max(wks_on_chart)
            FROM (SELECT primary_entity(performer) AS primary_artist, title, performer, try_cast(peak_pos AS INT) AS peak, wks_on_chart
                  FROM {chart}) GROUP BY primary_artist, title""",
        ),
        (
            "known_artists(min_songs BIGINT)",
            "primary_artist STRING, songs_charted BIGINT, career_peak INT",
            """SELECT primary_artist, count(*), min(best_peak) FROM artist_songs()
            GROUP BY primary_artist HAVING count(*) >= known_artists.min_songs""",
        ),
        (
            "devoted_tracks(min_listeners BIGINT, min_ratio DOUBLE)",
            "artist STRING, track STRING, playcount BIGINT, listeners BIGINT, plays_per_listener DOUBLE, artist_key STRING, title_key STRING",
            f"""SELECT artist, track, playcount, listeners, round(plays, 1), lower(artist), match_key(track, 3)
            FROM (SELECT *, try_divide(CAST(playcount AS DOUBLE), CAST(listeners AS DOUBLE)) AS plays FROM {tracks})
            WHERE listeners >= devoted_tracks.min_listeners AND plays >= devoted_tracks.min_ratio""",
        ),
        (
            "gems(min_listeners BIGINT, min_ratio DOUBLE, low BIGINT, high BIGINT)",
            "artist STRING, track STRING, listeners BIGINT, playcount BIGINT, plays_per_listener DOUBLE, tier STRING",
            """SELECT artist, track, listeners, playcount, plays_per_listener, tier_label(listeners, gems.low, gems.high)
            FROM (SELECT artist_key, title_key, min(artist) AS artist, min(track) AS track, max(listeners) AS listeners,
                         max(playcount) AS playcount, max(plays_per_listener) AS plays_per_listener
                  FROM devoted_tracks(gems.min_listeners, gems.min_ratio) GROUP BY artist_key, title_key) found
            LEFT ANTI JOIN (SELECT DISTINCT lower(primary_artist) AS artist_key, song_key(title, 3) AS title_key FROM artist_songs()) known
            ON known.artist_key = found.artist_key AND known.title_key = found.title_key
            WHERE NOT coalesce(is_variant(track), false)""",
        ),
    )
    for signature, columns, body in tables:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE({columns}) RETURN {body}")
