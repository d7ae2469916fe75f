"""Entity resolution: credit ladders, title cuts, match keys and their reviews."""

from pyspark.sql import functions as F

from linkrank.catalog.filters import songs
from linkrank.catalog.joins import TRACK_COLUMNS, UNMATCHED, devoted_table, keyed_songs
from linkrank.catalog.registry import query
from linkrank.catalog.sql import SONGS, cut_dash, cut_tail, devoted, key, ladder, song_key, song_keys, stages
from linkrank.functions import keys as ky
from linkrank.operators import joins as jn
from linkrank.operators import review as rv
from linkrank.operators.rank import top_k
from linkrank.runtime import materialize
from linkrank.sources.standins import with_sql

# Joiners of the document credits, most specific first.
RUNGS = (" of the ", " of ", " and ")


@query(
    "primary_entity",
    with_sql("lines", f"SELECT track AS credit, {ladder('track', RUNGS)} AS primary_artist FROM lines"),
)
def primary_entity(t):
    """Every document line taken as a credit."""
    lead = ky.primary_entity(F.col("track"), RUNGS).alias("primary_artist")
    return t.lines.select(F.col("track").alias("credit"), lead)


LADDERS = {2: (" Featuring ", " With "), 3: (" Duet With ", " Featuring ", " With "), 4: ky.CREDIT_RUNGS}


@query(
    "rule_preview",
    with_sql(
        "chart",
        " UNION ALL ".join(
            f"""SELECT {n} AS rungs, performer, primary_artist FROM (SELECT DISTINCT performer,
            {ladder('performer', rungs)} AS primary_artist FROM chart) WHERE primary_artist <> performer"""
            for n, rungs in LADDERS.items()
        ),
    ),
)
def rule_preview(t):
    """Three versions of the ladder, each with the credits it changes."""
    return rv.rule_preview(t.chart, "performer", LADDERS)


@query("title_cut_tail", with_sql("stats", f"SELECT artist, track, {cut_tail('track')} AS cut FROM stats"))
def title_cut_tail(t):
    return t.stats.select("artist", "track", ky.title_cut_tail(F.col("track")).alias("cut"))


@query("title_cut_dash", with_sql("stats", f"SELECT artist, track, {cut_dash('track')} AS cut FROM stats"))
def title_cut_dash(t):
    return t.stats.select("artist", "track", ky.title_cut_dash(F.col("track")).alias("cut"))


def _key_query(level):
    sql = with_sql(
        "lines", f"SELECT lower(artist) AS artist_key, track, {key('track', level)} AS title_key FROM lines"
    )

    def build(t):
        return rv.with_track_keys(t.lines, level).select("artist_key", "track", "title_key")

    return query(f"match_key_v{level}", sql)(build)


for _level in (1, 2, 3):
    _key_query(_level)


@query(
    "page_title_keys",
    with_sql("titles", f"SELECT page_id, title, {key('title', 3)} AS title_key FROM titles"),
)
def page_title_keys(t):
    return t.titles.select("page_id", "title", ky.match_key(F.col("title"), 3).alias("title_key"))


@query(
    "key_rule_uplift",
    with_sql(
        "chart stats",
        " UNION ALL ".join(
            f"""SELECT {n} AS key_level, count(*) AS total, count(s.title) AS matched,
            round(count(s.title) * 100::double / count(*), 1) AS matched_pct
            FROM stats t LEFT JOIN songs s ON lower(t.artist) = lower(s.primary_artist)
             AND {key('t.track', n)} = {song_key('s.title', n)}"""
            for n in rv.LEVELS
        ),
        SONGS,
    ),
)
def key_rule_uplift(t):
    return rv.key_rule_uplift(t.stats, songs(t))


@query(
    "benchmark_match_rate",
    with_sql(
        "lines benchmark_songs",
        f"""SELECT count(*) AS total, count(b.title) AS matched,
        round(count(b.title) * 100::double / count(*), 1) AS matched_pct
        FROM (SELECT {key('track', 3)} AS k FROM lines) l
        LEFT JOIN (SELECT title, {song_key('title', 3)} AS k FROM benchmark_songs) b ON l.k = b.k""",
    ),
)
def benchmark_match_rate(t):
    """Document lines against benchmark lines by title key alone."""
    left = t.lines.select(ky.match_key(F.col("track")).alias("title_key"))
    right = t.benchmark_songs.select(ky.song_key(F.col("title")).alias("title_key"))
    return jn.match_rate(left, right, ["title_key"])


@query(
    "clerical_review",
    with_sql(
        "chart stats",
        f"""SELECT artist, track, listeners, plays_per_listener {UNMATCHED}
        ORDER BY listeners DESC, artist, track, plays_per_listener LIMIT 30""",
        stages(SONGS, song_keys(), devoted()),
    ),
)
def clerical_review(t):
    missed = jn.unmatched(devoted_table(t), keyed_songs(t), rv.KEYS).select(*TRACK_COLUMNS)
    order = [F.desc("listeners"), F.asc("artist"), F.asc("track"), F.asc("plays_per_listener")]
    return top_k(missed, order, 30)


@query(
    "false_merge_check",
    with_sql(
        "lines",
        f"""SELECT lower(artist) AS artist_key, {song_key('track', 3)} AS title_key, count(DISTINCT track) AS titles,
        min(track) AS first_title, max(track) AS last_title FROM lines GROUP BY 1, 2 HAVING count(DISTINCT track) > 1""",
    ),
)
def false_merge_check(t):
    as_songs = t.lines.select(F.col("artist").alias("primary_artist"), F.col("track").alias("title"))
    return rv.false_merge_check(as_songs)


@query(
    "merged_titles",
    with_sql(
        "lines",
        f"""SELECT artist_key, title_key, count(*) OVER (PARTITION BY artist_key, title_key) AS titles, title
        FROM (SELECT DISTINCT lower(artist) AS artist_key, {song_key('track', 3)} AS title_key, track AS title FROM lines)
        QUALIFY titles > 1""",
    ),
)
def merged_titles(t):
    """The further titles of each key, all of them."""
    as_songs = t.lines.select(F.col("artist").alias("primary_artist"), F.col("track").alias("title"))
    return rv.merged_titles(as_songs)


@query(
    "punctuation_false_gems",
    with_sql(
        "chart stats",
        f"""SELECT artist, track FROM (SELECT artist, track, {key('track', 2)} AS k2, {key('track', 3)} AS k3 FROM stats) t
        WHERE NOT EXISTS (SELECT 1 FROM songs s WHERE lower(s.primary_artist) = lower(t.artist) AND lower(s.title) = t.k2)
          AND EXISTS (SELECT 1 FROM songs s WHERE lower(s.primary_artist) = lower(t.artist)
                      AND {song_key('s.title', 3)} = t.k3)""",
        SONGS,
    ),
)
def punctuation_false_gems(t):
    tracks = materialize(t.stats.select("artist", "track"))
    return rv.punctuation_false_gems(tracks, materialize(songs(t))).select("artist", "track")
