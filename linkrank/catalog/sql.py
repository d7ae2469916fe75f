"""SQL text of the text rules and stages, written out for the checks."""

from __future__ import annotations

from linkrank.catalog.registry import CUT
from linkrank.functions.keys import CREDIT_RUNGS, TITLE_TAILS
from linkrank.functions.text import ASCII_LOWER, ASCII_UPPER, TIER_LABELS, VARIANT_MARKERS


def text_list(texts) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in texts) + "]"


def _first_found(texts, col: str) -> str:
    """The first of several texts, in their order, that ``col`` holds."""
    return f"list_filter({text_list(texts)}, lambda x: contains({col}, x))[1]"


def ladder(col: str, rungs=CREDIT_RUNGS) -> str:
    return f"coalesce(split_part({col}, {_first_found(rungs, col)}, 1), {col})"


def cut_tail(col: str) -> str:
    low = f"translate({col}, '{ASCII_UPPER}', '{ASCII_LOWER}')"
    kept = f"substring({col}, 1, length(split_part({low}, {_first_found(TITLE_TAILS, low)}, 1)))"
    return f"coalesce({kept}, {col})"


def cut_dash(col: str, dash: str = " - ") -> str:
    return f"split_part({col}, '{dash}', 1)"


def fold(col: str) -> str:
    out = f"regexp_replace(lower({col}), '[''’‘\"“”]', '', 'g')"
    out = f"' ' || regexp_replace({out}, '[,.!?()*:;/]', ' ', 'g') || ' '"
    for sweep in (" a ", " an ", " the ", "  "):
        out = f"replace({out}, '{sweep}', ' ')"
    return f"trim({out}, ' ')"


def key(col: str, level: int) -> str:
    if level == 0:
        return f"lower({col})"
    if level == 1:
        return f"lower(trim({cut_tail(col)}, ' '))"
    cut = f"(SELECT {cut_dash('c1')} FROM (SELECT {cut_tail(col)} AS c1))"
    return f"lower(trim({cut}, ' '))" if level == 2 else fold(cut)


def song_key(col: str, level: int) -> str:
    return fold(col) if level == 3 else f"lower({col})"


SONGS = f"""
songs AS (SELECT primary_artist, title,
       arg_min(performer, row(try_cast(peak_pos AS int), performer)) AS performer,
       min(try_cast(peak_pos AS int)) AS best_peak, max(wks_on_chart) AS total_weeks
FROM (SELECT *, {ladder('performer')} AS primary_artist FROM chart) GROUP BY 1, 2)"""


def roster(min_songs: int = CUT.min_songs) -> str:
    return f"""
known_artists AS (SELECT primary_artist, count(*) AS songs_charted, min(best_peak) AS career_peak
FROM songs GROUP BY 1 HAVING count(*) >= {min_songs})"""


def devoted(level: int = 3, source: str = "stats", prefix: str = "") -> str:
    return f"""
{prefix}devoted AS (SELECT *, round(plays, 1) AS plays_per_listener, lower(artist) AS artist_key,
       {key('track', level)} AS title_key
FROM (SELECT *, playcount::double / nullif(listeners, 0) AS plays FROM {source})
WHERE listeners >= {CUT.min_listeners} AND plays >= {CUT.min_ratio})"""


def song_keys(level: int = 3) -> str:
    return f"""
song_keys AS (SELECT *, lower(primary_artist) AS artist_key, {song_key('title', level)} AS title_key FROM songs)"""


def markers(col: str = "track", negate: bool = True) -> str:
    held = f"list_count(list_filter({text_list(VARIANT_MARKERS)}, lambda x: contains(lower({col}), x)))"
    return f"coalesce({held}, 0) = 0" if negate else f"{held} > 0"


def tier(col: str, labels=TIER_LABELS, low: int = CUT.low_tier, high: int = CUT.high_tier) -> str:
    few, middle, many = labels
    return f"CASE WHEN {col} < {low} THEN '{few}' WHEN {col} >= {high} THEN '{many}' ELSE '{middle}' END"


def gems(clean: bool = True, prefix: str = "") -> str:
    """Track by track: no partner in the archive; only then one row per key."""
    return f"""
{prefix}absent AS (SELECT t.* FROM {prefix}devoted t LEFT JOIN song_keys s
           ON s.artist_key = t.artist_key AND s.title_key = t.title_key WHERE s.artist_key IS NULL),
{prefix}once AS (SELECT artist_key, title_key, min(artist) AS artist, min(track) AS track,
       max(listeners) AS listeners, max(playcount) AS playcount,
       max(plays_per_listener) AS plays_per_listener
FROM {prefix}absent GROUP BY artist_key, title_key),
{prefix}gems AS (SELECT *, {tier('listeners')} AS tier FROM {prefix}once {('WHERE ' + markers()) if clean else ''})"""


DEVOTION = "plays_per_listener DESC, listeners DESC, artist, track"

TOP = f"""
top_gems AS (SELECT artist, track, listeners, playcount, plays_per_listener FROM gems
JOIN (SELECT DISTINCT lower(primary_artist) AS known FROM known_artists WHERE career_peak <= {CUT.worst_peak})
  ON known = lower(gems.artist)
WHERE tier = 'hidden gem'
QUALIFY row_number() OVER (PARTITION BY lower(artist) ORDER BY {DEVOTION}) <= {CUT.per_artist}
ORDER BY {DEVOTION} LIMIT {CUT.roster_size})"""


def stages(*ctes: str) -> str:
    return ",\n".join(c.strip() for c in ctes)


SONG_STAGES = stages(SONGS, roster())
GEM_STAGES = stages(SONGS, roster(), song_keys(), devoted(), gems())
RAW_GEM_STAGES = stages(SONGS, roster(), song_keys(), devoted(), gems(clean=False))
EARLY_STAGES = stages(SONGS, song_keys(), devoted(), gems(), devoted(source="early_stats", prefix="early_"), gems(prefix="early_"))
TOP_STAGES = stages(SONGS, roster(), song_keys(), devoted(), gems(), TOP)
