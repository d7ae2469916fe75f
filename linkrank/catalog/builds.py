"""The analysis end to end."""

from linkrank.catalog.filters import songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import GEM_STAGES, SONG_STAGES, TOP_STAGES, cut_tail, key, ladder, markers, stages, tier
from linkrank.functions import sql
from linkrank.operators import aggregates as ag
from linkrank.operators.joins import lookup_join
from linkrank.plans import gems as plan
from linkrank.runtime import materialize, scratch_path
from linkrank.sources import files
from linkrank.sources.standins import with_sql

GEM_COLUMNS = ["artist", "track", "listeners", "playcount", "plays_per_listener", "tier"]
GEMS_SQL = with_sql("chart stats", f"SELECT {', '.join(GEM_COLUMNS)} FROM gems", GEM_STAGES)


def top(t, chart=None):
    grain = materialize(ag.song_grain(t.chart if chart is None else chart, CUT.rungs))
    return plan.top_gems(plan.gems(t.stats, grain, CUT), ag.known_artists(grain, CUT.min_songs), CUT)


@query("gems_build", GEMS_SQL)
def gems_build(t):
    return plan.gems(t.stats, songs(t), CUT).select(*GEM_COLUMNS)


@query("gems_build_sql", GEMS_SQL)
def gems_build_sql(t):
    """The same in SQL, with the rules as functions."""
    t.chart.createOrReplaceTempView("linkrank_chart")
    t.stats.createOrReplaceTempView("linkrank_tracks")
    sql.register_tables(t.spark, "linkrank_chart", "linkrank_tracks")
    return t.spark.sql(
        "SELECT * FROM gems(:min_listeners, :min_ratio, :low, :high)",
        args={"min_listeners": CUT.min_listeners, "min_ratio": CUT.min_ratio, "low": CUT.low_tier, "high": CUT.high_tier},
    )


@query(
    "roster_sql",
    with_sql("chart", "SELECT primary_artist, songs_charted, career_peak FROM known_artists", SONG_STAGES),
)
def roster_sql(t):
    t.chart.createOrReplaceTempView("linkrank_chart")
    t.stats.createOrReplaceTempView("linkrank_tracks")
    sql.register_tables(t.spark, "linkrank_chart", "linkrank_tracks")
    return t.spark.sql("SELECT * FROM known_artists(:least)", args={"least": CUT.min_songs})


@query(
    "rules_in_sql",
    with_sql(
        "lines",
        f"""SELECT artist, track, {ladder('track')} AS lead, {cut_tail('track')} AS cut, {key('track', 1)} AS k1, {key('track', 2)} AS k2,
        {key('track', 3)} AS k3, {markers('track', negate=False)} AS variant, {tier('length(track)', low=40, high=80)} AS tier,
        CASE WHEN length(track) = 0 THEN '' ELSE format('{{}}:{{:02d}}', length(track) * 1000 // 60000, length(track) * 1000 // 1000 % 60) END AS duration FROM lines""",
    ),
)
def rules_in_sql(t):
    """Every document line through every scalar rule."""
    t.lines.createOrReplaceTempView("linkrank_lines")
    sql.register(t.spark)
    return t.spark.sql(
        """SELECT artist, track, primary_entity(track) AS lead, title_cut_tail(track) AS cut, match_key(track, 1) AS k1,
        match_key(track, 2) AS k2, match_key(track, 3) AS k3, is_variant(track) AS variant, tier_label(length(track), 40, 80) AS tier,
        duration_text(length(track) * 1000) AS duration FROM linkrank_lines"""
    )


@query("roster_build", with_sql("chart stats", "SELECT * FROM top_gems", TOP_STAGES))
def roster_build(t):
    return top(t)


ERA = f"""
era AS (SELECT lower({ladder('performer')}) AS artist_lower, min(chart_week) AS first_chart FROM chart GROUP BY 1)"""


@query(
    "page_build",
    with_sql(
        "chart stats details",
        """SELECT artist, track, listeners, playcount, plays_per_listener, album,
        coalesce(split_part(tags, '|', 1), '') AS genre, tags,
        coalesce(format('{}:{:02d}', nullif(duration_ms, 0) // 60000, duration_ms // 1000 % 60), '') AS duration,
        left(first_chart, 3) || '0s' AS debut_decade,
        round((0.7::double * percent_rank() OVER (ORDER BY plays_per_listener)
             + 0.3::double * percent_rank() OVER (ORDER BY listeners)) * 100, 1) AS gem_score
        FROM top_gems LEFT JOIN details USING (artist, track) LEFT JOIN era ON artist_lower = lower(artist)""",
        stages(TOP_STAGES, ERA),
    ),
)
def page_build(t):
    chart = materialize(t.chart)
    frozen = materialize(top(t, chart))
    return plan.gem_page(frozen, t.details, plan.first_last_seen(chart, CUT))


SCORED = """
dated AS (SELECT g.artist, g.track, g.plays_per_listener, g.listeners,
       (floor((1940 + p_size) / 10)::bigint) || '0s' AS debut_decade, p_size
FROM gems g JOIN part ON g.artist = p_brand AND g.track = concat(p_name, ' #', cast(p_partkey AS varchar))),
scored AS (SELECT *, round((0.7::double * percent_rank() OVER (PARTITION BY debut_decade ORDER BY plays_per_listener)
     + 0.3::double * percent_rank() OVER (PARTITION BY debut_decade ORDER BY listeners)) * 100, 1) AS decade_score
FROM dated),
work AS (SELECT * FROM (SELECT *, row_number() OVER
     (PARTITION BY debut_decade ORDER BY decade_score DESC, artist, track) AS rk FROM scored) WHERE rk <= 5),
years AS (SELECT artist, track, debut_decade,
     CASE WHEN least(100, 80 + p_size) >= 90 THEN 1945 + p_size END AS release_year,
     least(100, 80 + p_size) AS mb_score FROM work)"""


def scored_gems(t):
    found = materialize(plan.gems(t.stats, songs(t), CUT))
    dated = lookup_join(
        found.select("artist", "track", "plays_per_listener", "listeners"),
        t.part_debuts,
        ["artist", "track"],
        "inner",
    )
    return plan.decade_scores(materialize(dated))


@query(
    "decade_scores",
    with_sql(
        "chart stats",
        "SELECT artist, track, plays_per_listener, listeners, debut_decade, decade_score FROM scored",
        stages(GEM_STAGES, SCORED),
    ),
)
def decade_scores(t):
    return scored_gems(t)


def resolved(t):
    return plan.resolve_years(plan.decade_worklist(scored_gems(t), 5), t.part_recordings)


@query(
    "decade_build",
    with_sql(
        "chart stats",
        """SELECT artist, track, debut_decade, release_year,
        CASE WHEN release_year IS NULL THEN '' ELSE substr(cast(release_year AS varchar), 1, 3) || '0s' END AS release_decade,
        mb_score, CASE WHEN release_year IS NULL THEN 0 ELSE 1 END AS matched,
        coalesce(substr(cast(release_year AS varchar), 1, 3) || '0s', debut_decade) AS decade FROM years""",
        stages(GEM_STAGES, SCORED),
    ),
)
def decade_build(t):
    return resolved(t)


@query(
    "release_years_csv",
    with_sql(
        "chart stats",
        """SELECT artist, track, debut_decade, release_year,
        coalesce(left(cast(release_year AS varchar), 3) || '0s', '') AS release_decade, mb_score,
        cast(release_year IS NOT NULL AS int) AS matched FROM years""",
        stages(GEM_STAGES, SCORED),
    ),
)
def release_years_csv(t):
    """The resolved years as a dated CSV, read back under its contract; no year is a blank."""
    rows = resolved(t).select(*files.RELEASE_YEARS.names)
    path = files.write_dated_csv(rows, scratch_path(t.spark, "years"), "2026-07-20")
    return files.read_csv_contract(t.spark, path, files.RELEASE_YEARS).good


@query(
    "decade_match_report",
    with_sql(
        "chart stats",
        """SELECT *, round_even(matched * 100::double / total, 0) AS pct FROM (
        SELECT debut_decade, count(release_year) AS matched, count(*) AS total FROM years GROUP BY 1
        UNION ALL SELECT 'all', count(release_year), count(*) FROM years)""",
        stages(GEM_STAGES, SCORED),
    ),
)
def decade_match_report(t):
    return plan.decade_match_report(resolved(t))
