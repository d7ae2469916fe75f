"""Projections, filters, predicates and subqueries."""

from pyspark.sql import functions as F

from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import RAW_GEM_STAGES, SONG_STAGES, SONGS, markers, text_list
from linkrank.functions.text import VARIANT_MARKERS, contains_ci, has_any_marker, ratio
from linkrank.operators import aggregates as ag
from linkrank.operators import profile as pf
from linkrank.operators import rank
from linkrank.plans import gems as plan
from linkrank.runtime import scratch_path
from linkrank.sources.files import VersionedTable, delete_counts
from linkrank.sources.standins import with_sql


def songs(t):
    return ag.song_grain(t.chart)


def roster(t):
    return ag.known_artists(songs(t), CUT.min_songs)


@query("peek", with_sql("chart", "SELECT * FROM chart ORDER BY chart_week, current_week LIMIT 20"))
def peek(t):
    return t.chart.orderBy("chart_week", "current_week").limit(20)


@query("project_alias", with_sql("stats", "SELECT artist AS owner, track AS item, listeners AS reach FROM stats"))
def project_alias(t):
    return t.stats.select(
        F.col("artist").alias("owner"), F.col("track").alias("item"), F.col("listeners").alias("reach")
    )


@query("count_blank", with_sql("details", "SELECT count(*) AS blank_rows FROM details WHERE tags = '' OR album = ''"))
def count_blank(t):
    return pf.count_blank(t.details, ["tags", "album"])


@query(
    "distinct_nondigit",
    with_sql(
        "chart",
        """SELECT DISTINCT last_week, peak_pos FROM chart
        WHERE regexp_matches(last_week, '[^0-9]') OR regexp_matches(peak_pos, '[^0-9]')""",
    ),
)
def distinct_nondigit(t):
    return pf.distinct_nondigit(t.chart, ["last_week", "peak_pos"])


@query(
    "roundtrip_cast_check",
    with_sql(
        "chart",
        """SELECT last_week, CASE WHEN try_cast(last_week AS int) IS NULL THEN 'not a number'
                  ELSE 'rewritten' END AS problem, count(*) AS rows_with_value
        FROM chart WHERE last_week IS NOT NULL
          AND coalesce(cast(try_cast(last_week AS int) AS varchar) <> last_week, true)
        GROUP BY 1, 2""",
    ),
)
def roundtrip_cast_check(t):
    return pf.roundtrip_cast_check(t.chart, "last_week")


@query("like_contains", with_sql("lines", "SELECT artist, track FROM lines WHERE track ILIKE '%THE%'"))
def like_contains(t):
    return t.lines.where(contains_ci(F.col("track"), "THE"))


@query(
    "lower_like_markers",
    with_sql("stats", f"SELECT artist, track FROM stats WHERE {markers(negate=False)}"),
)
def lower_like_markers(t):
    return t.stats.where(has_any_marker(F.col("track"))).select("artist", "track")


@query(
    "range_and_ratio",
    with_sql(
        "stats",
        f"""SELECT artist, track, playcount, listeners FROM stats WHERE listeners >= {CUT.min_listeners}
        AND playcount::double / nullif(listeners, 0) >= {CUT.min_ratio}""",
    ),
)
def range_and_ratio(t):
    enough = ratio(F.col("playcount"), F.col("listeners")) >= CUT.min_ratio
    return t.stats.where((F.col("listeners") >= CUT.min_listeners) & enough)


@query(
    "null_tests",
    with_sql(
        "details stats",
        """SELECT count_if(d.album IS NULL)::bigint AS without_details,
        count_if(d.album IS NOT NULL)::bigint AS with_details
        FROM stats s LEFT JOIN details d ON s.artist = d.artist AND s.track = d.track""",
    ),
)
def null_tests(t):
    return t.stats.join(t.details, ["artist", "track"], "left").agg(
        F.count_if(F.col("album").isNull()).alias("without_details"),
        F.count_if(F.col("album").isNotNull()).alias("with_details"),
    )


@query(
    "derived_table",
    with_sql(
        "chart",
        """SELECT m.primary_artist, count(*) AS credits
        FROM (SELECT DISTINCT performer, primary_artist FROM
              (SELECT performer, primary_artist FROM songs WHERE best_peak = 1)) m GROUP BY 1""",
        SONGS,
    ),
)
def derived_table(t):
    pairs = songs(t).where(F.col("best_peak") == 1).select("performer", "primary_artist").distinct()
    return pairs.groupBy("primary_artist").agg(F.count("*").alias("credits"))


@query("having_filter", with_sql("chart", "SELECT primary_artist, songs_charted FROM known_artists", SONG_STAGES))
def having_filter(t):
    return roster(t).select("primary_artist", "songs_charted")


@query(
    "rank_filter",
    """SELECT n_name, o_orderkey, cast(rk AS int) AS rk FROM (
        SELECT n_name, o_orderkey,
               row_number() OVER (PARTITION BY n_name ORDER BY o_totalprice DESC, o_orderkey) AS rk
        FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)
    WHERE rk <= 3""",
)
def rank_filter(t):
    """Best three orders of each customer first, so the joins meet few rows per key."""
    best = [F.desc("o_totalprice"), F.asc("o_orderkey")]
    mine = rank.top_n_per_group(
        t.table("orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice"),
        ["c_custkey"],
        best,
        3,
    )
    named = mine.join(t.table("customer").select("c_custkey", "c_nationkey"), "c_custkey").join(
        F.broadcast(t.table("nation")), F.col("c_nationkey") == F.col("n_nationkey")
    )
    return rank.top_n_per_group(named, ["n_name"], best, 3, rank="rk").select("n_name", "o_orderkey", "rk")


@query(
    "top40_filter",
    with_sql(
        "chart",
        f"SELECT primary_artist, songs_charted, career_peak FROM known_artists WHERE career_peak <= {CUT.worst_peak}",
        SONG_STAGES,
    ),
)
def top40_filter(t):
    return roster(t).where(F.col("career_peak") <= CUT.worst_peak)


@query(
    "chart_toppers_only",
    with_sql("chart", "SELECT * FROM known_artists WHERE career_peak = 1", SONG_STAGES),
)
def chart_toppers_only(t):
    return roster(t).where(F.col("career_peak") == 1)


@query(
    "delete_where",
    with_sql(
        "chart stats",
        f"""SELECT 'before' AS counted, count(*) AS row_count FROM gems
        UNION ALL SELECT 'after', count(*) FROM gems WHERE {markers()}
        UNION ALL SELECT m, count_if(contains(lower(track), m))::bigint
        FROM gems, (SELECT unnest({text_list(VARIANT_MARKERS)}) AS m) GROUP BY m""",
        RAW_GEM_STAGES,
    ),
)
def delete_where(t):
    """Rows before and after the delete, and the rows that each marker deletes."""
    found = plan.gems(t.stats, songs(t), CUT, drop_variants=False)
    return delete_counts(found, F.col("track"))


@query(
    "delete_rewrite",
    with_sql(
        "chart stats",
        f"""SELECT artist_key, title_key, artist, track, listeners, playcount, plays_per_listener, tier,
        (SELECT count(*) FROM gems) AS rows_before, (SELECT count(*) FROM gems WHERE {markers()}) AS rows_after
        FROM gems WHERE {markers()}""",
        RAW_GEM_STAGES,
    ),
)
def delete_rewrite(t):
    """The table after the delete, with the counts that went on record when it was rewritten."""
    found = plan.gems(t.stats, songs(t), CUT, drop_variants=False)
    table = VersionedTable(t.spark, scratch_path(t.spark, "gems"), found.schema)
    table.replace(found)
    rest = table.delete(has_any_marker(F.col("track")))
    last = table.history().where("version = 2").select(F.col("before").alias("rows_before"), F.col("after").alias("rows_after"))
    counts = last.first()
    return rest.withColumns({c: F.lit(counts[c]).cast("long") for c in last.columns})


@query(
    "portable_case_sum",
    with_sql(
        "chart",
        """SELECT sum(CASE WHEN last_week = 'NA' THEN 1 ELSE 0 END)::bigint AS na_rows,
        sum(CASE WHEN wks_on_chart = 1 THEN 1 ELSE 0 END)::bigint AS first_weeks FROM chart""",
    ),
)
def portable_case_sum(t):
    return t.chart.agg(
        F.sum(F.when(F.col("last_week") == "NA", 1).otherwise(0)).alias("na_rows"),
        F.sum(F.when(F.col("wks_on_chart") == 1, 1).otherwise(0)).alias("first_weeks"),
    )
