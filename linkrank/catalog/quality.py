"""Profiles and data-quality reports."""

import datetime as dt

from pyspark.sql import functions as F

from linkrank.catalog.filters import songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import SONG_STAGES, TOP_STAGES
from linkrank.functions.text import has_nondigit
from linkrank.operators import aggregates as ag
from linkrank.operators import profile as pf
from linkrank.plans import gems as plan
from linkrank.runtime import materialize
from linkrank.sources.standins import with_sql

CHART_COLUMNS = ["chart_week", "current_week", "title", "performer", "last_week", "peak_pos", "wks_on_chart"]


def profile_sql(table: str, columns) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count_if(v IS NULL)::bigint AS null_count,
        count_if(v = '')::bigint AS blank_count, count(DISTINCT v) AS distinct_count, min(v) AS min_value,
        max(v) AS max_value, count_if(regexp_matches(v, '[^0-9]'))::bigint AS nondigit_count
        FROM (SELECT cast({c} AS varchar) AS v FROM {table})"""
        for c in columns
    )


@query("profile_table", with_sql("chart", profile_sql("chart", CHART_COLUMNS)))
def profile_table(t):
    return pf.profile_table(t.chart)


@query("profile_table_wide", profile_sql("documents", ["doc_id", "text", "lang", "source", "n_chars"]))
def profile_table_wide(t):
    return pf.profile_table(t.table("documents"), ["doc_id", "text", "lang", "source", "n_chars"])


LINE_COLUMNS = ["l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_linestatus"]


@query(
    "profile_of_snapshots",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count_if({c} IS NULL)::bigint AS null_count,
        count(DISTINCT {c}) AS distinct_count, true AS within_bound FROM lineitem"""
        for c in LINE_COLUMNS
    ),
)
def profile_of_snapshots(t):
    """Yearly snapshots profiled one by one and merged without a rescan: the estimate of distinct
    values must be within four times its average error of the exact number, which is shown."""
    lines = t.table("lineitem").select(*LINE_COLUMNS)
    years = lines.groupBy(F.year("l_shipdate").alias("y")).agg(F.lit(1)).select("y").collect()  # a few years
    stored = None
    for row in years:
        one = materialize(pf.profile_sketches(lines.where(F.year("l_shipdate").eqNullSafe(F.lit(row["y"])))))
        stored = one if stored is None else stored.unionByName(one)
    exact = pf.profile_table(lines).select("column_name", F.col("distinct_count").alias("exact"))
    off = F.abs(F.col("distinct_count") - F.col("exact")) / F.greatest(F.col("exact"), F.lit(1))
    bound = 4 * 1.04 / (1 << pf.SKETCH_SIZE) ** 0.5
    found = pf.merged_profile(stored).join(exact, "column_name")
    return found.select("column_name", "row_count", "null_count", F.col("exact").alias("distinct_count"), (off <= bound).alias("within_bound"))


@query(
    "profile_table_approx",
    " UNION ALL ".join(
        f"""SELECT '{c}' AS column_name, count(*) AS row_count, count_if({c} IS NULL)::bigint AS null_count,
        count_if(cast({c} AS varchar) = '')::bigint AS blank_count, min(cast({c} AS varchar)) AS min_value,
        max(cast({c} AS varchar)) AS max_value, true AS within_bound FROM documents"""
        for c in ("doc_id", "lang", "source", "text", "n_chars")
    ),
)
def profile_table_approx(t):
    """One pass, no shuffle of values; the sketched number of distinct values must be within four
    times its average error of 5 percent."""
    docs = t.table("documents").select("doc_id", "lang", "source", "text", "n_chars")
    exact = pf.profile_table(docs).select("column_name", F.col("distinct_count").alias("exact"))
    off = F.abs(F.col("distinct_count") - F.col("exact")) / F.greatest(F.col("exact"), F.lit(1))
    found = pf.profile_table_approx(docs).join(exact, "column_name")
    columns = ["column_name", "row_count", "null_count", "blank_count", "min_value", "max_value"]
    return found.select(*columns, (off <= 0.2).alias("within_bound"))


@query(
    "oddity_counts",
    with_sql(
        "chart",
        """SELECT count(*) AS total_rows, count_if(last_week = 'NA')::bigint AS na_last_week,
        count_if(last_week = '0')::bigint AS zero_last_week,
        count_if(regexp_matches(peak_pos, '[^0-9]'))::bigint AS weird_peak_pos FROM chart""",
    ),
)
def oddity_counts(t):
    return pf.oddity_counts(
        t.chart,
        {
            "na_last_week": F.col("last_week") == "NA",
            "zero_last_week": F.col("last_week") == "0",
            "weird_peak_pos": has_nondigit(F.col("peak_pos")),
        },
    )


@query(
    "missing_markers",
    with_sql(
        "chart details",
        """SELECT column_name, marker, count(*) AS marked_rows FROM (
            SELECT 'last_week' AS column_name, last_week AS marker FROM chart
            UNION ALL SELECT 'peak_pos', peak_pos FROM chart) WHERE marker IN ('NA', '0', '') GROUP BY 1, 2""",
    ),
)
def missing_markers(t):
    return pf.missing_markers(t.chart, ["last_week", "peak_pos"])


@query(
    "legal_range",
    """SELECT count(*) AS total_rows, count_if(l_quantity < 1 OR l_quantity > 49)::bigint AS l_quantity_outside,
    count_if(l_discount < 0 OR l_discount > 0.05)::bigint AS l_discount_outside,
    count_if(l_shipdate < TIMESTAMP '1995-01-01' OR l_shipdate > TIMESTAMP '2001-06-30')::bigint AS l_shipdate_outside
    FROM lineitem""",
)
def legal_range(t):
    """Future dates count as outside the range of dates."""
    lines = t.table("lineitem").withColumn("l_shipdate", F.col("l_shipdate").cast("date"))
    return pf.legal_range(
        lines,
        {
            "l_quantity": (1, 49),
            "l_discount": (0, 0.05),
            "l_shipdate": (dt.date(1995, 1, 1), dt.date(2001, 6, 30)),
        },
    )


@query(
    "expected_vs_actual",
    with_sql(
        "chart",
        """SELECT count(*) AS actual_rows, (date_diff('day', min(cast(chart_week AS date)),
        max(cast(chart_week AS date))) // 7 + 1) * max(current_week) AS expected_rows FROM chart""",
    ),
)
def expected_vs_actual(t):
    """Rows against weeks in the covered span times the most positions of a week."""
    day = F.col("chart_week").cast("date")
    weeks = F.floor(F.date_diff(F.max(day), F.min(day)) / 7) + 1
    return t.chart.agg(F.count("*").alias("actual_rows"), (weeks * F.max("current_week")).alias("expected_rows"))


@query(
    "dq_six_dimensions",
    with_sql(
        "chart",
        """SELECT dimension, failures::bigint AS failures, failures = 0 AS passed FROM (
        SELECT 'completeness' AS dimension, count_if(title = '' OR performer = '')
            + abs(count(*) - count(DISTINCT chart_week) * max(current_week)) AS failures FROM chart
        UNION ALL SELECT 'validity', count_if(regexp_matches(peak_pos, '[^0-9]')) FROM chart
        UNION ALL SELECT 'consistency', count_if((last_week = 'NA') <> (wks_on_chart = 1)) FROM chart
        UNION ALL SELECT 'uniqueness', count(*) - count(DISTINCT (chart_week, current_week)) FROM chart
        UNION ALL SELECT 'accuracy', count_if(try_cast(peak_pos AS int) > current_week) FROM chart
        UNION ALL SELECT 'timeliness', CASE WHEN max(chart_week) < (SELECT cast(cast(date_trunc('week', max(l_shipdate)) AS date) AS varchar)
            FROM lineitem) THEN 1 ELSE 0 END FROM chart)""",
    ),
)
def dq_six_dimensions(t):
    """Complete: every week as long as the longest. Timely: up to the week of the last sale."""
    chart = materialize(t.chart)
    expected = chart.agg((F.countDistinct("chart_week") * F.max("current_week")).alias("n"))
    newest = t.table("lineitem").agg(F.trunc(F.max("l_shipdate").cast("date"), "week").cast("string").alias("w"))
    return pf.six_dimensions(
        chart,
        expected_rows=expected.scalar(),
        blank=(F.col("title") == "") | (F.col("performer") == ""),
        invalid=has_nondigit(F.col("peak_pos")),
        inconsistent=(F.col("last_week") == "NA") != (F.col("wks_on_chart") == 1),
        identity=["chart_week", "current_week"],
        inaccurate=F.col("peak_pos").try_cast("int") > F.col("current_week"),
        date_col="chart_week",
        stale_before=newest.scalar(),
    )


@query(
    "shrink_ledger",
    with_sql(
        "chart stats",
        f"""SELECT 1 AS step, 'chart_entries' AS stage, count(*) AS row_count FROM chart
        UNION ALL SELECT 2, 'distinct_credits', count(DISTINCT performer) FROM chart
        UNION ALL SELECT 3, 'artist_songs', count(*) FROM songs
        UNION ALL SELECT 4, 'known_artists', count(*) FROM known_artists
        UNION ALL SELECT 5, 'tracks', count(*) FROM stats
        UNION ALL SELECT 6, 'devoted_tracks', count(*) FROM devoted
        UNION ALL SELECT 7, 'unmatched_collapsed', count(*) FROM (SELECT DISTINCT artist_key, title_key FROM devoted
            EXCEPT SELECT artist_key, title_key FROM song_keys)
        UNION ALL SELECT 8, 'gems', count(*) FROM gems
        UNION ALL SELECT 9, 'top_gems', count(*) FROM top_gems""",
        TOP_STAGES,
    ),
)
def shrink_ledger(t):
    """The chart is read three times, so it is stored with the columns that the stages read."""
    chart = t.chart.select("performer", "title", "peak_pos", "wks_on_chart")
    return plan.shrink_ledger(materialize(chart), materialize(t.stats), CUT)


@query(
    "checkpoint_agreement",
    with_sql(
        "chart",
        """SELECT (SELECT count(*) FROM known_artists) AS roster_rows,
        (SELECT count_if(n >= 5)::bigint FROM (SELECT count(*) AS n FROM songs GROUP BY primary_artist)) AS survivors,
        true AS agree""",
        SONG_STAGES,
    ),
)
def checkpoint_agreement(t):
    """The roster counted two ways must give one number."""
    grain = materialize(songs(t))
    roster = ag.known_artists(grain, CUT.min_songs).agg(F.count("*").alias("roster_rows"))
    counted = ag.survivors(ag.entity_sizes(grain), "songs_charted", {"survivors": CUT.min_songs})
    return roster.select("roster_rows", counted.scalar().alias("survivors")).withColumn(
        "agree", F.col("roster_rows") == F.col("survivors")
    )
