"""Counts, distributions, cutoffs and rosters."""

from pyspark.sql import functions as F

from linkrank.catalog.filters import roster as known_roster, songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import (
    GEM_STAGES,
    RAW_GEM_STAGES,
    SONG_STAGES,
    SONGS,
    TOP,
    TOP_STAGES,
    ladder,
    roster,
)
from linkrank.functions.keys import primary_entity
from linkrank.functions.text import contains_ci, decade_ladder, decade_of_date, has_any_marker, ratio
from linkrank.operators import aggregates as ag
from linkrank.operators import joins as jn
from linkrank.operators.quantiles import exact_quantiles
from linkrank.operators.rank import top_k, top_n_per_group
from linkrank.operators.review import with_track_keys
from linkrank.plans import gems as plan
from linkrank.runtime import materialize
from linkrank.sources.replies import release_years
from linkrank.sources.standins import with_sql

# The roster spans few artists with many songs each, so the strict cutoffs are high.
ROSTER_CUTOFFS = (3, 20, 25)


@query("count_all", with_sql("chart", "SELECT count(*) AS total_rows FROM chart"))
def count_all(t):
    return t.chart.agg(F.count("*").alias("total_rows"))


@query(
    "coverage_range",
    with_sql(
        "chart",
        """SELECT count(DISTINCT chart_week) AS weeks, min(chart_week) AS first_week,
        max(chart_week) AS last_week FROM chart""",
    ),
)
def coverage_range(t):
    return ag.coverage(t.chart)


@query(
    "completeness_check",
    with_sql(
        "chart",
        """SELECT sum(n)::bigint AS actual_rows, count(*) * max(n) AS expected_rows,
        count_if(n <> fullest)::bigint AS uneven_groups
        FROM (SELECT *, max(n) OVER () AS fullest FROM (SELECT chart_week, count(*) AS n FROM chart GROUP BY 1))""",
    ),
)
def completeness_check(t):
    return ag.completeness(t.chart, "chart_week")


PER_CREDIT = "SELECT performer, count(DISTINCT title) AS songs_charted FROM chart"


@query(
    "top_entities",
    with_sql("chart", f"{PER_CREDIT} GROUP BY 1 ORDER BY songs_charted DESC, performer LIMIT 25"),
)
def top_entities(t):
    return top_k(ag.titles_per_credit(t.chart), [F.desc("songs_charted"), F.asc("performer")], 25)


@query("entity_variants", with_sql("chart", f"{PER_CREDIT} WHERE performer ILIKE '%brand#2%' GROUP BY 1"))
def entity_variants(t):
    return ag.credit_variants(t.chart, "brand#2")


@query(
    "joiner_counts",
    with_sql(
        "chart",
        """SELECT count(*) AS total, count_if(performer ILIKE '% Featuring %')::bigint AS featuring_credits,
        count_if(performer ILIKE '% With %')::bigint AS with_credits,
        count_if(performer ILIKE '% & %')::bigint AS amp_credits FROM (SELECT DISTINCT performer FROM chart)""",
    ),
)
def joiner_counts(t):
    joiners = {"featuring_credits": " Featuring ", "with_credits": " With ", "amp_credits": " & "}
    return ag.pattern_counts(t.chart.select("performer").distinct(), "performer", joiners)


@query(
    "ambiguous_joiner_top",
    with_sql(
        "chart",
        f"{PER_CREDIT} WHERE performer ILIKE '% & %' GROUP BY 1 ORDER BY songs_charted DESC, performer LIMIT 25",
    ),
)
def ambiguous_joiner_top(t):
    return top_k(ag.credit_variants(t.chart, " & "), [F.desc("songs_charted"), F.asc("performer")], 25)


@query(
    "song_grain",
    with_sql("chart", "SELECT primary_artist, title, performer, best_peak, total_weeks FROM songs", SONGS),
)
def song_grain(t):
    return songs(t)


@query(
    "build_counts",
    with_sql("chart", "SELECT count(*) AS songs, count(DISTINCT primary_artist) AS artists FROM songs", SONGS),
)
def build_counts(t):
    return songs(t).agg(F.count("*").alias("songs"), F.countDistinct("primary_artist").alias("artists"))


SIZES = "(SELECT primary_artist, count(*) AS songs_charted FROM songs GROUP BY 1)"


@query(
    "count_histogram",
    with_sql(
        "chart",
        f"""SELECT songs_charted, count(*) AS artists_with_this_many FROM {SIZES} GROUP BY 1
        ORDER BY songs_charted LIMIT 20""",
        SONGS,
    ),
)
def count_histogram(t):
    histogram = ag.count_histogram(ag.entity_sizes(songs(t)), "songs_charted", "artists_with_this_many")
    return histogram.orderBy("songs_charted").limit(20)


@query(
    "threshold_survivors",
    with_sql(
        "chart",
        f"""SELECT count_if(songs_charted >= 3)::bigint AS at_least_3, count_if(songs_charted >= 5)::bigint AS at_least_5,
        count_if(songs_charted >= 10)::bigint AS at_least_10 FROM {SIZES}""",
        SONGS,
    ),
)
def threshold_survivors(t):
    cutoffs = {"at_least_3": 3, "at_least_5": 5, "at_least_10": 10}
    return ag.survivors(ag.entity_sizes(songs(t)), "songs_charted", cutoffs)


@query(
    "entity_roster",
    with_sql("chart", "SELECT primary_artist, songs_charted, career_peak FROM known_artists", SONG_STAGES),
)
def entity_roster(t):
    return known_roster(t)


@query(
    "case_twins",
    with_sql(
        "chart",
        """SELECT lower(primary_artist) AS artist_lower, count(*) AS roster_rows
        FROM known_artists GROUP BY 1 HAVING count(*) > 1""",
        SONG_STAGES,
    ),
)
def case_twins(t):
    return ag.case_twins(known_roster(t))


@query(
    "value_bands",
    with_sql(
        "stats",
        """SELECT min(listeners) AS smallest, max(listeners) AS biggest,
        count_if(listeners < 10)::bigint AS under_10, count_if(listeners >= 10 AND listeners < 14)::bigint AS band_10_14,
        count_if(listeners >= 14 AND listeners < 18)::bigint AS band_14_18,
        count_if(listeners >= 18)::bigint AS band_18_plus FROM stats""",
    ),
)
def value_bands(t):
    names = ["under_10", "band_10_14", "band_14_18", "band_18_plus"]
    ends = [F.min("listeners").alias("smallest"), F.max("listeners").alias("biggest")]
    return ag.bands(t.stats, "listeners", [10, 14, 18], names, *ends)


@query(
    "ratio_bands",
    with_sql(
        "stats",
        f"""SELECT count_if(r < 22)::bigint AS under_22, count_if(r >= 22 AND r < 24)::bigint AS band_22_24,
        count_if(r >= 24 AND r < 26)::bigint AS band_24_26, count_if(r >= 26)::bigint AS band_26_plus,
        count(*) AS floor_passing
        FROM (SELECT playcount::double / nullif(listeners, 0) AS r FROM stats WHERE listeners >= {CUT.min_listeners})""",
    ),
)
def ratio_bands(t):
    above = t.stats.where(F.col("listeners") >= CUT.min_listeners).withColumn(
        "r", ratio(F.col("playcount"), F.col("listeners"))
    )
    names = ["under_22", "band_22_24", "band_24_26", "band_26_plus"]
    return ag.bands(above, "r", [22, 24, 26], names, F.count("*").alias("floor_passing"))


@query(
    "pattern_share",
    with_sql(
        "stats",
        """SELECT count(*) AS total, count_if(track LIKE '%(%')::bigint AS tracks_with_parens,
        count_if(track ILIKE '%(feat.%')::bigint AS feat_tails,
        count_if(track ILIKE '%(with %')::bigint AS with_tails FROM stats""",
    ),
)
def pattern_share(t):
    patterns = {"tracks_with_parens": "(", "feat_tails": "(feat.", "with_tails": "(with "}
    return ag.pattern_counts(t.stats, "track", patterns)


@query(
    "collapse_variants",
    with_sql(
        "chart stats",
        """SELECT artist_key, title_key, min(artist) AS artist, min(track) AS track, max(listeners) AS listeners,
        max(playcount) AS playcount, max(plays_per_listener) AS plays_per_listener FROM devoted GROUP BY 1, 2""",
        GEM_STAGES,
    ),
)
def collapse_variants(t):
    return plan.collapse(plan.devoted(t.stats, CUT), CUT).drop("tier")


@query(
    "tier_counts",
    with_sql("chart stats", "SELECT tier, count(*) AS gem_count FROM gems GROUP BY 1", GEM_STAGES),
)
def tier_counts(t):
    return plan.gems(t.stats, songs(t), CUT).groupBy("tier").agg(F.count("*").alias("gem_count")).orderBy(
        F.desc("gem_count"), "tier"
    )


@query(
    "roster_verify",
    with_sql(
        "chart stats",
        "SELECT count(*) AS roster_rows, count(DISTINCT lower(artist)) AS distinct_artists FROM top_gems",
        TOP_STAGES,
    ),
)
def roster_verify(t):
    known = materialize(songs(t))
    top = plan.top_gems(plan.gems(t.stats, known, CUT), ag.known_artists(known, CUT.min_songs), CUT)
    return top.agg(
        F.count("*").alias("roster_rows"), F.countDistinct(F.lower("artist")).alias("distinct_artists")
    )


@query(
    "first_last_seen",
    with_sql(
        "chart",
        f"""SELECT {ladder('performer')} AS primary_artist, min(chart_week) AS first_chart,
        max(chart_week) AS last_chart FROM chart GROUP BY 1""",
    ),
)
def first_last_seen(t):
    return plan.first_last_seen(t.chart, CUT)


@query(
    "group_dedup",
    """SELECT artist, title_key, track FROM (SELECT artist, lower(track) AS title_key, min(track) AS track
    FROM (SELECT source AS artist, unnest(string_split(text, chr(10))) AS track FROM documents) GROUP BY 1, 2)""",
)
def group_dedup(t):
    """One row per key: copies beyond the first are cut in each task, before the shuffle."""
    keyed = with_track_keys(t.lines, 0).select("artist", "title_key", "track")
    return top_n_per_group(keyed, ["artist", "title_key"], [F.asc("track")], 1)


@query(
    "variant_counts",
    with_sql(
        "chart stats",
        """SELECT count_if(lower(track) LIKE '%remix%')::bigint AS remixes,
        count_if(regexp_matches(lower(track), 'instrumental|[(]inst'))::bigint AS instrumentals,
        count_if(regexp_matches(lower(track), 'sped up|slowed'))::bigint AS speed_variants,
        count_if(lower(track) LIKE '%version%' OR lower(track) LIKE '% ver.%')::bigint AS versions,
        count_if(lower(track) LIKE '% live%' OR lower(track) LIKE '%(live%')::bigint AS live_cuts,
        count(*) AS hidden_tier_total FROM gems WHERE tier = 'hidden gem'""",
        RAW_GEM_STAGES,
    ),
)
def variant_counts(t):
    hidden = plan.gems(t.stats, songs(t), CUT, drop_variants=False).where(F.col("tier") == "hidden gem")
    kinds = {
        "remixes": ("remix",),
        "instrumentals": ("instrumental", "(inst"),
        "speed_variants": ("sped up", "slowed"),
        "versions": ("version", " ver."),
        "live_cuts": (" live", "(live"),
    }
    return hidden.agg(
        *[F.count_if(has_any_marker(F.col("track"), marks)).alias(name) for name, marks in kinds.items()],
        F.count("*").alias("hidden_tier_total"),
    )


@query(
    "group_match_rate",
    """WITH r AS (SELECT cast(year(o_orderdate) AS varchar) AS order_year,
        CASE WHEN o_orderpriority <> '5-LOW' AND (floor(o_totalprice / 5000) >= 90
             OR o_orderpriority = '1-URGENT') THEN 1 ELSE 0 END AS m FROM orders),
    g AS (SELECT order_year, sum(m)::bigint AS matched, count(*) AS total FROM r GROUP BY 1
          UNION ALL SELECT 'all', sum(m)::bigint, count(*) FROM r)
    SELECT *, round_even(matched * 100::double / total, 0) AS pct FROM g""",
)
def group_match_rate(t):
    return ag.group_match_rate(release_years(t.recordings_replies), "order_year")


@query(
    "measured_cutoffs",
    with_sql(
        "stats",
        " UNION ALL ".join(
            f"""SELECT artist, {share}::double AS share, count(*) AS rows,
            percentile_disc({share}) WITHIN GROUP (ORDER BY listeners) AS value FROM stats GROUP BY artist"""
            for share in (0.5, 0.9, 0.99)
        ),
    ),
)
def measured_cutoffs(t):
    """The 50th, 90th and 99th percentile of listeners by artist: what a cutoff would keep."""
    return exact_quantiles(t.stats, ["artist"], "listeners", [0.5, 0.9, 0.99])


# Questions the documents leave to the reader.


@query(
    "roster_cutoff_compare",
    with_sql(
        "chart stats",
        " UNION ALL ".join(
            f"""(WITH {roster(n).strip()}, {TOP.strip()} SELECT *, {n} AS min_songs FROM top_gems)"""
            for n in ROSTER_CUTOFFS
        ),
        GEM_STAGES,
    ),
)
def roster_cutoff_compare(t):
    """The final list under a looser and two stricter meanings of "known"."""
    grain = materialize(songs(t))
    found = materialize(plan.gems(t.stats, grain, CUT))
    return plan.rosters_compared(found, grain, CUT, ROSTER_CUTOFFS)


@query(
    "roster_cutoff_sizes",
    with_sql(
        "chart",
        f"""SELECT cutoff, count(*) AS roster_size, min(career_peak) AS best_peak, sum(songs_charted)::bigint AS songs
        FROM (SELECT primary_artist, count(*) AS songs_charted, min(best_peak) AS career_peak FROM songs GROUP BY 1)
        JOIN (VALUES (3), (5), (10)) v(cutoff) ON songs_charted >= cutoff GROUP BY 1""",
        SONGS,
    ),
)
def roster_cutoff_sizes(t):
    """Roster at 3+, 5+ and 10+ songs: each artist counts towards every cutoff it passes."""
    passed = F.filter(F.array(F.lit(3), F.lit(5), F.lit(10)), lambda c: F.col("songs_charted") >= c)
    return (
        ag.entity_sizes(songs(t))
        .select("songs_charted", "career_peak", F.explode(passed).alias("cutoff"))
        .groupBy("cutoff")
        .agg(
            F.count("*").alias("roster_size"),
            F.min("career_peak").alias("best_peak"),
            F.sum("songs_charted").alias("songs"),
        )
    )


@query(
    "decade_visitors",
    with_sql(
        "chart",
        """SELECT CASE WHEN chart_week >= '2020' THEN '2020s' WHEN chart_week >= '2010' THEN '2010s'
        WHEN chart_week >= '2000' THEN '2000s' WHEN chart_week >= '1990' THEN '1990s' ELSE 'earlier' END AS decade,
        count_if(weeks = 1)::bigint AS one_week_visitors, count_if(weeks >= 30)::bigint AS long_haul
        FROM (SELECT performer, title, min(chart_week) AS chart_week, max(wks_on_chart) AS weeks
              FROM chart GROUP BY 1, 2) GROUP BY 1""",
    ),
)
def decade_visitors(t):
    items = jn.one_row_per_key(
        t.chart,
        ["performer", "title"],
        F.min("chart_week").alias("chart_week"),
        F.max("wks_on_chart").alias("weeks"),
    )
    return items.groupBy(decade_ladder(F.col("chart_week"), first=1990).alias("decade")).agg(
        F.count_if(F.col("weeks") == 1).alias("one_week_visitors"),
        F.count_if(F.col("weeks") >= 30).alias("long_haul"),
    )


@query(
    "one_hit_wonders",
    with_sql(
        "chart",
        """SELECT primary_artist, min(best_peak) AS career_peak FROM songs GROUP BY 1
        HAVING count(*) = 1 AND min(best_peak) <= 10""",
        SONGS,
    ),
)
def one_hit_wonders(t):
    sizes = ag.entity_sizes(songs(t))
    return sizes.where((F.col("songs_charted") == 1) & (F.col("career_peak") <= 10)).drop("songs_charted")


@query(
    "grind_list",
    with_sql(
        "chart",
        """SELECT primary_artist, title, best_peak, total_weeks FROM songs WHERE best_peak > 1
        ORDER BY total_weeks DESC, primary_artist, title LIMIT 25""",
        SONGS,
    ),
)
def grind_list(t):
    order = [F.desc("total_weeks"), F.asc("primary_artist"), F.asc("title")]
    return top_k(songs(t).where(F.col("best_peak") > 1), order, 25).drop("performer")


@query(
    "career_arc",
    with_sql(
        "chart",
        f"""SELECT substr(chart_week, 1, 3) || '0s' AS decade, count(DISTINCT title) AS songs_charted FROM chart
        WHERE lower({ladder('performer')}) = 'brand#2' GROUP BY 1""",
    ),
)
def career_arc(t):
    one = t.chart.where(F.lower(primary_entity(F.col("performer"))) == "brand#2")
    return one.groupBy(decade_of_date(F.col("chart_week")).alias("decade")).agg(
        F.countDistinct("title").alias("songs_charted")
    )


@query(
    "collab_rate_by_decade",
    with_sql(
        "chart",
        """SELECT decade, count(*) AS credits, count_if(performer ILIKE '% Featuring %')::bigint AS featuring,
        count_if(performer ILIKE '% Featuring %') * 100::double / count(*) AS featuring_pct
        FROM (SELECT DISTINCT substr(chart_week, 1, 3) || '0s' AS decade, performer FROM chart) GROUP BY 1""",
    ),
)
def collab_rate_by_decade(t):
    credits = t.chart.select(decade_of_date(F.col("chart_week")).alias("decade"), "performer").distinct()
    featuring = F.count_if(contains_ci(F.col("performer"), " Featuring "))
    return credits.groupBy("decade").agg(
        F.count("*").alias("credits"),
        featuring.alias("featuring"),
        (featuring * F.lit(100.0) / F.count("*")).alias("featuring_pct"),
    )


@query(
    "top_tail_share",
    with_sql(
        "chart",
        f"""SELECT count(*) AS artists, count_if(songs_charted = 1)::bigint AS seen_once,
        round(count_if(songs_charted = 1) * 100::double / count(*), 1) AS seen_once_pct FROM {SIZES}""",
        SONGS,
    ),
)
def top_tail_share(t):
    once = F.count_if(F.col("songs_charted") == 1)
    return ag.entity_sizes(songs(t)).agg(
        F.count("*").alias("artists"),
        once.alias("seen_once"),
        F.round(F.try_divide(once * F.lit(100.0), F.count("*")), 1).alias("seen_once_pct"),
    )
