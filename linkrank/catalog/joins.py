"""Joins, match rates and the reports around them."""

from pyspark.sql import functions as F

from linkrank.catalog.filters import roster, songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import (
    GEM_STAGES,
    SONG_STAGES,
    SONGS,
    devoted,
    ladder,
    song_keys,
    stages,
)
from linkrank.functions.text import contains_ci
from linkrank.operators import joins as jn
from linkrank.operators.rank import top_k
from linkrank.operators.review import KEYS, with_song_keys
from linkrank.plans import gems as plan
from linkrank.runtime import materialize
from linkrank.sources.files import store_by_key
from linkrank.sources.standins import with_sql

LINK = stages(SONGS, song_keys(), devoted())
ROWS_PER_BUCKET = 1_000_000
TRACK_COLUMNS = ["artist", "track", "listeners", "plays_per_listener"]


def devoted_table(t):
    """The devoted tracks as a stored table: row-level joins read it more than once."""
    return materialize(plan.devoted(t.stats, CUT))


def keyed_songs(t):
    return with_song_keys(songs(t), CUT.key_level)


@query(
    "left_join_compound",
    with_sql(
        "chart stats",
        """SELECT t.artist, t.track, t.artist_key, t.title_key, s.title, s.partners FROM devoted t
        LEFT JOIN (SELECT artist_key, title_key, min(title) AS title, count(*) AS partners
                   FROM song_keys GROUP BY 1, 2) s
        ON t.artist_key = s.artist_key AND t.title_key = s.title_key""",
        LINK,
    ),
)
def left_join_compound(t):
    partners = jn.one_row_per_key(
        keyed_songs(t), KEYS, F.min("title").alias("title"), F.count("*").alias("partners")
    )
    joined = jn.lookup_join(devoted_table(t), partners, KEYS, "left")
    return joined.select("artist", "track", *KEYS, "title", "partners")


@query(
    "match_rate",
    with_sql(
        "chart stats",
        """SELECT count(*) AS total, count(title) AS matched,
        round(count(title) * 100::double / count(*), 1) AS matched_pct
        FROM devoted LEFT JOIN song_keys USING (artist_key, title_key)""",
        LINK,
    ),
)
def match_rate(t):
    return jn.match_rate(plan.devoted(t.stats, CUT), keyed_songs(t), KEYS)


@query(
    "stored_keys_join",
    with_sql(
        "chart stats",
        """SELECT artist_key, title_key, tracks, songs FROM
        (SELECT artist_key, title_key, count(*) AS tracks FROM devoted GROUP BY ALL)
        LEFT JOIN (SELECT artist_key, title_key, count(*) AS songs FROM song_keys GROUP BY ALL)
        USING (artist_key, title_key)""",
        LINK,
    ),
)
def stored_keys_join(t):
    """Both sides stored by match key, one row each, and joined without a shuffle."""
    tracks = jn.one_row_per_key(plan.devoted(t.stats, CUT), KEYS, F.count("*").alias("tracks"))
    archive = jn.one_row_per_key(keyed_songs(t), KEYS, F.count("*").alias("songs"))
    run = t.spark.sparkContext.applicationId.replace("-", "_")
    tracks, archive = materialize(tracks), materialize(archive)
    buckets = max(2, -(-max(tracks.count(), archive.count()) // ROWS_PER_BUCKET))
    left = store_by_key(tracks, f"linkrank_track_keys_{run}", KEYS, buckets)
    right = store_by_key(archive, f"linkrank_song_keys_{run}", KEYS, buckets)
    return left.join(right, KEYS, "left")


UNMATCHED = """FROM (SELECT t.* FROM devoted t LEFT JOIN song_keys s
ON s.artist_key = t.artist_key AND s.title_key = t.title_key WHERE s.artist_key IS NULL)"""


@query("anti_join", with_sql("chart stats", f"SELECT artist, track, listeners, plays_per_listener {UNMATCHED}", LINK))
def anti_join(t):
    return jn.unmatched(devoted_table(t), keyed_songs(t), KEYS).select(*TRACK_COLUMNS)


@query(
    "anti_join_filtered",
    with_sql(
        "chart stats",
        f"""SELECT artist, track, listeners, n AS unmatched_with_dash FROM
        (SELECT artist, track, listeners, count(*) OVER () AS n {UNMATCHED} WHERE track LIKE '% - %')
        ORDER BY listeners DESC, artist, track LIMIT 20""",
        stages(SONGS, song_keys(1), devoted(1)),
    ),
)
def anti_join_filtered(t):
    """How many unmatched tracks hold a dash, next to the 20 with the widest reach."""
    cut = plan.Cutoffs(**{**CUT.__dict__, "key_level": 1})
    tracks = plan.devoted(t.stats, cut).where(contains_ci(F.col("track"), " - "))
    found = materialize(jn.unmatched(materialize(tracks), with_song_keys(songs(t), 1), KEYS))
    total = found.agg(F.count("*").alias("unmatched_with_dash"))
    best = top_k(found, [F.desc("listeners"), F.asc("artist"), F.asc("track")], 20)
    return best.select("artist", "track", "listeners", total.scalar().alias("unmatched_with_dash"))


@query(
    "inner_join_ci",
    with_sql(
        "chart details",
        """SELECT d.artist, d.track, k.career_peak FROM details d
        JOIN (SELECT lower(primary_artist) AS artist_lower, min(career_peak) AS career_peak
              FROM known_artists GROUP BY 1) k ON k.artist_lower = lower(d.artist)""",
        SONG_STAGES,
    ),
)
def inner_join_ci(t):
    known = jn.one_row_per_key(
        roster(t).withColumn("artist_lower", F.lower("primary_artist")),
        ["artist_lower"],
        F.min("career_peak").alias("career_peak"),
    )
    items = t.details.select("artist", "track", F.lower("artist").alias("artist_lower"))
    return jn.lookup_join(items, known, ["artist_lower"], "inner").drop("artist_lower")


@query(
    "inner_join_mapping",
    with_sql(
        "chart",
        """SELECT c.chart_week, c.current_week, m.lead_artist FROM chart c
        JOIN (SELECT performer, min(primary_artist) AS lead_artist FROM songs GROUP BY 1) m
        ON c.performer = m.performer""",
        SONGS,
    ),
)
def inner_join_mapping(t):
    mapping = jn.one_row_per_key(songs(t), ["performer"], F.min("primary_artist").alias("lead_artist"))
    entries = t.chart.select("chart_week", "current_week", "performer")
    return jn.lookup_join(entries, mapping, ["performer"], "inner").drop("performer")


@query(
    "left_join_exact2",
    with_sql(
        "stats details",
        """SELECT s.artist, s.track, s.listeners, d.album, d.duration_ms FROM
        (SELECT artist, track, max(listeners) AS listeners FROM stats GROUP BY 1, 2) s
        LEFT JOIN details d ON s.artist = d.artist AND s.track = d.track""",
    ),
)
def left_join_exact2(t):
    tracks = jn.one_row_per_key(t.stats, ["artist", "track"], F.max("listeners").alias("listeners"))
    return tracks.join(t.details.select("artist", "track", "album", "duration_ms"), ["artist", "track"], "left")


ERA = f"""
era AS (SELECT lower({ladder('performer')}) AS artist_lower, min(chart_week) AS first_chart,
        max(chart_week) AS last_chart FROM chart GROUP BY 1)"""


@query(
    "left_join_subquery",
    with_sql(
        "chart details",
        """SELECT d.artist, d.track, e.first_chart, e.last_chart FROM details d
        LEFT JOIN era e ON e.artist_lower = lower(d.artist)""",
        ERA,
    ),
)
def left_join_subquery(t):
    eras = jn.one_row_per_key(
        plan.first_last_seen(t.chart, CUT).withColumn("artist_lower", F.lower("primary_artist")),
        ["artist_lower"],
        F.min("first_chart").alias("first_chart"),
        F.max("last_chart").alias("last_chart"),
    )
    items = t.details.select("artist", "track", F.lower("artist").alias("artist_lower"))
    return jn.lookup_join(items, eras, ["artist_lower"], "left").drop("artist_lower")


@query(
    "multi_left_join",
    with_sql(
        "chart stats details",
        """SELECT g.artist, g.track, g.listeners, d.album, d.duration_ms, e.first_chart FROM gems g
        LEFT JOIN details d ON g.artist = d.artist AND g.track = d.track
        LEFT JOIN era e ON e.artist_lower = lower(g.artist)""",
        GEM_STAGES + ",\n" + ERA.strip(),
    ),
)
def multi_left_join(t):
    found = materialize(plan.gems(t.stats, songs(t), CUT))
    eras = jn.one_row_per_key(
        plan.first_last_seen(t.chart, CUT).withColumn("artist_lower", F.lower("primary_artist")),
        ["artist_lower"],
        F.min("first_chart").alias("first_chart"),
    )
    detailed = found.select("artist", "track", "listeners").join(
        t.details.select("artist", "track", "album", "duration_ms"), ["artist", "track"], "left"
    )
    keyed = detailed.withColumn("artist_lower", F.lower("artist"))
    return jn.lookup_join(materialize(keyed), eras, ["artist_lower"], "left").drop("artist_lower")


@query(
    "fanout_report",
    """SELECT (SELECT count(*) FROM customer) AS rows_before,
    (SELECT count(*) FROM customer LEFT JOIN orders ON c_custkey = o_custkey) AS rows_after,
    (SELECT count(*) FROM (SELECT o_custkey FROM orders JOIN customer ON c_custkey = o_custkey
                           GROUP BY 1 HAVING count(*) > 1)) AS fanning_keys""",
)
def fanout_report(t):
    return jn.fanout_report(
        t.table("customer").select("c_custkey"),
        t.table("orders").select(F.col("o_custkey").alias("c_custkey")),
        ["c_custkey"],
    )


@query(
    "fanning_keys",
    """SELECT c_custkey, n_left, n_right, n_left * (n_right - 1) AS extra_rows
    FROM (SELECT c_custkey, count(*) AS n_left FROM customer GROUP BY 1)
    JOIN (SELECT o_custkey AS c_custkey, count(*) AS n_right FROM orders GROUP BY 1) USING (c_custkey) WHERE n_right > 1""",
)
def fanning_keys(t):
    """Each duplicate key of the right side that makes the join grow."""
    return jn.fanning_keys(
        t.table("customer").select("c_custkey"),
        t.table("orders").select(F.col("o_custkey").alias("c_custkey")),
        ["c_custkey"],
    )


@query(
    "orphan_check",
    """SELECT count(*) AS orphan_rows, count(DISTINCT doc_id) AS orphan_keys
    FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)""",
)
def orphan_check(t):
    return jn.orphan_report(t.table("documents"), t.table("labels"), ["doc_id"])


@query(
    "full_outer_reconcile",
    with_sql(
        "snap_a snap_b",
        """SELECT coalesce(a.artist, b.artist) AS artist, coalesce(a.track, b.track) AS track,
        a.playcount AS a_value, b.playcount AS b_value,
        CASE WHEN b.track IS NULL THEN 'A only' WHEN a.track IS NULL THEN 'B only' ELSE 'both' END AS side
        FROM snap_a a FULL JOIN snap_b b ON a.artist = b.artist AND a.track = b.track""",
    ),
)
def full_outer_reconcile(t):
    return jn.reconcile(*t.snapshots, ["artist", "track"], "playcount")


@query(
    "right_join",
    """SELECT c_custkey, c_name, n_orders FROM
    (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) RIGHT JOIN customer ON o_custkey = c_custkey""",
)
def right_join(t):
    per_customer = t.table("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.count("*").alias("n_orders")
    )
    return per_customer.join(t.table("customer").select("c_custkey", "c_name"), "c_custkey", "right")


@query(
    "cross_join_grid",
    with_sql(
        "chart",
        """SELECT a.primary_artist, cast(w.week AS varchar) AS chart_week
        FROM known_artists a CROSS JOIN (SELECT unnest(generate_series(
            (SELECT min(cast(chart_week AS date)) FROM chart)::timestamp,
            (SELECT max(cast(chart_week AS date)) FROM chart)::timestamp, INTERVAL 7 DAY))::date AS week) w""",
        SONG_STAGES,
    ),
)
def cross_join_grid(t):
    """Every roster artist with every week: each row unfolds its own calendar."""
    span = t.chart.agg(
        F.sequence(
            F.min(F.col("chart_week").cast("date")),
            F.max(F.col("chart_week").cast("date")),
            F.make_dt_interval(F.lit(7)),
        ).alias("weeks")
    )
    return (
        roster(t)
        .select("primary_artist", F.explode(span.scalar()).alias("week"))
        .select("primary_artist", F.col("week").cast("string").alias("chart_week"))
    )


@query(
    "self_join",
    with_sql(
        "chart",
        """SELECT a.title, a.chart_week, a.current_week AS position, b.chart_week AS next_week,
        b.current_week AS next_position
        FROM chart a JOIN chart b ON a.title = b.title AND b.wks_on_chart = a.wks_on_chart + 1""",
    ),
)
def self_join(t):
    """Each entry next to the same title's next one; (title, visit) is unique on both sides."""
    a, b = t.chart.alias("a"), t.chart.alias("b")
    next_visit = F.col("b.wks_on_chart") == F.col("a.wks_on_chart") + 1
    return a.join(b, (F.col("a.title") == F.col("b.title")) & next_visit).select(
        "a.title",
        "a.chart_week",
        F.col("a.current_week").alias("position"),
        F.col("b.chart_week").alias("next_week"),
        F.col("b.current_week").alias("next_position"),
    )


@query(
    "on_vs_where",
    """SELECT 'on' AS variant, count(DISTINCT c_custkey) AS customers, count(o_orderkey) AS orders_paired
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'P'
    UNION ALL
    SELECT 'where', count(DISTINCT c_custkey), count(o_orderkey)
    FROM customer LEFT JOIN orders ON c_custkey = o_custkey WHERE o_orderstatus = 'P'""",
)
def on_vs_where(t):
    """The same test as part of the pairing rule and as a filter on the finished rows.

    Orders are counted per customer and status first; both variants join those counts.
    """
    customers = t.table("customer").select("c_custkey")
    counts = (
        t.table("orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
        .agg(F.count("*").alias("n"))
    )
    pending = F.col("o_orderstatus") == "P"
    variants = {
        "on": customers.join(counts.where(pending), "c_custkey", "left"),
        "where": customers.join(counts, "c_custkey", "left").where(pending),
    }
    rows = [
        df.agg(F.countDistinct("c_custkey").alias("customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("orders_paired"))
        .select(F.lit(name).alias("variant"), "customers", "orders_paired")
        for name, df in variants.items()
    ]
    return rows[0].unionByName(rows[1])


@query(
    "star_lookup",
    """SELECT r_name, c_mktsegment, count(*) AS orders,
    cast(sum(cast(round(o_totalprice * 100) AS bigint)) AS bigint) AS cents
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
    JOIN region ON n_regionkey = r_regionkey GROUP BY 1, 2""",
)
def star_lookup(t):
    """Facts are summed per customer before they meet the dimensions; nation and region
    have a fixed size (25 and 5 rows)."""
    facts = (
        t.table("orders")
        .groupBy(F.col("o_custkey").alias("c_custkey"))
        .agg(
            F.count("*").alias("n"),
            F.sum(F.floor(F.col("o_totalprice") * 100 + 0.5)).alias("cents"),
        )
    )
    places = t.table("nation").join(F.broadcast(t.table("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    return (
        facts.join(t.table("customer"), "c_custkey")
        .join(F.broadcast(places), F.col("c_nationkey") == F.col("n_nationkey"))
        .groupBy("r_name", "c_mktsegment")
        .agg(F.sum("n").alias("orders"), F.sum("cents").alias("cents"))
    )


@query(
    "one_to_many_lookup",
    "SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey",
)
def one_to_many_lookup(t):
    orders = t.table("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_totalprice")
    names = t.table("customer").select("c_custkey", "c_name")
    return jn.lookup_join(orders, names, ["c_custkey"], "inner").drop("c_custkey")
