"""Sorts, top-k lists and set operations."""

from pyspark.sql import functions as F

from linkrank.catalog.filters import roster, songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import DEVOTION, EARLY_STAGES, GEM_STAGES, SONG_STAGES, SONGS
from linkrank.functions.keys import primary_entity
from linkrank.functions.text import contains_ci
from linkrank.operators.joins import reconcile
from linkrank.operators.rank import top_k
from linkrank.operators.review import KEYS
from linkrank.plans import gems as plan
from linkrank.plans import upkeep
from linkrank.sources.files import freeze
from linkrank.sources.standins import with_sql

COLUMNS = ["artist", "track", "listeners", "plays_per_listener"]
SELECT = "SELECT artist, track, listeners, plays_per_listener FROM gems"


def reach():
    return [F.desc("listeners"), F.asc("artist"), F.asc("track")]


def found(t):
    return plan.gems(t.stats, songs(t), CUT)


@query("order_single", with_sql("chart", "SELECT DISTINCT performer FROM chart ORDER BY performer"))
def order_single(t):
    return t.chart.select("performer").distinct().orderBy("performer")


@query("order_multi", with_sql("chart stats", f"{SELECT} ORDER BY {DEVOTION}", GEM_STAGES))
def order_multi(t):
    return found(t).select(*COLUMNS).orderBy(*plan.devotion_order())


@query(
    "order_by_computed",
    with_sql("chart", "SELECT performer, primary_artist FROM songs ORDER BY primary_artist DESC, performer", SONGS),
)
def order_by_computed(t):
    lead = primary_entity(F.col("performer")).alias("primary_artist")
    return songs(t).select("performer", lead).orderBy(F.desc("primary_artist"), "performer")


@query(
    "topk",
    with_sql(
        "chart",
        "SELECT * FROM known_artists ORDER BY songs_charted DESC, primary_artist LIMIT 15",
        SONG_STAGES,
    ),
)
def topk(t):
    return top_k(roster(t), [F.desc("songs_charted"), F.asc("primary_artist")], 15)


@query("freeze_top", with_sql("chart stats", f"{SELECT} WHERE tier = 'hidden gem' ORDER BY {DEVOTION} LIMIT 500", GEM_STAGES))
def freeze_top(t):
    hidden = found(t).where(F.col("tier") == "hidden gem")
    return freeze(top_k(hidden.select(*COLUMNS), plan.devotion_order(), 500))


@query(
    "two_rankings",
    with_sql(
        "chart stats",
        f"""(SELECT 'devotion' AS ranking, * FROM ({SELECT} ORDER BY {DEVOTION} LIMIT 25)) UNION ALL
        (SELECT 'reach', * FROM ({SELECT} ORDER BY listeners DESC, artist, track LIMIT 25))""",
        GEM_STAGES,
    ),
)
def two_rankings(t):
    rows = freeze(found(t).select(*COLUMNS))
    by_devotion = top_k(rows, plan.devotion_order(), 25).select(F.lit("devotion").alias("ranking"), *COLUMNS)
    by_reach = top_k(rows, reach(), 25).select(F.lit("reach").alias("ranking"), *COLUMNS)
    return by_devotion.unionByName(by_reach)


@query(
    "filtered_topk",
    with_sql("chart stats", f"{SELECT} WHERE tier = 'hidden gem' ORDER BY {DEVOTION} LIMIT 25", GEM_STAGES),
)
def filtered_topk(t):
    hidden = found(t).where(F.col("tier") == "hidden gem").select(*COLUMNS)
    return top_k(hidden, plan.devotion_order(), 25)


@query(
    "paren_topk",
    with_sql(
        "stats",
        """SELECT artist, track, listeners FROM stats WHERE track LIKE '%(%'
        ORDER BY listeners DESC, artist, track LIMIT 30""",
    ),
)
def paren_topk(t):
    return top_k(t.stats.where(contains_ci(F.col("track"), "(")).drop("playcount"), reach(), 30)


@query("distinct_values", "SELECT DISTINCT source FROM documents")
def distinct_values(t):
    return t.table("documents").select("source").distinct()


@query("distinct_pairs", with_sql("chart", "SELECT DISTINCT performer, primary_artist FROM songs", SONGS))
def distinct_pairs(t):
    return songs(t).select("performer", "primary_artist").distinct()


LIST_VALUES = ["artist", "track", "listeners", "playcount", "plays_per_listener", "tier"]


@query(
    "snapshot_diff",
    with_sql(
        "chart stats early_stats",
        f"""SELECT artist_key, title_key,
        CASE WHEN b.tier IS NULL THEN 'dropped' WHEN a.tier IS NULL THEN 'added'
             WHEN row({', '.join(f'a.{c}' for c in LIST_VALUES)}) = row({', '.join(f'b.{c}' for c in LIST_VALUES)}) THEN 'kept'
             ELSE 'changed' END AS change, {', '.join(f'coalesce(b.{c}, a.{c}) AS {c}' for c in LIST_VALUES)}
        FROM early_gems a FULL JOIN gems b USING (artist_key, title_key)""",
        EARLY_STAGES,
    ),
)
def snapshot_diff(t):
    """The finished list of an early snapshot and that of a later one, which is brought about from
    the early one by working out changed keys only."""
    before, after, archive = *(freeze(s) for s in t.both_stats), freeze(songs(t))
    first = freeze(upkeep.gems_by_key(before, archive, CUT))
    second, _ = upkeep.refreshed_gems(first, before, after, archive, archive, CUT)
    return upkeep.list_changes(first, second, KEYS, LIST_VALUES)


@query(
    "play_floor_diff",
    with_sql(
        "snap_a snap_b",
        """SELECT coalesce(a.artist, b.artist) AS artist, coalesce(a.track, b.track) AS track,
        CASE WHEN b.track IS NULL THEN 'dropped' WHEN a.track IS NULL THEN 'added' ELSE 'kept' END AS change
        FROM (SELECT * FROM snap_a WHERE playcount >= 300) a FULL JOIN (SELECT * FROM snap_b WHERE playcount >= 300) b
        ON a.artist = b.artist AND a.track = b.track""",
    ),
)
def play_floor_diff(t):
    """Two result lists (tracks over a play floor): kept, added or dropped."""
    before, after = [s.where(F.col("playcount") >= 300) for s in t.snapshots]
    names = F.create_map(
        F.lit("both"), F.lit("kept"), F.lit("A only"), F.lit("dropped"), F.lit("B only"), F.lit("added")
    )
    both = reconcile(before, after, ["artist", "track"], "playcount")
    return both.select("artist", "track", names[F.col("side")].alias("change"))
