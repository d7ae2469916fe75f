"""Percent ranks, composite scores and best-N-per-group."""

from pyspark.sql import functions as F

from linkrank.catalog.registry import query
from linkrank.catalog.sql import DEVOTION
from linkrank.functions.text import ratio
from linkrank.operators import rank
from linkrank.plans import gems as plan
from linkrank.runtime import materialize
from linkrank.sources.standins import with_sql


def scored(t):
    return t.stats.withColumn(
        "plays_per_listener", F.round(ratio(F.col("playcount"), F.col("listeners")), 1)
    )


SCORED = "scored AS (SELECT *, round(playcount::double / listeners, 1) AS plays_per_listener FROM stats)"


@query(
    "percent_rank_global",
    """SELECT l_orderkey, l_linenumber, l_extendedprice,
    percent_rank() OVER (ORDER BY l_extendedprice) AS pr FROM lineitem""",
)
def percent_rank_global(t):
    prices = t.table("lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return rank.percent_rank_at_scale(prices, "l_extendedprice", "pr")


@query(
    "composite_score",
    with_sql(
        "stats",
        """SELECT artist, track, plays_per_listener, listeners,
        round((0.7::double * percent_rank() OVER (ORDER BY plays_per_listener)
             + 0.3::double * percent_rank() OVER (ORDER BY listeners)) * 100, 1) AS gem_score FROM scored""",
        SCORED,
    ),
)
def composite_score(t):
    rows = materialize(scored(t).select("artist", "track", "plays_per_listener", "listeners"))
    return rank.composite_score(rows, plan.SCORE_WEIGHTS, "gem_score")


def ranked_sql(n: int) -> str:
    return with_sql(
        "stats",
        f"""SELECT artist, track, plays_per_listener, listeners FROM (SELECT *, row_number() OVER
        (PARTITION BY lower(artist) ORDER BY {DEVOTION}, playcount) AS rk FROM scored) WHERE rk <= {n}""",
        SCORED,
    )


def best_of_each(t, n):
    keyed = scored(t).withColumn("artist_lower", F.lower("artist"))
    best = rank.top_n_per_group(keyed, ["artist_lower"], [*plan.devotion_order(), F.asc("playcount")], n)
    return best.select("artist", "track", "plays_per_listener", "listeners")


@query("best_per_group", ranked_sql(1))
def best_per_group(t):
    return best_of_each(t, 1)


@query("top_n_per_group", ranked_sql(3))
def top_n_per_group(t):
    return best_of_each(t, 3)


@query(
    "top_k_per_decade",
    """SELECT decade, o_orderkey, cast(rk AS int) AS rk FROM (SELECT *, row_number() OVER
        (PARTITION BY decade ORDER BY o_totalprice DESC, o_orderkey) AS rk
        FROM (SELECT substr(cast(o_orderdate AS varchar), 1, 3) || '0s' AS decade, o_orderkey, o_totalprice FROM orders))
    WHERE rk <= 2 ORDER BY decade, rk""",
)
def top_k_per_decade(t):
    orders = t.table("orders").select(
        F.concat(F.substring(F.col("o_orderdate").cast("string"), 1, 3), F.lit("0s")).alias("decade"),
        "o_orderkey",
        "o_totalprice",
    )
    best = rank.top_n_per_group(orders, ["decade"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 2, rank="rk")
    return best.select("decade", "o_orderkey", "rk").orderBy("decade", "rk")


@query(
    "percent_rank_partitioned",
    """SELECT o_orderpriority, o_orderkey,
    percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice) AS pr FROM orders""",
)
def percent_rank_partitioned(t):
    orders = t.table("orders").select("o_orderpriority", "o_orderkey", "o_totalprice")
    ranked = rank.percent_rank_at_scale(orders, "o_totalprice", "pr", ("o_orderpriority",))
    return ranked.select("o_orderpriority", "o_orderkey", "pr")
