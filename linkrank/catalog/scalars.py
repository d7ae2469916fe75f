"""Scalar expressions and expressions over lists."""

from pyspark.sql import functions as F

from linkrank.catalog.registry import query
from linkrank.catalog.sql import cut_dash, fold
from linkrank.functions import nested as ns
from linkrank.functions import text as tx
from linkrank.functions.keys import artist_key, fold_title
from linkrank.sources.standins import with_sql


def per_line(expression):
    """A query showing one expression next to every line it is applied to."""
    return lambda t: t.lines.select("artist", "track", expression(F.col("track")).alias("out"))


def line_sql(expression: str) -> str:
    return with_sql("lines", f"SELECT artist, track, {expression} AS out FROM lines")


query("lower_key", line_sql("lower(track)"))(per_line(artist_key))
query("trim_spaces", line_sql("trim('  ' || track || ' ', ' ')"))(
    per_line(lambda c: F.trim(F.concat(F.lit("  "), c, F.lit(" "))))
)
query("instr_pos", line_sql("cast(instr(track, ' the ') AS int)"))(per_line(lambda c: F.instr(c, " the ")))
query("substr_cut", line_sql("substr(track, 1, greatest(instr(track, ', ') - 1, 0))"))(
    per_line(lambda c: F.substr(c, F.lit(1), F.greatest(F.instr(c, ", ") - 1, F.lit(0))))
)
query("cut_before", line_sql(cut_dash("track", ", ")))(per_line(lambda c: tx.cut_before(c, ", ")))
query("replace_chain", line_sql(fold("track")))(per_line(fold_title))


@query("concat_op", with_sql("details", "SELECT artist || ' / ' || album AS label, track || tags AS tagged FROM details"))
def concat_op(t):
    return t.details.select(
        F.concat("artist", F.lit(" / "), "album").alias("label"), F.concat("track", "tags").alias("tagged")
    )


@query("pad2", "SELECT p_partkey, lpad(cast(p_size AS varchar), 2, '0') AS padded FROM part")
def pad2(t):
    return t.table("part").select(
        "p_partkey", F.lpad(F.col("p_size").cast("string"), 2, "0").alias("padded")
    )


@query("cast_int", with_sql("chart", "SELECT last_week, try_cast(last_week AS int) AS as_int FROM chart"))
def cast_int(t):
    return t.chart.select("last_week", F.col("last_week").try_cast("int").alias("as_int"))


@query("cast_text", "SELECT o_orderkey, cast(o_orderkey AS varchar) AS as_text FROM orders")
def cast_text(t):
    return t.table("orders").select("o_orderkey", F.col("o_orderkey").cast("string").alias("as_text"))


@query("cast_real", "SELECT p_partkey, cast(p_size AS double) AS as_real FROM part")
def cast_real(t):
    return t.table("part").select("p_partkey", F.col("p_size").cast("double").alias("as_real"))


@query(
    "int_div_mod",
    with_sql(
        "details",
        "SELECT track, duration_ms // 60000 AS minutes, (duration_ms // 1000) % 60 AS seconds FROM details",
    ),
)
def int_div_mod(t):
    return t.details.selectExpr(
        "track", "duration_ms div 60000 AS minutes", "(duration_ms div 1000) % 60 AS seconds"
    )


@query(
    "real_ratio",
    with_sql("stats", "SELECT artist, track, playcount::double / nullif(listeners, 0) AS r FROM stats"),
)
def real_ratio(t):
    return t.stats.select("artist", "track", tx.ratio(F.col("playcount"), F.col("listeners")).alias("r"))


@query(
    "round1",
    with_sql("stats", "SELECT artist, track, round(playcount::double / nullif(listeners, 0), 1) AS r FROM stats"),
)
def round1(t):
    return t.stats.select(
        "artist", "track", F.round(tx.ratio(F.col("playcount"), F.col("listeners")), 1).alias("r")
    )


@query(
    "case_searched",
    """SELECT p_partkey, CASE WHEN p_size < 15 THEN 'hidden gem' WHEN p_size >= 40 THEN 'buried anthem'
    ELSE 'middle band' END AS tier FROM part""",
)
def case_searched(t):
    return t.table("part").select("p_partkey", tx.tier(F.col("p_size"), 15, 40).alias("tier"))


@query(
    "case_simple",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open'
    ELSE 'pending' END AS status FROM orders""",
)
def case_simple(t):
    return t.table("orders").selectExpr(
        "o_orderkey",
        "CASE o_orderstatus WHEN 'F' THEN 'finished' WHEN 'O' THEN 'open' ELSE 'pending' END AS status",
    )


@query("case_flag", "SELECT o_orderkey, CASE WHEN o_totalprice > 250000 THEN 1 ELSE 0 END AS large FROM orders")
def case_flag(t):
    return t.table("orders").select(
        "o_orderkey", F.when(F.col("o_totalprice") > 250000, 1).otherwise(0).alias("large")
    )


@query("glob_nondigit", line_sql("regexp_matches(track, '[^0-9]')"))
def glob_nondigit(t):
    return t.lines.select("artist", "track", tx.has_nondigit(F.col("track")).alias("out"))


@query(
    "decade_of_date",
    "SELECT o_orderkey, substr(cast(o_orderdate AS varchar), 1, 3) || '0s' AS decade FROM orders",
)
def decade_of_date(t):
    day = F.col("o_orderdate").cast("string")
    return t.table("orders").select("o_orderkey", tx.decade_of_date(day).alias("decade"))


@query(
    "decade_ladder",
    """SELECT o_orderkey, CASE WHEN cast(o_orderdate AS varchar) >= '2000' THEN '2000s'
    WHEN cast(o_orderdate AS varchar) >= '1990' THEN '1990s' ELSE 'earlier' END AS decade FROM orders""",
)
def decade_ladder(t):
    day = F.col("o_orderdate").cast("string")
    return t.table("orders").select("o_orderkey", tx.decade_ladder(day).alias("decade"))


@query("year4", line_sql("try_cast(regexp_extract(track, '^([0-9]{4}|[0-9]{1,3}$)', 1) AS int)"))
def year4(t):
    return t.lines.select("artist", "track", tx.year4(F.col("track")).alias("out"))


@query("quote_strip", "SELECT event_id, replace(props, '\"', ' ') AS out FROM events")
def quote_strip(t):
    return t.table("events").select("event_id", tx.strip_quotes(F.col("props")).alias("out"))


@query(
    "first_tag",
    with_sql("details", "SELECT track, tags, coalesce(split_part(tags, '|', 1), '') AS genre FROM details"),
)
def first_tag(t):
    return t.details.select("track", "tags", ns.first_tag(F.col("tags")).alias("genre"))


@query(
    "tag_filter",
    with_sql("details", "SELECT artist, track FROM details WHERE list_contains(string_split(tags, '|'), 'widget')"),
)
def tag_filter(t):
    return t.details.where(ns.has_tag(F.col("tags"), "widget")).select("artist", "track")


@query(
    "duration_text",
    with_sql(
        "details",
        """SELECT track, coalesce(format('{}:{:02d}', nullif(duration_ms, 0) // 60000, duration_ms // 1000 % 60), '') AS duration FROM details""",
    ),
)
def duration_text(t):
    return t.details.select("track", tx.duration_text(F.col("duration_ms")).alias("duration"))


@query(
    "tier_label",
    with_sql(
        "stats",
        """SELECT artist, CASE WHEN max(listeners) < 14 THEN 'hidden gem' WHEN max(listeners) >= 18
        THEN 'buried anthem' ELSE 'middle band' END AS tier FROM stats GROUP BY artist, track""",
    ),
)
def tier_label(t):
    label = tx.tier(F.max("listeners"), 14, 18).alias("tier")
    return t.stats.groupBy("artist", "track").agg(label).drop("track")
