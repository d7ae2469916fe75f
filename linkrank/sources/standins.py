"""The analysis' input tables, derived from the order, document and page tables.

Each derivation is given twice: as DataFrame code and as the SQL text that the
checks run. Both read the whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkrank.operators.joins import lookup_join
from linkrank.operators.rank import numbered
from linkrank.runtime import materialize


def _s(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _cents(price: str) -> Column:
    """Price in whole cents, so that sums are exact."""
    return F.floor(F.col(price) * 100 + 0.5)


def _item(key: str = "p_partkey") -> Column:
    return _s(F.col("p_name"), " #", F.col(key))


def _credit() -> Column:
    """A credit in the style of its part type: guest joiners, case twins, ampersands."""
    brand, name, kind = F.col("p_brand"), F.col("p_name"), F.col("p_type")
    return (
        F.when(kind == "ECONOMY", _s(brand, " Featuring ", name))
        .when(kind == "SMALL", _s(brand, " With ", name))
        .when(kind == "PROMO", _s(brand, " A Duet With ", name))
        .when(kind == "LARGE", _s(brand, " Duet With ", name))
        .when(kind == "MEDIUM", F.upper(brand))
        .when(F.col("p_size") > 40, _s(brand, " & ", name))
        .otherwise(brand)
    )


def _chart_title() -> Column:
    """Archive spelling: some sizes carry punctuation the track list lacks."""
    return F.when(
        F.col("p_size").between(31, 36),
        _s(F.replace("p_name", F.lit(" "), F.lit(", ")), " #", F.col("p_partkey")),
    ).otherwise(_item())


def _track() -> Column:
    """Track-list spelling: finished lines carry the tails real track lists carry."""
    size = F.col("p_size")
    return (
        F.when(F.col("l_linestatus") == "O", _item())
        .when(size <= 8, _s(_item(), " (feat. ", F.col("p_type"), ")"))
        .when(size <= 14, _s(_item(), " (With ", F.col("p_type"), ")"))
        .when(size <= 20, _s(_item(), " - Remaster"))
        .when(size <= 25, _s("The ", _item(), "!"))
        .when(size <= 28, _s(_item(), " (Live)"))
        .when(size <= 30, _s(_item(), " Remix"))
        .otherwise(_item())
    )


class Inputs:
    """The given tables of one folder and what is derived from them, all lazy."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def chart(self) -> DataFrame:
        """Weekly ranking of all parts sold by revenue: one row per week and position."""
        revenue = (
            self.table("lineitem")
            .groupBy(F.trunc(F.col("l_shipdate").cast("date"), "week").alias("w"), "l_partkey")
            .agg(F.sum(_cents("l_extendedprice")).alias("cents"))
        )
        ranked = numbered(revenue, ["w"], [F.desc("cents"), F.asc("l_partkey")], "p")
        history = W.partitionBy("l_partkey").orderBy("w")
        names = self.table("part").select("p_partkey", _chart_title().alias("title"), _credit().alias("performer"))
        return (
            ranked.select(
                F.col("l_partkey").alias("p_partkey"),
                F.col("w").cast("string").alias("chart_week"),
                F.col("p").alias("current_week"),
                F.coalesce(F.lag("p").over(history).cast("string"), F.lit("NA")).alias("last_week"),
                F.min("p").over(history).cast("string").alias("peak_pos"),
                F.row_number().over(history).alias("wks_on_chart"),
            )
            .join(names, "p_partkey")
            .select(
                "chart_week",
                "current_week",
                "title",
                "performer",
                "last_week",
                "peak_pos",
                "wks_on_chart",
            )
        )

    @cached_property
    def stats(self) -> DataFrame:
        """Plays and distinct listeners per track: units sold and distinct customers."""
        return self._stats(self.table("lineitem"))

    def _stats(self, lines: DataFrame) -> DataFrame:
        buyers = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        sold = lines.select("l_orderkey", "l_partkey", "l_linestatus", "l_quantity")
        return (
            lookup_join(sold, buyers, ["l_orderkey"], "inner")
            .groupBy(F.col("l_partkey").alias("p_partkey"), "l_linestatus")
            .agg(
                F.sum("l_quantity").cast("long").alias("playcount"),
                F.countDistinct("o_custkey").alias("listeners"),
            )
            .join(self.table("part"), "p_partkey")
            .select(F.col("p_brand").alias("artist"), _track().alias("track"), "playcount", "listeners")
        )

    @cached_property
    def early_stats(self) -> DataFrame:
        """The same before 1998: an earlier snapshot of the statistics."""
        return self._stats(self.table("lineitem").where(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")))

    @cached_property
    def both_stats(self) -> tuple[DataFrame, DataFrame]:
        """``early_stats`` and ``stats`` from one pass over lines and orders, stored by part and status."""
        early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
        lines = self.table("lineitem").select(
            "l_orderkey", "l_partkey", "l_linestatus", "l_quantity", F.coalesce(early, F.lit(False)).alias("early")
        )
        buyers = self.table("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
        part, is_early = [F.col("l_partkey").alias("p_partkey"), "l_linestatus"], F.col("early")
        per_buyer = (
            lookup_join(lines, buyers, ["l_orderkey"], "inner")
            .groupBy(*part, "o_custkey")
            .agg(
                F.sum("l_quantity").alias("units"),
                F.sum(F.when(is_early, F.col("l_quantity"))).alias("early_units"),
                F.bool_or("early").alias("early"),
            )
        )
        sums = materialize(
            per_buyer.groupBy("p_partkey", "l_linestatus").agg(
                F.sum("units").cast("long").alias("playcount"),
                F.count("o_custkey").alias("listeners"),
                F.sum("early_units").cast("long").alias("early_playcount"),
                F.count(F.when(is_early, F.col("o_custkey"))).alias("early_listeners"),
                F.bool_or("early").alias("early"),
            )
        )

        def named(rows: DataFrame, prefix: str) -> DataFrame:
            figures = [F.col(f"{prefix}{c}").alias(c) for c in ("playcount", "listeners")]
            return rows.join(self.table("part"), "p_partkey").select(F.col("p_brand").alias("artist"), _track().alias("track"), *figures)

        return named(sums.where("early"), "early_"), named(sums, "")

    @cached_property
    def snapshots(self) -> tuple[DataFrame, DataFrame]:
        """Track statistics before and from 1998."""
        lines = self.table("lineitem")
        early = F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz")
        return self._plays(lines.where(early)), self._plays(lines.where(~early))

    def _plays(self, lines: DataFrame) -> DataFrame:
        return (
            lines.groupBy(F.col("l_partkey").alias("p_partkey"))
            .agg(F.sum("l_quantity").cast("long").alias("playcount"))
            .join(self.table("part"), "p_partkey")
            .select(F.col("p_brand").alias("artist"), _item().alias("track"), "playcount")
        )

    @cached_property
    def details(self) -> DataFrame:
        """Album, tags and duration; some part types lack tags or a duration, and the tails of
        track names leave some tracks without an entry."""
        kind = F.col("p_type")
        return (
            self.table("part")
            .select(
                F.col("p_brand").alias("artist"),
                _item().alias("track"),
                kind.alias("album"),
                F.when(kind == "PROMO", "")
                .otherwise(_s(kind, "|", F.replace("p_name", F.lit(" "), F.lit("|"))))
                .alias("tags"),
                F.when(kind == "LARGE", 0)
                .otherwise(F.round(F.col("p_retailprice") * 100))
                .cast("long")
                .alias("duration_ms"),
            )
        )

    @cached_property
    def lines(self) -> DataFrame:
        """Every line of every document as a track of its source."""
        return self.table("documents").select(
            F.col("source").alias("artist"), F.explode(F.split("text", "\n")).alias("track")
        )

    @cached_property
    def benchmark_songs(self) -> DataFrame:
        """Every benchmark line as an archive title."""
        return self.table("benchmark").select(
            "item_id", F.explode(F.split("text", "\n")).alias("title")
        )

    @cached_property
    def titles(self) -> DataFrame:
        return self.table("pages").select(
            "page_id", F.regexp_extract("html", "<title>(.*?)</title>", 1).alias("title")
        )

    # Captured replies, one row per request.

    @cached_property
    def toptracks_replies(self) -> DataFrame:
        return self._toptracks.select("artist", "body")

    @cached_property
    def _toptracks(self) -> DataFrame:
        """Per document: its lines as tracks."""
        track = F.transform(
            F.split("text", "\n"),
            lambda line: F.struct(
                line.alias("name"),
                F.length(line).cast("string").alias("playcount"),
                F.when(F.length(line) > 80, F.lit("many")).alias("listeners"),
            ),
        )
        body = F.to_json(F.struct(F.struct(track.alias("track")).alias("toptracks")))
        return self.table("documents").select(
            _s(F.col("source"), "/", F.col("doc_id")).alias("artist"),
            "lang",
            "text",
            body.alias("body"),
        )

    @cached_property
    def broken_replies(self) -> DataFrame:
        """The same, but Spanish requests got an error page and German ones nothing."""
        body = F.when(F.col("lang") == "es", F.concat(F.lit("<html>"), "text")).when(F.col("lang") != "de", F.col("body"))
        return self._toptracks.select("artist", body.alias("body"))

    @cached_property
    def trackinfo_replies(self) -> DataFrame:
        """Per order: priority words as tags; pending orders got no reply."""
        words = F.split("o_orderpriority", "[- ]")
        tags = F.when(F.col("o_orderpriority") == "4-NOT SPECIFIED", F.lit(None)).otherwise(
            F.transform(words, lambda w: F.struct(w.alias("name")))
        )
        info = F.struct(
            F.when(
                F.col("o_orderpriority") != "5-LOW",
                F.struct(F.col("o_orderpriority").alias("title")),
            ).alias("album"),
            F.struct(tags.alias("tag")).alias("toptags"),
            F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_totalprice").cast("long").cast("string")).alias(
                "duration"
            ),
        )
        body = F.to_json(F.struct(info.alias("track")))
        return self.table("orders").select(
            "o_orderkey",
            "o_custkey",
            F.when(F.col("o_orderstatus") != "P", body).alias("body"),
        )

    @cached_property
    def toptags_replies(self) -> DataFrame:
        """Per customer: segment, nation and customer name as tags, furniture buyers have none."""
        names = F.array(
            F.col("c_mktsegment"), _s("nation ", F.col("c_nationkey")), F.col("c_name"), F.lit("extra")
        )
        tags = F.transform(names, lambda n: F.struct(n.alias("name")))
        tags = F.when(F.col("c_mktsegment") == "FURNITURE", F.array().cast(
            "array<struct<name:string>>"
        )).otherwise(tags)
        return self.table("customer").select(
            F.col("c_custkey").alias("o_custkey"),
            F.to_json(F.struct(F.struct(tags.alias("tag")).alias("toptags"))).alias("body"),
        )

    @cached_property
    def recordings_replies(self) -> DataFrame:
        """Per order: two recordings; low-priority orders got an empty list."""
        day = F.col("o_orderdate").cast("date")
        first = F.struct(
            F.floor(F.col("o_totalprice") / 5000).cast("int").alias("score"),
            day.cast("string").alias("first-release-date"),
            F.array(
                F.struct(F.substring(F.add_months(day, -12).cast("string"), 1, 7).alias("date")),
                F.struct(F.lit("").alias("date")),
            ).alias("releases"),
        )
        second = F.struct(
            F.when(F.col("o_orderpriority") == "1-URGENT", 95).otherwise(40).alias("score"),
            F.lit("").alias("first-release-date"),
            F.array(
                F.struct(F.lit("unknown").alias("date")),
                F.struct(F.year(F.add_months(day, 24)).cast("string").alias("date")),
            ).alias("releases"),
        )
        body = F.to_json(F.struct(F.array(first, second).alias("recordings")))
        return self.table("orders").select(
            "o_orderkey",
            F.year("o_orderdate").cast("string").alias("order_year"),
            F.when(F.col("o_orderpriority") == "5-LOW", F.lit('{"recordings":[]}'))
            .otherwise(body)
            .alias("body"),
        )

    @cached_property
    def part_recordings(self) -> DataFrame:
        """Per part: one recording dated by size; the smallest parts got no confident match."""
        year = F.lit(1945) + F.col("p_size")
        one = F.struct(
            F.least(F.lit(100), F.lit(80) + F.col("p_size")).alias("score"),
            _s(year, "-06-01").alias("first-release-date"),
            F.array(F.struct(_s(year + 7).alias("date"))).alias("releases"),
        )
        return self.table("part").select(
            F.col("p_brand").alias("artist"),
            _item().alias("track"),
            F.to_json(F.struct(F.array(one).alias("recordings"))).alias("body"),
        )

    @cached_property
    def part_debuts(self) -> DataFrame:
        """Debut decade per track, by part size."""
        return self.table("part").select(
            F.col("p_brand").alias("artist"),
            _item().alias("track"),
            _s(F.floor((F.lit(1940) + F.col("p_size")) / 10), "0s").alias("debut_decade"),
        )


# The same derivations as SQL.

_ITEM = "concat(p_name, ' #', cast(p_partkey AS varchar))"


def _stats_sql(name: str, where: str) -> str:
    return f"""
{name} AS (SELECT p_brand AS artist,
       CASE WHEN l_linestatus = 'O' THEN {_ITEM}
            WHEN p_size <= 8 THEN {_ITEM} || ' (feat. ' || p_type || ')'
            WHEN p_size <= 14 THEN {_ITEM} || ' (With ' || p_type || ')'
            WHEN p_size <= 20 THEN {_ITEM} || ' - Remaster'
            WHEN p_size <= 25 THEN 'The ' || {_ITEM} || '!'
            WHEN p_size <= 28 THEN {_ITEM} || ' (Live)'
            WHEN p_size <= 30 THEN {_ITEM} || ' Remix'
            ELSE {_ITEM} END AS track, playcount, listeners
FROM (SELECT l_partkey, l_linestatus, cast(sum(l_quantity) AS bigint) AS playcount,
             count(DISTINCT o_custkey) AS listeners
      FROM lineitem JOIN orders ON l_orderkey = o_orderkey {where} GROUP BY 1, 2)
JOIN part ON l_partkey = p_partkey)"""


_SQL = {
    "chart": f"""
rev AS (SELECT cast(date_trunc('week', l_shipdate) AS date) AS w, l_partkey,
               sum(cast(round(l_extendedprice * 100) AS bigint)) AS cents
        FROM lineitem GROUP BY 1, 2),
pos AS (SELECT w, l_partkey, row_number() OVER (PARTITION BY w ORDER BY cents DESC, l_partkey) AS p FROM rev),
chart AS MATERIALIZED (SELECT cast(w AS varchar) AS chart_week, cast(p AS int) AS current_week,
       CASE WHEN p_size BETWEEN 31 AND 36
            THEN concat(replace(p_name, ' ', ', '), ' #', cast(p_partkey AS varchar))
            ELSE {_ITEM} END AS title,
       CASE WHEN p_type = 'ECONOMY' THEN p_brand || ' Featuring ' || p_name
            WHEN p_type = 'SMALL' THEN p_brand || ' With ' || p_name
            WHEN p_type = 'PROMO' THEN p_brand || ' A Duet With ' || p_name
            WHEN p_type = 'LARGE' THEN p_brand || ' Duet With ' || p_name
            WHEN p_type = 'MEDIUM' THEN upper(p_brand)
            WHEN p_size > 40 THEN p_brand || ' & ' || p_name
            ELSE p_brand END AS performer,
       coalesce(cast(lag(p) OVER h AS varchar), 'NA') AS last_week,
       cast(min(p) OVER h AS varchar) AS peak_pos,
       cast(row_number() OVER h AS int) AS wks_on_chart
FROM pos JOIN part ON l_partkey = p_partkey
WINDOW h AS (PARTITION BY p_partkey ORDER BY w))""",
    "stats": _stats_sql("stats", ""),
    "early_stats": _stats_sql("early_stats", "WHERE l_shipdate < TIMESTAMP '1998-01-01'"),
    "snap_a": f"""
snap_a AS (SELECT p_brand AS artist, {_ITEM} AS track, cast(sum(l_quantity) AS bigint) AS playcount
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate < TIMESTAMP '1998-01-01' GROUP BY p_brand, p_name, p_partkey)""",
    "snap_b": f"""
snap_b AS (SELECT p_brand AS artist, {_ITEM} AS track, cast(sum(l_quantity) AS bigint) AS playcount
FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1998-01-01' GROUP BY p_brand, p_name, p_partkey)""",
    "details": f"""
details AS (SELECT p_brand AS artist, {_ITEM} AS track, p_type AS album,
       CASE WHEN p_type = 'PROMO' THEN '' ELSE p_type || '|' || replace(p_name, ' ', '|') END AS tags,
       CASE WHEN p_type = 'LARGE' THEN 0 ELSE cast(round(p_retailprice * 100) AS bigint) END AS duration_ms
FROM part)""",
    "lines": """
lines AS (SELECT source AS artist, unnest(string_split(text, chr(10))) AS track FROM documents)""",
    "benchmark_songs": """
benchmark_songs AS (SELECT item_id, unnest(string_split(text, chr(10))) AS title FROM benchmark)""",
    "titles": """
titles AS (SELECT page_id, regexp_extract(html, '<title>(.*?)</title>', 1) AS title FROM pages)""",
}


def with_sql(names: str, body: str, extra: str = "") -> str:
    """``body`` with the named derivations (and further CTEs) in front of it."""
    parts = [_SQL[n].strip() for n in names.split()]
    if extra:
        parts.append(extra.strip())
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()
