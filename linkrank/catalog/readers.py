"""Reply parsing, and files written and read back under their contract."""

from pyspark.sql import functions as F

from linkrank.catalog.filters import roster, songs
from linkrank.catalog.registry import CUT, query
from linkrank.catalog.sql import GEM_STAGES, SONG_STAGES, SONGS
from linkrank.functions import nested as ns
from linkrank.plans import gems as plan
from linkrank.runtime import scratch_path
from linkrank.sources import files
from linkrank.sources import replies as rp
from linkrank.sources.standins import with_sql
from linkrank.streaming import snapshots

TRACKS_SQL = with_sql("stats", "SELECT artist, track, playcount, listeners FROM stats")


@query("table_scan", "SELECT o_orderkey, o_totalprice FROM orders")
def table_scan(t):
    return t.table("orders").select("o_orderkey", "o_totalprice")


@query(
    "roster_scan",
    with_sql("chart", "SELECT primary_artist FROM known_artists ORDER BY primary_artist", SONG_STAGES),
)
def roster_scan(t):
    return files.roster_scan(roster(t), "primary_artist")


@query(
    "roster_sample",
    with_sql("chart", "SELECT primary_artist FROM known_artists ORDER BY primary_artist LIMIT 10", SONG_STAGES),
)
def roster_sample(t):
    """The sample-first mode: the first few names only."""
    return files.roster_scan(roster(t), "primary_artist", 10)


@query("read_csv_contract", with_sql("chart", "SELECT * FROM chart"))
def read_csv_contract(t):
    path = files.write_dated_csv(t.chart, scratch_path(t.spark, "chart"), "2026-07-14")
    return files.read_csv_contract(t.spark, path, files.CHART_ENTRIES).good


@query("read_tracks_snapshot", with_sql("stats", "SELECT *, '2026-07-14' AS snapshot_date FROM stats"))
def read_tracks_snapshot(t):
    root = scratch_path(t.spark, "tracks")
    files.write_dated_csv(t.stats, root, "2026-07-14")
    found = files.read_snapshots(t.spark, root, files.TRACKS, "2026-07-14").good
    return found.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("read_details_snapshot", with_sql("details", "SELECT * FROM details"))
def read_details_snapshot(t):
    """Written twice on purpose: a second import replaces the first."""
    root = scratch_path(t.spark, "details")
    for _ in range(2):
        files.write_dated_csv(t.details, root, "2026-07-15")
    return files.read_snapshots(t.spark, root, files.DETAILS).good.drop("snapshot_date")


@query(
    "follow_snapshots",
    with_sql(
        "stats early_stats",
        """SELECT *, 0::bigint AS loaded_in_run, '2026-07-14' AS snapshot_date FROM early_stats
        UNION ALL SELECT *, 1, '2026-07-21' FROM stats""",
    ),
)
def follow_snapshots(t):
    """Two dated folders land one after the other; each run of the stream reads only what is new."""
    root, table, state = (scratch_path(t.spark, x) for x in ("landing", "followed", "progress"))
    for rows, date in ((t.early_stats, "2026-07-14"), (t.stats, "2026-07-21")):
        files.write_dated_csv(rows, root, date)
        snapshots.follow_snapshots(t.spark, root, files.TRACKS, table, state)
    found = snapshots.snapshot_table(t.spark, table, files.TRACKS)
    return found.withColumn("snapshot_date", F.col("snapshot_date").cast("string"))


@query("write_dated_csv", TRACKS_SQL)
def write_dated_csv(t):
    path = files.write_dated_csv(t.stats, scratch_path(t.spark, "dated"), "2026-07-14")
    return files.read_csv_contract(t.spark, path, files.TRACKS).good


@query("write_json", TRACKS_SQL)
def write_json(t):
    path = files.write_json(t.stats, scratch_path(t.spark, "json"))
    return t.spark.read.schema(files.TRACKS).json(path)


@query(
    "playlist_csv",
    with_sql("chart stats", "SELECT artist, track FROM gems", GEM_STAGES),
)
def playlist_csv(t):
    path = files.write_playlist_csv(plan.gems(t.stats, songs(t), CUT), scratch_path(t.spark, "playlist"))
    return files.read_csv_contract(t.spark, path, files.PLAYLIST).good


@query("ctas", with_sql("chart", "SELECT * FROM songs", SONGS))
def ctas(t):
    return files.freeze(songs(t))


@query("drop_rebuild", TRACKS_SQL)
def drop_rebuild(t):
    """The same step run twice from the top leaves one copy."""
    path = scratch_path(t.spark, "rebuilt")
    files.freeze(t.stats, path)
    return files.freeze(t.stats, path)


SMALLEST, LARGEST = 300_000, 1_000_000


GIVEN = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query("file_size_check")
def file_size_check(t):
    """Every given file with its length and whether that is plausible; no contents are read.

    Any table of the analysis with a file of under 500 bytes holds an error page or nothing.
    """
    found = None
    for name in GIVEN:
        listed = files.input_files(t.spark, f"{t.folder}/{name}.parquet").select(F.lit(name).alias("table_name"), "*")
        found = listed if found is None else found.unionByName(listed)
    return files.file_verdicts(found, 500, 1 << 30)


@query(
    "written_bytes_check",
    f"""SELECT lang, bytes, CASE WHEN bytes < {SMALLEST} THEN 'too small' WHEN bytes > {LARGEST} THEN 'too large'
    ELSE 'plausible' END AS verdict FROM (SELECT lang, cast(sum(octet_length(encode(line)) + 1) AS bigint) AS bytes
    FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY lang)""",
)
def written_bytes_check(t):
    """Length of each written folder, every line and its line end, against what is plausible."""
    path = scratch_path(t.spark, "lines")
    lines = t.table("documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    lines.write.partitionBy("lang").text(path)
    return files.folder_sizes(t.spark, path, "lang", SMALLEST, LARGEST)


@query(
    "csv_round_trip",
    """SELECT source || chr(10) || '"' || lang || '", ' AS artist, text AS track, n_chars AS playcount,
    doc_id AS listeners FROM documents""",
)
def csv_round_trip(t):
    """Line breaks, quotes and commas in texts, written and read back under the contract."""
    rows = t.table("documents").select(
        F.concat("source", F.lit('\n"'), "lang", F.lit('", ')).alias("artist"),
        F.col("text").alias("track"),
        F.col("n_chars").alias("playcount"),
        F.col("doc_id").alias("listeners"),
    )
    path = files.write_dated_csv(rows, scratch_path(t.spark, "round_trip"), "2026-07-14")
    return files.read_csv_contract(t.spark, path, files.TRACKS).good


# Reply parsing. The SQL reads the columns the replies were built from, not the replies.


@query(
    "parse_toptracks_json",
    """SELECT source || '/' || doc_id AS artist, l AS track, cast(length(l) AS varchar) AS playcount,
    CASE WHEN length(l) > 80 THEN 'many' ELSE '' END AS listeners
    FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents)""",
)
def parse_toptracks_json(t):
    return rp.parse_toptracks(t.toptracks_replies)


INFO = """info AS (SELECT o_orderkey, o_custkey, o_orderstatus = 'P' AS failed,
CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '5-LOW' THEN '' ELSE o_orderpriority END AS album,
CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '4-NOT SPECIFIED' THEN ''
     ELSE regexp_replace(o_orderpriority, '[- ]', '|', 'g') END AS tags,
CASE WHEN o_orderstatus = 'P' OR o_orderpriority = '2-HIGH' THEN '0'
     ELSE cast(cast(floor(o_totalprice) AS bigint) AS varchar) END AS duration_ms FROM orders)"""


@query("parse_trackinfo_json", f"WITH {INFO} SELECT * FROM info")
def parse_trackinfo_json(t):
    return rp.parse_trackinfo(t.trackinfo_replies)


OWNER_TAGS = """CASE WHEN c_mktsegment = 'FURNITURE' THEN ''
ELSE c_mktsegment || '|nation ' || c_nationkey || '|' || c_name END"""


@query("parse_toptags_json", f"SELECT c_custkey AS o_custkey, {OWNER_TAGS} AS owner_tags FROM customer")
def parse_toptags_json(t):
    return rp.parse_toptags(t.toptags_replies, "o_custkey")


@query(
    "top3_join",
    """SELECT doc_id, array_to_string(string_split(text, ' ')[1:3], '|') AS tags FROM documents""",
)
def top3_join(t):
    words = F.transform(F.split("text", " "), lambda w: F.struct(w.alias("name")))
    return t.table("documents").select("doc_id", ns.top_names(words).alias("tags"))


@query(
    "tag_fallback",
    f"""WITH {INFO} SELECT o_orderkey, CASE WHEN failed THEN '' WHEN tags <> '' THEN tags
    ELSE coalesce({OWNER_TAGS}, '') END AS tags FROM info LEFT JOIN customer ON o_custkey = c_custkey""",
)
def tag_fallback(t):
    items = rp.parse_trackinfo(t.trackinfo_replies)
    owners = rp.parse_toptags(t.toptags_replies, "o_custkey")
    return rp.tag_fallback(items, owners, "o_custkey").select("o_orderkey", "tags")


@query("failed_row_default", f"WITH {INFO} SELECT o_orderkey, album, tags, duration_ms FROM info WHERE failed")
def failed_row_default(t):
    kept = rp.parse_trackinfo(t.trackinfo_replies).where("failed")
    return kept.select("o_orderkey", "album", "tags", "duration_ms")


TRACK = "OBJECT<{}name: STRING, playcount: STRING>"
LISTED = "OBJECT<toptracks: OBJECT<track: ARRAY<{}>>>"


@query(
    "reply_shapes",
    f"""WITH tracks AS (SELECT lang, len(l) AS lines, len(list_filter(l, lambda x: length(x) > 80)) AS long
    FROM (SELECT lang, string_split(text, chr(10)) AS l FROM documents)),
    shapes AS (SELECT lang, CASE WHEN long = 0 THEN '{LISTED.format(TRACK.format(""))}'
        ELSE '{LISTED.format(TRACK.format("listeners: STRING, "))}' END AS shape FROM tracks)
    SELECT 'tracks' AS source, shape, count(*) AS replies FROM shapes GROUP BY shape
    UNION ALL SELECT 'broken', CASE lang WHEN 'de' THEN 'no reply' WHEN 'es' THEN 'not JSON' ELSE shape END AS s, count(*)
    FROM shapes GROUP BY s
    UNION ALL SELECT 'tags', CASE WHEN c_mktsegment = 'FURNITURE' THEN 'OBJECT<toptags: OBJECT<tag: ARRAY<VOID>>>'
        ELSE 'OBJECT<toptags: OBJECT<tag: ARRAY<OBJECT<name: STRING>>>>' END AS s, count(*) FROM customer GROUP BY s
    UNION ALL SELECT 'recordings', CASE WHEN o_orderpriority = '5-LOW' THEN 'OBJECT<recordings: ARRAY<VOID>>'
        ELSE 'OBJECT<recordings: ARRAY<OBJECT<`first-release-date`: STRING, releases: ARRAY<OBJECT<date: STRING>>, score: BIGINT>>>' END AS s,
        count(*) FROM orders GROUP BY s""",
)
def reply_shapes(t):
    """Which shapes the replies of each source have, found without a schema."""
    return rp.shape_census(
        {"tracks": t.toptracks_replies, "broken": t.broken_replies, "tags": t.toptags_replies, "recordings": t.recordings_replies}
    )


@query(
    "reply_schemas",
    f"""SELECT 'tracks' AS source, '{LISTED.format(TRACK.format("listeners: STRING, "))}' AS shape, count(*) AS readable, count(*) AS replies FROM documents
    UNION ALL SELECT 'tags', 'OBJECT<toptags: OBJECT<tag: ARRAY<OBJECT<name: STRING>>>>', count(*), count(*) FROM customer
    UNION ALL SELECT 'broken', '{LISTED.format(TRACK.format("listeners: STRING, "))}', count_if(lang NOT IN ('es', 'de'))::bigint, count(*) FROM documents""",
)
def reply_schemas(t):
    """The schema to declare for each source: that of all its replies together."""
    return rp.merged_shapes({"tracks": t.toptracks_replies, "tags": t.toptags_replies, "broken": t.broken_replies})


@query(
    "parse_toptracks_variant",
    """SELECT source || '/' || doc_id AS artist, l AS track, cast(length(l) AS varchar) AS playcount,
    CASE WHEN length(l) > 80 THEN 'many' ELSE '' END AS listeners
    FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS l FROM documents WHERE lang NOT IN ('es', 'de'))""",
)
def parse_toptracks_variant(t):
    """The readable replies among broken ones, read by path."""
    return rp.parse_toptracks_variant(t.broken_replies)


@query(
    "failed_requests",
    """SELECT source || '/' || doc_id AS artist FROM documents WHERE lang IN ('es', 'de')""",
)
def failed_requests(t):
    return rp.failures(t.broken_replies)


@query(
    "failure_report",
    """SELECT count(*) AS requests, count_if(lang IN ('es', 'de'))::bigint AS failed,
    sum(CASE WHEN lang IN ('es', 'de') THEN 0 ELSE len(string_split(text, chr(10))) END)::bigint AS rows_written
    FROM documents""",
)
def failure_report(t):
    return rp.failure_totals(t.broken_replies)


@query(
    "parse_recordings_json",
    """SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN 0 ELSE 2 END AS recordings,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(floor(o_totalprice / 5000) AS int) END AS first_score,
    CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE cast(cast(o_orderdate AS date) AS varchar) END AS first_date
    FROM orders""",
)
def parse_recordings_json(t):
    found = rp.parse_recordings(t.recordings_replies)
    first = F.try_element_at("recordings", F.lit(1))
    return found.select(
        "o_orderkey",
        F.size("recordings").alias("recordings"),
        first["score"].try_cast("int").alias("first_score"),
        first["first-release-date"].alias("first_date"),
    )


YEARS = """years AS (SELECT o_orderkey,
CASE WHEN o_orderpriority = '5-LOW' THEN NULL
     WHEN floor(o_totalprice / 5000) >= 90 THEN year(o_orderdate) - 1
     WHEN o_orderpriority = '1-URGENT' THEN year(o_orderdate) + 2 END AS release_year,
CASE WHEN o_orderpriority = '5-LOW' THEN 0
     ELSE greatest(floor(o_totalprice / 5000), CASE WHEN o_orderpriority = '1-URGENT' THEN 95 ELSE 40 END) END AS best
FROM orders)"""


@query("earliest_year", f"WITH {YEARS} SELECT o_orderkey, cast(release_year AS int) AS release_year FROM years")
def earliest_year(t):
    found = rp.parse_recordings(t.recordings_replies)
    return found.select("o_orderkey", ns.earliest_year(F.col("recordings")).alias("release_year"))


@query("best_score", f"WITH {YEARS} SELECT o_orderkey, cast(best AS int) AS best FROM years")
def best_score(t):
    found = rp.parse_recordings(t.recordings_replies)
    return found.select("o_orderkey", ns.best_score(F.col("recordings")).alias("best"))


@query(
    "blend_year",
    f"""WITH {YEARS} SELECT o_orderkey, coalesce(substr(cast(release_year AS varchar), 1, 3),
    substr(cast(o_orderdate AS varchar), 1, 3)) || '0s' AS decade FROM years JOIN orders USING (o_orderkey)""",
)
def blend_year(t):
    found = rp.release_years(t.recordings_replies)
    debut = F.concat(F.substring("order_year", 1, 3), F.lit("0s"))
    return found.select("o_orderkey", ns.blend_decade(F.col("release_decade"), debut).alias("decade"))


@query("event_props_json", "SELECT event_id, cast(json_extract_string(props, '$.k') AS int) AS k FROM events")
def event_props_json(t):
    return t.table("events").select("event_id", ns.parse(F.col("props"), "struct<k: int>")["k"].alias("k"))
