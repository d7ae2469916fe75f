"""Prefix trie of conversations: which beginnings are shared, by how many, and what sharing saves.

Turns are numbered and a running exclusive or of hashed (place, turn) pairs gives every prefix a
128-bit digest, slot by slot, so that a conversation may be of any length. A count-min sketch of
the digests screens them: an estimate of one proves that a prefix belongs to a single
conversation. Its node, and all nodes below it, are written where they are, with nothing shuffled.
Only prefixes that may be shared are grouped exactly.

Sums over subtrees take no walk through the tree. Every node is owned by its smallest member, so a
conversation owns the end of its own path. What it owns below a depth is a running sum from its
end, and a node's subtree is the sum of that over its members.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkrank.llm import arrow, sketch
from linkrank.llm.registry import query
from linkrank.llm.stages import read, release, store
from linkrank.operators.joins import lookup_join
from linkrank.operators.rank import numbered

_IDS = 12  #: bits of the ids that are joined to one text at a time

#: Columns of the result.
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def turns_of(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Numbered turns: conv, pos (from 1), d1, d2 (a digest of role and text), chars.

    Turns are ordered by turn, NULL first, ties by role and then by text, NULL last. A NULL role or
    text is empty; rows without a conversation id are no part of any conversation and are left out.
    Texts are not moved but for turns that differ in nothing else.
    """
    raw_role, raw_text = F.col(role_col), F.col(text_col)
    role, text = F.coalesce(raw_role, F.lit("")), F.coalesce(raw_text, F.lit(""))
    digest = F.sha2(F.concat_ws(":", F.length(role).cast("string"), role, text), 256)
    named = turns.select(
        F.struct(F.col(conv_col).cast("long").alias("conv"), F.col(turn_col).alias("turn"), raw_role.alias("role")).alias("place"),
        *(F.conv(F.substring(digest, 16 * k + 1, 16), 16, -10).cast("long").alias(f"d{k + 1}") for k in range(2)),
        F.length(text).cast("long").alias("chars"),
        raw_text.isNull().alias("no_text"),
        raw_text.alias("text"),
    ).where("place.conv is not null")
    rows = store(named.drop("text"))
    order = ["turn", F.col("role").asc_nulls_last(), "no_text", "nth", "d1", "d2"]
    rows = _by_text(rows, named).select("place.*", "no_text", "nth", "d1", "d2", "chars")
    return numbered(rows, ["conv"], order, "pos").select("conv", F.col("pos").cast("long").alias("pos"), "d1", "d2", "chars")


def _by_text(rows: DataFrame, named: DataFrame) -> DataFrame:
    """Add nth: a text's number, by ascending text, among those of one conversation, turn and role;
    0 where there is one text only, as nearly everywhere. ``named`` has the texts of ``rows``."""
    texts = rows.where("not no_text").groupBy("place").agg(*(f(F.struct("d1", "d2")).alias(n) for n, f in (("low", F.min), ("high", F.max))))
    tied = store(texts.where("low <> high").select("place"))
    if tied.isEmpty():
        return rows.withColumn("nth", F.lit(0))
    apart = lookup_join(named.where("not no_text").select("place", "d1", "d2", "text"), tied, ["place"], "left_semi").distinct()
    nth = numbered(apart, ["place"], [F.col("text")], "nth").drop("text")
    return rows.join(nth, ["place", "d1", "d2"], "left").withColumn("nth", F.coalesce("nth", F.lit(0)))


def with_lengths(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Numbered turns as they are: conv, length, pos, d1, d2, chars; and conv, length."""
    members = store(turns.groupBy("conv").agg(F.count("*").alias("length")))
    return turns.join(members, "conv"), members


def rebuilt(turns: DataFrame, most: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: the first h turns of conversation
    c - c % every, then c's own turns after its first h, with h = crc32(c) % most.

    Takes numbered turns; returns conv, length, pos, d1, d2, chars; and conv, length, also of
    conversations that are left without turns.
    """
    counts = turns.groupBy("conv").agg(F.count("*").alias("n"))
    heads = turns.where((F.col("conv") % every == 0) & (F.col("pos") < most))
    heads = heads.groupBy(F.col("conv").alias("base")).agg(F.sort_array(F.collect_list(F.struct("pos", "d1", "d2", "chars"))).alias("head"))
    plan = counts.select(
        "conv", "n", (F.crc32(F.col("conv").cast("string")) % most).cast("int").alias("h"), (F.col("conv") - F.col("conv") % every).alias("base")
    )
    plan = plan.join(heads, "base", "left").withColumn("head", F.when(F.col("head").isNotNull(), F.slice("head", 1, F.col("h"))))
    taken = F.coalesce(F.size("head"), F.lit(0))
    taken = F.when(taken > 0, taken).otherwise(0)  # the size of NULL is -1 in some settings
    members = plan.select("conv", "h", "head", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length"))
    members = store(members)
    first = members.select("conv", "length", F.explode("head").alias("t")).select("conv", "length", "t.pos", "t.d1", "t.d2", "t.chars")
    own = turns.join(members.select("conv", "h", "taken", "length"), "conv").where("pos > h")
    own = own.select("conv", "length", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "d1", "d2", "chars")
    return first.unionByName(own), members.select("conv", "length")


Running = tuple[Callable[[str], Column], Callable[[Column, Column], Column]]
_XOR: Running = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))
_SUM: Running = (F.sum, lambda a, b: a + b)
_MAX: Running = (F.max, F.greatest)


def _running(rows: DataFrame, order: str, what: dict[str, Running]) -> DataFrame:
    """Replace columns by their running aggregates within a conversation, in ascending ``order``.

    Rows are range-partitioned into slots and stored. A slot's rows go on from the aggregates of
    earlier slots, which only conversations that cross a border have: two rows a slot at most.
    """
    slotted = store(rows.repartitionByRange("conv", order).withColumn("slot", F.spark_partition_id()))
    totals = slotted.groupBy("conv", "slot").agg(*(f(c).alias(c) for c, (f, _) in what.items()))
    earlier = Window.partitionBy("conv").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("conv", "slot", *(f(c).over(earlier).alias(f"before_{c}") for c, (f, _) in what.items()))
    before = before.where(f"before_{next(iter(what))} is not null")
    here = Window.partitionBy("conv", "slot").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = slotted.withColumns({c: f(c).over(here) for c, (f, _) in what.items()})
    joined = inside.join(F.broadcast(before), ["conv", "slot"], "left")
    both = {c: F.coalesce(combine(F.col(c), F.col(f"before_{c}")), F.col(c)) for c, (_, combine) in what.items()}
    return joined.withColumns(both).select(*rows.columns)


def _prefix_digests(turns: DataFrame) -> DataFrame:
    """Add p1, p2 (the prefix that ends here) and q1, q2 (the one before it)."""
    own = {"r1": F.xxhash64("pos", "d1", "d2"), "r2": F.xxhash64("d2", "d1", F.lit(7), "pos")}
    rows = turns.withColumns(own).withColumns({"p1": F.col("r1"), "p2": F.col("r2")})
    rows = _running(rows.select("conv", "length", "pos", "chars", "r1", "r2", "p1", "p2"), "pos", {"p1": _XOR, "p2": _XOR})
    parents = [F.col(f"p{k}").bitwiseXOR(F.col(f"r{k}")).alias(f"q{k}") for k in (1, 2)]
    return rows.select("conv", "length", "pos", "chars", "p1", "p2", *parents)


def _hashes(batch: pa.RecordBatch, one: str, two: str) -> np.ndarray:
    one, two = (batch.column(batch.schema.get_field_index(x)).to_numpy().view(np.uint64) for x in (one, two))
    return arrow.mix(one) ^ two


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    return (_hashes(batch, "p1", "p2") for batch in batches)


def _screen(repeated):
    """Add whether the prefix, and the one before it, may be shared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [pa.array(repeated.value.may_have(_hashes(batch, *names))) for names in (("p1", "p2"), ("q1", "q2"))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, "shared", "below_shared"])

    return run


def _streamed_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each key's texts, joined by commas; rows are sorted by key and chunk."""
    now, state = None, None

    def finished() -> pa.RecordBatch:
        columns = [pa.array([x], pa.int64()) for x in now]
        return pa.RecordBatch.from_arrays([*columns, pa.array([state.hexdigest()])], ["depth", "p1", "p2", "ends"])

    for batch in batches:
        for *key, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
            if key != now:
                if now is not None:
                    yield finished()
                now, state = key, hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if now is not None:
        yield finished()


def _ends(ended: DataFrame) -> DataFrame:
    """depth, p1, p2, ends: the digest of the ids of the conversations that end at a node.

    Ids are joined to texts some thousand at a time wherever they are, so the task that must read
    a node's ids in order reads few rows and holds none.
    """
    key = ["depth", "p1", "p2"]
    some = ended.withColumn("chunk", F.shiftright("conv", _IDS)).groupBy(*key, "chunk").agg(F.sort_array(F.collect_list("conv")).alias("ids"))
    some = some.select(*key, "chunk", F.array_join(F.col("ids").cast("array<string>"), ",").alias("text"))
    some = some.repartition(*key).sortWithinPartitions(*key, "chunk").select(*key, "text")
    return some.mapInArrow(_streamed_digests, "depth bigint, p1 bigint, p2 bigint, ends string")


def trie(turns: DataFrame, members: DataFrame) -> DataFrame:
    """One row per node of the trie of all prefixes; see ``COLUMNS``.

    ``turns`` has conv, length, pos, d1, d2, chars, one row for each place of each conversation;
    ``members`` has conv and length of all conversations. A node is named by its smallest member
    and its depth; the root stands for the empty prefix and has a NULL parent. No members, no rows.
    """
    spark = turns.sparkSession
    rows = store(_prefix_digests(turns))
    release(spark)
    again = sketch.repeated(rows.select("p1", "p2"), _digests, sketch.cells_for(rows.count()))
    schema = "conv bigint, length bigint, pos bigint, chars bigint, p1 bigint, p2 bigint, q1 bigint, q2 bigint, shared boolean, below_shared boolean"
    screened = store(rows.mapInArrow(_screen(again), schema))
    again.unpersist()
    release(spark)

    at, before = ["p1", "p2"], ["q1", "q2"]
    shared = screened.where("shared")
    single = screened.where("not shared")
    tops = single.where("below_shared and pos > 1")
    nodes = shared.groupBy(*at).agg(
        F.count("*").alias("n_convs"),
        F.min("conv").alias("owner"),
        F.max("length").alias("longest"),
        *(F.min(c).alias(c) for c in ("pos", "chars", *before)),
    )
    nodes = store(nodes)

    # What conversations own at and below each depth, and the sums of that over members.
    mine = shared.select("conv", "pos", "length", *at).join(nodes.select(*at, "n_convs", "owner", "longest", "chars"), at)
    is_owner = F.col("conv") == F.col("owner")
    leaf = F.when(is_owner & (F.col("pos") == F.col("length")) & (F.col("longest") == F.col("pos")), 1).otherwise(0)
    saved = F.when(is_owner, (F.col("n_convs") - 1) * F.col("chars")).otherwise(0)
    mine = mine.select("conv", (-F.col("pos")).alias("up"), *at, saved.cast("long").alias("saved"), leaf.cast("long").alias("leaf"))
    nothing = F.lit(None).cast("long")
    below = tops.select("conv", (-F.col("pos")).alias("up"), nothing.alias("p1"), nothing.alias("p2"), F.lit(0).cast("long").alias("saved"), F.lit(1).cast("long").alias("leaf"))
    owned = _running(mine.unionByName(below), "up", {"saved": _SUM, "leaf": _MAX}).where("p1 is not null")
    sums = owned.groupBy(*at).agg(F.sum("saved").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"))
    children = nodes.where("pos > 1").select(*before).unionByName(tops.select(*before)).groupBy(*before).agg(F.count("*").alias("n_children"))
    children = children.withColumnsRenamed({"q1": "p1", "q2": "p2"})
    parents = nodes.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("owner").alias("parent"))
    root = members.agg(F.min("conv").alias("c")).first()["c"]
    root = F.lit(root).cast("long")

    ended = shared.where("pos = length").select("conv", F.col("pos").alias("depth"), *at)
    zero = F.lit(0).cast("long")
    ended = ended.unionByName(members.where("length = 0").select("conv", zero.alias("depth"), zero.alias("p1"), zero.alias("p2")))
    ends = store(_ends(ended))
    none = F.sha2(F.lit(""), 256)

    known = nodes.join(sums, at).join(children, at, "left").join(parents, before, "left")
    known = known.join(ends.where("depth > 0").select(*at, "ends"), at, "left")
    known = known.select(
        F.col("owner").alias("conv_id"),
        F.col("pos").alias("depth"),
        F.when(F.col("pos") == 1, root).otherwise(F.coalesce("parent", "owner")).alias("parent_conv_id"),  # no parent found: one member
        "n_convs",
        F.coalesce("n_children", zero).alias("n_children"),
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", none).alias("ends_sha256"),
    )

    last = F.col("pos") == F.col("length")
    alone = [
        F.lit(1).cast("long").alias("n_convs"),
        F.when(last, 0).otherwise(1).cast("long").alias("n_children"),
        F.lit(1).cast("long").alias("n_leaves"),
        zero.alias("saved_tokens"),
        F.when(last, F.sha2(F.col("conv").cast("string"), 256)).otherwise(none).alias("ends_sha256"),
    ]
    tails = single.where("not (below_shared and pos > 1)")
    parent = F.when(F.col("pos") == 1, root).otherwise(F.col("conv"))
    tails = tails.select(F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), parent.alias("parent_conv_id"), *alone)
    heads = tops.join(parents, before, "left").select(
        F.col("conv").alias("conv_id"), F.col("pos").alias("depth"), F.coalesce("parent", "conv").alias("parent_conv_id"), *alone
    )
    return known.unionByName(tails).unionByName(heads).unionByName(_root(members, nodes, single, ends, none)).select(*COLUMNS)


def _root(members: DataFrame, nodes: DataFrame, single: DataFrame, ends: DataFrame, none: Column) -> DataFrame:
    """The root's row, added up from one-row aggregates."""
    zero, no_id = F.lit(0).cast("long"), F.lit(None).cast("long")

    def part(df: DataFrame, **given: Column) -> DataFrame:
        columns = {"n_convs": zero, "conv_id": no_id, "n_children": zero, "n_leaves": zero, "saved_tokens": zero, "ends": F.lit(None).cast("string")}
        return df.agg(*(x.cast("string" if name == "ends" else "long").alias(name) for name, x in (columns | given).items()))

    parts = part(members, n_convs=F.count("*"), conv_id=F.min("conv"))
    saved = F.sum((F.col("n_convs") - 1) * F.col("chars"))
    parts = parts.unionByName(part(nodes, n_children=F.count_if(F.col("pos") == 1), n_leaves=F.count_if(F.col("longest") == F.col("pos")), saved_tokens=saved))
    parts = parts.unionByName(part(single, n_children=F.count_if(F.col("pos") == 1), n_leaves=F.count_if(F.col("pos") == F.col("length"))))
    parts = parts.unionByName(part(ends.where("depth = 0"), ends=F.max("ends")))
    found = parts.agg(
        F.min("conv_id").alias("conv_id"), *(F.sum(x).alias(x) for x in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("ends").alias("ends")
    )
    return found.where("n_convs > 0").select(
        "conv_id",
        zero.alias("depth"),
        no_id.alias("parent_conv_id"),
        "n_convs",
        "n_children",
        F.greatest("n_leaves", F.lit(1).cast("long")).alias("n_leaves"),
        F.coalesce("saved_tokens", zero).alias("saved_tokens"),
        F.coalesce("ends", none).alias("ends_sha256"),
    )


def conversation_trie(turns: DataFrame, **columns: str) -> DataFrame:
    """The trie of a table of turns; see ``turns_of`` and ``trie``.

    Repeated rows are turns of their own; other columns are ignored; an empty table gives no rows.
    """
    return trie(*with_lengths(store(turns_of(turns, **columns))))


_CRC = (
    "xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(string_split(c::VARCHAR, ''), lambda x: ascii(x)::UBIGINT)), "
    "lambda s, b: list_reduce(list_prepend(xor(s, b), [0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[]), "
    "lambda t, k: xor(t >> 1, (t & 1) * 3988292384::UBIGINT))), 4294967295::UBIGINT)"
)

_SQL = f"""
WITH ordered AS MATERIALIZED (
  SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS n
  FROM conversations WHERE conv_id IS NOT NULL
), sizes AS MATERIALIZED (
  SELECT c, count(*) AS total, CAST({_CRC} % 6 AS BIGINT) AS h FROM ordered GROUP BY c
), rebuilt AS (
  SELECT s.c, o.n AS d, o.role, o.text FROM sizes s JOIN ordered o ON o.c = s.c - s.c % 100 AND o.n <= s.h
  UNION ALL
  SELECT s.c, o.n - s.h + least(s.h, coalesce(b.total, 0)), o.role, o.text
  FROM sizes s JOIN ordered o ON o.c = s.c AND o.n > s.h LEFT JOIN sizes b ON b.c = s.c - s.c % 100
), prefix AS MATERIALIZED (
  SELECT c, d, length(text) AS chars,
         sha256(string_agg(sha256(length(role) || ':' || role || ':' || text), '') OVER (PARTITION BY c ORDER BY d)) AS node FROM rebuilt
  UNION ALL SELECT c, 0, 0, '' FROM sizes
), paths AS MATERIALIZED (
  SELECT *, lag(node) OVER (PARTITION BY c ORDER BY d) AS parent, max(d) OVER (PARTITION BY c) AS len FROM prefix
), nodes AS MATERIALIZED (
  SELECT node, min(d) AS d, min(c) AS m, count(*) AS n, min(chars) AS chars, min(parent) AS parent, max(len) AS longest,
         sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (d = len), '')) AS ends
  FROM paths GROUP BY node
), inside AS (
  SELECT a.node, count(*) FILTER (b.longest = b.d) AS leaves, sum((b.n - 1) * b.chars) AS saved
  FROM nodes b JOIN paths a ON a.c = b.m AND a.d <= b.d GROUP BY a.node
), children AS (SELECT parent AS node, count(*) AS n FROM nodes WHERE parent IS NOT NULL GROUP BY parent)
SELECT x.m AS conv_id, CAST(x.d AS BIGINT) AS depth, p.m AS parent_conv_id, x.n AS n_convs, coalesce(k.n, 0) AS n_children,
       i.leaves AS n_leaves, CAST(i.saved AS BIGINT) AS saved_tokens, x.ends AS ends_sha256
FROM nodes x JOIN inside i ON i.node = x.node LEFT JOIN children k ON k.node = x.node LEFT JOIN nodes p ON p.node = x.parent
"""


@query("op12_conversation_trie", _SQL)
def rebuilt_trie(spark: SparkSession, folder: str) -> DataFrame:
    return trie(*rebuilt(store(turns_of(read(spark, folder, "conversations")))))
