"""Near-duplicate documents by MinHash with tensored banding, every link confirmed on full sets.

Two collections of ``BANDS`` partial keys, each made of ``ROWS`` MinHash values, stand for
``BANDS * BANDS`` tables: a table's key combines one partial key of either collection. So two
documents meet in a table when they agree on a partial key in both collections, and the number of
MinHash values is about the square root of what as many independent tables would take. At a
similarity s they miss each other with a probability below 2 * (1 - s ** ROWS) ** BANDS, which is
1.6e-4 at 0.8 and 2e-6 at 0.85.

Documents with equal sets are one class from the start. Partial keys that only one class has are
dropped before table keys are formed. In a table's bucket a few centres are linked to the other
members instead of linking all pairs; after the confirmed links are joined into components, the
pairs of a bucket that are still in different components are compared too, inside the join that
finds them, so no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.components import components
from linkrank.llm.registry import query
from linkrank.llm.stages import NO_ID, given_id, known_id, read, release, store, whole_text

ROWS = 4
BANDS = 18
CENTRES = 3
_BLOCK = 1 << 18
_FACTOR = np.uint64(0x9FB21C651E98DF25)

_HASHES = 2 * ROWS * BANDS
_SEEDS = arrow.mix(np.arange(1, 2 * _HASHES + 1, dtype=np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F)).astype(np.uint32)
_XOR, _TIMES = _SEEDS[:_HASHES, None], (_SEEDS[_HASHES:] | np.uint32(1))[:, None]


def shingle_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    """Hashes of the distinct word shingles of each text, sorted. A text of fewer words than
    ``size`` has its whole sequence as one; a text without words has none."""
    words = arrow.find_words(data, bounds)
    hashes = arrow.range_hashes(arrow.LOWER[data], words.start, words.end)
    n = len(hashes)
    joined = arrow.sequence_hashes(hashes, slice(0, max(0, n - size + 1)), range(size))
    out = []
    for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(joined[a : b - size + 1]))
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for k in range(a, b):
                whole = arrow.mix(whole * _FACTOR + hashes[k : k + 1])
            out.append(whole)
        else:
            out.append(hashes[:0])
    return out


def signature(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)
    step = max(1, _BLOCK // len(x))
    out = np.empty(_HASHES, np.uint32)
    for a in range(0, _HASHES, step):
        out[a : a + step] = ((x ^ _XOR[a : a + step]) * _TIMES[a : a + step]).min(axis=1)
    return out


def partial_keys(signatures: np.ndarray) -> np.ndarray:
    """One key per band, of both collections: shape (sets, 2 * BANDS)."""
    values = signatures.reshape(len(signatures), 2 * BANDS, ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, 2 * BANDS + 1, dtype=np.uint64), values.shape[:2])
    for k in range(ROWS):
        keys = arrow.mix(keys * _FACTOR + values[:, :, k])
    return keys


def _describe(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = arrow.raw_bytes(batch.column(1))
            for low, high in arrow.chunks(at):
                sets = shingle_sets(whole[at[low] : at[high]], at[low : high + 1] - at[low], size)
                first = np.array([x.sum(dtype=np.uint64) for x in sets], np.uint64)
                second = np.array([arrow.mix(x + _FACTOR).sum(dtype=np.uint64) for x in sets], np.uint64)
                full = [x for x in sets if len(x)]
                keys = np.zeros((len(sets), 2 * BANDS), np.uint64)
                if full:
                    keys[[bool(len(x)) for x in sets]] = partial_keys(np.stack([signature(x) for x in full]))
                bands = [BANDS] * len(sets)
                columns = [
                    batch.column(0).slice(low, high - low),
                    arrow.longs(np.array([len(x) for x in sets], np.int64)),
                    arrow.longs(first),
                    arrow.longs(second),
                    arrow.lists(np.ascontiguousarray(keys[:, :BANDS]).ravel(), bands),
                    arrow.lists(np.ascontiguousarray(keys[:, BANDS:]).ravel(), bands),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "h1", "h2", "left", "right"])

    return run


def _sets(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = arrow.raw_bytes(batch.column(1))
            for low, high in arrow.chunks(at):
                sets = shingle_sets(whole[at[low] : at[high]], at[low : high + 1] - at[low], size)
                values = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
                columns = [batch.column(0).slice(low, high - low), arrow.lists(values, [len(x) for x in sets])]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "shingles"])

    return run


def _shared_keys(classes: DataFrame) -> DataFrame:
    """Classes with their partial keys that another class has too: rep, n, l, r."""
    sides = F.array(
        F.struct(F.lit(0).alias("right"), F.col("left").alias("keys")),
        F.struct(F.lit(1).alias("right"), F.col("right").alias("keys")),
    )
    keys = classes.select("rep", "n", F.explode(sides).alias("side"))
    keys = keys.select("rep", "n", "side.right", F.explode("side.keys").alias("key"))
    shared = keys.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key")
    both = keys.join(shared, "key", "left_semi").groupBy("rep", "n").agg(
        F.collect_list(F.when(F.col("right") == 0, F.col("key"))).alias("l"),
        F.collect_list(F.when(F.col("right") == 1, F.col("key"))).alias("r"),
    )
    return both.where((F.size("l") > 0) & (F.size("r") > 0))


def _table_members(keyed: DataFrame) -> DataFrame:
    """One row per table key of a class: t, rep, n."""
    tables = keyed.select("rep", "n", F.explode("l").alias("l"), "r")
    tables = tables.select("rep", "n", "l", F.explode("r").alias("r"))
    return tables.select(F.xxhash64("l", "r").alias("t"), "rep", "n")


def _alike(percent: int):
    """Two sets can only be similar enough if their sizes are."""
    return 100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")


def _with_short_sets(apart: DataFrame, sets: DataFrame) -> DataFrame:
    """Classes that are still apart with their sets cut to 32 bits a shingle, and how many
    shingles fell together by that."""
    short = F.transform("shingles", lambda x: F.shiftright(x, 32).cast("int"))
    short = sets.select(F.col("doc").alias("rep"), F.array_distinct(short).alias("short"), F.size("shingles").alias("n"))
    return apart.join(short.select("rep", "n", "short", (F.col("n") - F.size("short")).alias("lost")), "rep")


def _unlinked_pairs(classes: DataFrame, percent: int) -> DataFrame:
    """Pairs of classes that share a table key, are in different components and may be similar
    enough by their short sets, once: in the bucket of their first common left key.

    Members of a bucket's largest component are not compared with each other: every member of
    another component meets the whole bucket. Which buckets hold several components is found out
    on ids; only then sets are joined to them, one row per class, so that Spark can split a large
    bucket. The join itself compares the sets, so the pairs of a bucket of loose copies are not
    made. Short sets never hide a link: what fell together is added to the common shingles.
    """
    ids = classes.select("rep", "component", F.explode("l").alias("key"))
    sizes = ids.groupBy("key", "component").agg(F.count("*").alias("c"))
    mixed = sizes.groupBy("key").agg(F.max_by("component", F.struct("c", "component")).alias("largest"), F.count("*").alias("k")).where("k > 1")
    chosen = ids.join(mixed, "key").groupBy("rep").agg(
        F.collect_list(F.struct("key", "largest")).alias("keys"),
        F.collect_list(F.when(F.col("component") != F.col("largest"), F.col("key"))).alias("apart"),
    )
    rows = store(classes.join(chosen, "rep"))
    kept = ("rep", "n", "l", "r", "component", "short", "lost")
    x = rows.select(F.explode("apart").alias("key"), *[F.col(c).alias(f"{c}a") for c in kept])
    y = rows.select(F.inline("keys"), *[F.col(c).alias(f"{c}b") for c in kept])
    common = F.size(F.array_intersect("shorta", "shortb")) + F.col("losta") + F.col("lostb")
    possible = (
        (F.col("componenta") != F.col("componentb"))
        & ((F.col("repa") < F.col("repb")) | (F.col("componentb") == F.col("largest")))
        & _alike(percent)
        & F.arrays_overlap("ra", "rb")
        & (F.array_min(F.array_intersect("la", "lb")) == F.col("key"))
        & (100 * common >= percent * (F.col("na") + F.col("nb") - common))
    )
    pairs = x.join(y, "key").where(possible)
    return pairs.select(F.least("repa", "repb").alias("a"), F.greatest("repa", "repb").alias("b"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc").alias("b"), F.col("shingles").alias("sb"))
    both = pairs.select("a", "b").join(right, "b").join(left, "a")
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return both.where(100 * common >= percent * union).select("a", "b")


def group(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their shingle sets have 100 * common >= percent * union. A NULL or
    empty text, or one without words, has an empty set and is linked with nothing. Rows that repeat
    an id are one document, linked by any of their texts; a row with a NULL id has no name that could stand for a group, so it
    is linked with nothing, its component_id is NULL and it is kept. An empty table gives no
    rows; other columns are ignored.
    """
    rows = docs.select(known_id(id_col).alias("doc"), whole_text(text_col).alias("text"))
    schema = "doc bigint, n bigint, h1 bigint, h2 bigint, left array<bigint>, right array<bigint>"
    described = store(rows.mapInArrow(_describe(size), schema))
    known = described.where((F.col("n") > 0) & (F.col("doc") != NO_ID))
    classes = known.groupBy("n", "h1", "h2").agg(
        F.min("doc").alias("rep"), F.first("left").alias("left"), F.first("right").alias("right")
    )
    classes = store(classes)
    keyed = store(_shared_keys(classes))
    members = store(_table_members(keyed))
    release(docs.sparkSession)

    # The centres of a bucket: the smallest id, and the smallest by a few other orders.
    orders = [F.col("rep"), *(F.xxhash64("rep", F.lit(k)) for k in range(1, CENTRES))]
    centres = members.groupBy("t").agg(
        F.count("*").alias("c"), *(F.min(F.struct(o.alias("o"), "rep", "n")).alias(f"c{k}") for k, o in enumerate(orders))
    )
    centres = centres.where("c > 1").select("t", F.explode(F.array_distinct(F.array(*[F.struct(f"c{k}.rep", f"c{k}.n") for k in range(CENTRES)]))).alias("m"))
    centres = centres.select("t", F.col("m.rep").alias("cr"), F.col("m.n").alias("cn"))
    stars = members.join(centres, "t").where("rep <> cr")
    stars = stars.select(F.least("rep", "cr").alias("a"), F.greatest("rep", "cr").alias("b"), F.col("n").alias("na"), F.col("cn").alias("nb"))
    stars = store(stars.where(_alike(percent)).select("a", "b").distinct())

    shared = members.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    involved = members.join(shared, "t", "left_semi").select(F.col("rep").alias("doc")).distinct()
    texts = rows.join(involved, "doc", "left_semi")
    sets = texts.mapInArrow(_sets(size), "doc bigint, shingles array<bigint>")
    sets = store(sets)
    release(docs.sparkSession)
    links = store(_confirmed(stars, sets, percent))
    found = store(components(links))

    # Pairs of a bucket that the centres did not bring together.
    labels = found.select(F.col("node").alias("rep"), F.col("component"))
    placed = members.join(shared, "t", "left_semi").join(labels, "rep", "left")
    placed = placed.select("t", "rep", F.coalesce("component", "rep").alias("component"))
    apart = placed.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
    apart = store(placed.join(apart.select("t"), "t", "left_semi").select("rep", "component").distinct())
    left_over = store(keyed.join(_with_short_sets(apart, sets), ["rep", "n"]))
    pairs = _unlinked_pairs(left_over, percent).distinct().join(stars, ["a", "b"], "left_anti")
    more = store(_confirmed(pairs, sets, percent))
    if not more.isEmpty():
        found = store(components(links.union(more)))

    reps = classes.select("n", "h1", "h2", "rep")
    reps = reps.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left")
    reps = reps.select("n", "h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = described.select("doc", "n", "h1", "h2").join(reps, ["n", "h1", "h2"], "left")
    component = F.when((F.col("n") > 0) & (F.col("doc") != NO_ID), F.col("component")).otherwise(given_id("doc"))
    out = out.select(given_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


#: Names of further texts of an id come after all ordinary ids.
_FURTHER = 1 << 62


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, the one with the smallest id, with all columns.

    Rows with one id and different texts are different documents: each stays unless it is linked
    with another. Of rows with one id and one text, one stays. Rows with a NULL id all stay; an
    empty table gives no rows.
    """
    given = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("_id"), whole_text(text_col).alias("_text"))
    given = given.withColumn("_tie", F.xxhash64("_text"))
    many = given.where("_id is not null").groupBy("_id").agg(F.min("_tie").alias("_first"), F.count("*").alias("_n")).where("_n > 1")
    given = given.join(store(many), "_id", "left")
    first = F.col("_n").isNull() | (F.col("_tie") == F.col("_first"))
    further = F.shiftrightunsigned(F.xxhash64("_id", "_tie"), 2) + F.lit(_FURTHER)
    given = given.withColumn("_key", F.when(first, F.col("_id")).otherwise(further))

    verdicts = group(given.select(F.col("_key").alias("key"), F.col("_text").alias("text")), "key", "text", **options)
    keep = verdicts.where("kept and doc_id is not null").select(F.col("doc_id").alias("_key")).distinct()
    named = given.where("_key is not null").join(keep, "_key", "left_semi")
    again = named.where("_n is not null").groupBy("_key").agg(F.min_by("row", F.to_json("row")).alias("row"))
    out = named.where("_n is null").select("row.*").unionByName(again.select("row.*"))
    return out.unionByName(given.where("_key is null").select("row.*"))


@query("op1_near_duplicates")
def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return group(read(spark, folder, "documents"), size=2)
