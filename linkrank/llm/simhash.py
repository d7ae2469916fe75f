"""Near-duplicate documents by SimHash fingerprints, compared exactly tile by tile.

A bit of a document's fingerprint is 1 if it is set in over half the hashes of its word shingles.
Documents are linked when their fingerprints differ in at most ``RADIUS`` bits.

Equal fingerprints are one class. Fingerprints within the radius agree on at least one of
``RADIUS + 1`` equal parts of their bits, so classes are dealt to lots, one for each part and its
value, and only those of one lot are compared. A lot is cut into tiles of at most ``TILE``
fingerprints, by the number of ones in them. Two tiles are compared by exclusive or and bit
counts, unless their numbers of ones differ by more than the radius: then no link is possible and
they never meet. The same rule skips blocks within a pair of tiles. Of a pair of tiles a task
returns links enough to connect what is connected, at most one per fingerprint, never all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkrank.llm import arrow
from linkrank.llm.components import components
from linkrank.llm.registry import query
from linkrank.llm.stages import NO_ID, given_id, known_id, read, release, store, whole_text

SIZE = 3  #: words in a shingle
SEED = 42
RADIUS = 3
TILE = 4096  #: fingerprints compared with each other at once
_BLOCK = 256
_SPACE = 0x20
_COUNTED = 1 << 16  #: hashes whose bits are counted together


def _joined_words(data: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The lower-cased words of a text with one space between them; where each begins and ends."""
    words = arrow.find_words(data, np.array([0, len(data)]))
    length = words.end - words.start
    end = np.cumsum(length + 1) - 1
    joined = np.full(int(end[-1]) if len(end) else 0, _SPACE, np.uint8)
    lower = arrow.LOWER[data]
    if len(end):
        word = np.zeros(len(joined) + 1, bool)
        word[end - length] = True
        word[end] ^= True
        inside = np.logical_xor.accumulate(word[:-1])
        joined[inside] = lower[~arrow.IS_SPACE[data]]
    return joined.tobytes(), end - length, end


def fingerprint(data: np.ndarray, size: int = SIZE, seed: int = SEED) -> int:
    """The 64-bit fingerprint of a text in UTF-8 bytes; zero if it has no words.

    Fewer words than a shingle count as one shingle. Repeated shingles count as often as they occur.
    """
    joined, start, end = _joined_words(data)
    if not len(start):
        return 0
    last = end[size - 1 :] if len(end) >= size else end[-1:]
    n, ones = len(last), np.zeros(64, np.int64)
    hashed = xxhash.xxh64_intdigest
    for low in range(0, n, _COUNTED):
        bounds = zip(start[low : low + _COUNTED].tolist(), last[low : low + _COUNTED].tolist(), strict=False)
        hashes = np.fromiter((hashed(joined[a:b], seed) for a, b in bounds), np.uint64)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<u8")[0])


def _describe(size: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = arrow.raw_bytes(batch.column(1))
            found = [fingerprint(whole[a:b], size, seed) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), arrow.longs(np.array(found, np.uint64))], ["doc", "print"])

    return run


def _connect(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between two blocks of fingerprints, enough to connect what is connected: numbers of
    ``a``, and of ``b`` counted on from there."""
    close = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
    rows, columns = np.flatnonzero(close.any(axis=1)), np.flatnonzero(close.any(axis=0))
    if not len(rows):
        return rows, columns
    close = close[np.ix_(rows, columns)]
    n = len(rows)
    label_a, label_b = np.arange(n), np.full(len(columns), n)
    while True:  # the smallest label spreads along the links
        label_b = np.minimum(label_b, np.where(close, label_a[:, None], n).min(axis=0))
        least = np.minimum(label_a, np.where(close, label_b[None, :], n).min(axis=1))
        if (least == label_a).all():
            break
        label_a = least
    moved = np.flatnonzero(label_a != np.arange(n))
    ends = np.concatenate([rows[moved], columns + len(a)])
    return np.concatenate([rows[label_a[moved]], rows[label_b]]), ends


def tile_links(left: np.ndarray, right: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links between two tiles, or within one, as numbers into all fingerprints of both.

    Both are sorted by their numbers of ones, so that a block meets only those blocks whose
    numbers are within the radius.
    """
    same = right is None
    right = left if same else right
    by_a, by_b = np.argsort(np.bitwise_count(left), kind="stable"), np.argsort(np.bitwise_count(right), kind="stable")
    a, b = left[by_a], right[by_b]
    ones_a, ones_b = np.bitwise_count(a).astype(np.int64), np.bitwise_count(b).astype(np.int64)
    number_a, number_b = by_a, by_b if same else by_b + len(left)
    found_a, found_b = [], []
    for low in range(0, len(a), _BLOCK):
        block = a[low : low + _BLOCK]
        first = low if same else int(np.searchsorted(ones_b, ones_a[low] - radius, "left"))
        last = int(np.searchsorted(ones_b, ones_a[low + len(block) - 1] + radius, "right"))
        for at in range(first, last, _BLOCK * 8):
            other = b[at : min(last, at + _BLOCK * 8)]
            x, y = _connect(block, other, radius)
            names = np.concatenate([number_a[low : low + len(block)], number_b[at : at + len(other)]])
            found_a.append(names[x])
            found_b.append(names[y])
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    x, y = np.concatenate(found_a), np.concatenate(found_b)
    return x[x != y], y[x != y]


def _compare(radius: int):
    """Rows of a pair of tiles: the fingerprints and representatives of either side."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out_a, out_b = [], []
            sides = []
            for k in range(2):
                column = batch.column(k)
                at = np.append(column.offsets.to_numpy(), 0)[: len(column) + 1]
                flat = column.values
                sides.append((at, flat.field(0).to_numpy().view(np.uint64), flat.field(1).to_numpy()))
            (at_a, print_a, rep_a), (at_b, print_b, rep_b) = sides
            for i in range(len(batch)):
                a, b = slice(at_a[i], at_a[i + 1]), slice(at_b[i], at_b[i + 1])
                same = b.stop == b.start
                x, y = tile_links(print_a[a], None if same else print_b[b], radius)
                reps = rep_a[a] if same else np.concatenate([rep_a[a], rep_b[b]])
                out_a.append(reps[x])
                out_b.append(reps[y])
            columns = [arrow.longs(np.concatenate(x) if x else np.zeros(0, np.int64)) for x in (out_a, out_b)]
            yield pa.RecordBatch.from_arrays(columns, ["a", "b"])

    return run


def _lots(classes: DataFrame, radius: int) -> DataFrame:
    """One row per class and lot: part, value, ones, print, rep; lots of one class are left out."""
    n = radius + 1
    bounds = [64 * k // n for k in range(n + 1)]
    parts = [
        F.struct(
            F.lit(k).alias("part"),
            F.shiftrightunsigned("print", a).bitwiseAND(F.lit((1 << (b - a)) - 1 if b - a < 64 else -1).cast("long")).alias("value"),
        )
        for k, (a, b) in enumerate(zip(bounds, bounds[1:]))
    ]
    rows = classes.select("print", "rep", F.bit_count("print").alias("ones"), F.explode(F.array(*parts)).alias("lot"))
    return rows.select("lot.part", "lot.value", "ones", "print", "rep")


def _tile_pairs(lots: DataFrame, radius: int, tile: int) -> DataFrame:
    """One row per pair of tiles that may hold links: l and r, arrays of (print, rep); r is empty
    for a tile with itself."""
    lot = ["part", "value"]
    cells = store(lots.groupBy(*lot, "ones").agg(F.count("*").alias("n")))
    sizes = cells.groupBy(*lot).agg(F.sum("n").alias("total")).where("total > 1")
    # Small lots are one tile. The others get tiles for each number of ones, as many as it needs.
    whole = lots.join(sizes.where(F.col("total") <= tile).select(*lot), lot)
    one = whole.groupBy(*lot).agg(F.collect_list(F.struct("print", "rep")).alias("l"))
    one = one.select("l", F.filter("l", lambda x: F.lit(False)).alias("r"))

    large = store(sizes.where(F.col("total") > tile).select(*lot))
    tiles = cells.join(large, lot).withColumn("tiles", F.ceil(F.col("n") / tile).cast("int"))
    there = Window.partitionBy(*lot).orderBy("ones").rangeBetween(-radius, radius)
    tiles = store(tiles.withColumn("near", F.collect_list(F.struct("ones", "tiles")).over(there)))
    rows = lots.join(tiles.select(*lot, "ones", "tiles", "near"), [*lot, "ones"])
    rows = rows.withColumn("own", F.pmod(F.xxhash64("print"), F.col("tiles")).cast("int"))
    others = F.flatten(
        F.transform("near", lambda x: F.transform(F.sequence(F.lit(0), x.tiles - 1), lambda k: F.struct(x.ones.alias("ones"), k.alias("tile"))))
    )
    mine = F.struct(F.col("ones"), F.col("own").alias("tile"))
    rows = rows.select(*lot, "print", "rep", mine.alias("mine"), F.explode(others).alias("other"))
    rows = rows.select(*lot, F.least("mine", "other").alias("t"), F.greatest("mine", "other").alias("u"), "mine", "print", "rep")
    item = F.struct("print", "rep")
    many = rows.groupBy(*lot, "t", "u").agg(
        F.collect_list(F.when(F.col("mine") == F.col("t"), item)).alias("l"),
        F.collect_list(F.when(F.col("mine") != F.col("t"), item)).alias("r"),
    )
    many = many.where((F.size("l") > 0) & ((F.size("r") > 0) | (F.col("t") == F.col("u")))).select("l", "r")
    return one.unionByName(many)


def group(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = SIZE,
    radius: int = RADIUS,
    seed: int = SEED,
    tile: int = TILE,
) -> DataFrame:
    """One row per row: doc_id, fingerprint (16 hexadecimal digits), component_id, the smallest
    doc_id that can be reached over links.

    A NULL or empty text, or one without words, has fingerprint zero and is linked like any other.
    Rows that repeat an id are one document with the fingerprints of all of them. A row with a
    NULL id cannot name a group: it is linked with nothing and its component_id is NULL. An empty
    table gives no rows; other columns are ignored.
    """
    if not 0 <= radius < 32:
        raise ValueError("the radius must be from 0 to 31")
    rows = docs.select(known_id(id_col).alias("doc"), whole_text(text_col).alias("text"))
    described = store(rows.mapInArrow(_describe(size, seed), "doc bigint, print bigint"))
    known = described.where(F.col("doc") != NO_ID)
    classes = store(known.groupBy("print").agg(F.min("doc").alias("rep")))
    lots = _lots(classes, radius)
    links = store(_tile_pairs(lots, radius, tile).mapInArrow(_compare(radius), "a bigint, b bigint").distinct())
    release(docs.sparkSession)
    # An id with several fingerprints ties their classes together.
    several = known.groupBy("doc").agg(F.min("print").alias("lo"), F.max("print").alias("hi")).where("lo <> hi")
    tied = known.join(several.select("doc"), "doc", "left_semi").join(classes, "print").select(F.col("doc").alias("a"), F.col("rep").alias("b"))
    found = components(links.unionByName(tied.distinct()))

    placed = classes.join(found, F.col("rep") == F.col("node"), "left")
    placed = placed.select("print", F.coalesce("component", "rep").alias("component"))
    out = described.join(placed, "print", "left")
    component = F.when(F.col("doc") != NO_ID, F.col("component"))
    return out.select(
        given_id("doc").alias("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), component.alias("component_id")
    )


@query("op11_simhash_groups")
def simhash_groups(spark: SparkSession, folder: str) -> DataFrame:
    return group(read(spark, folder, "documents"))
