"""Minimum bin slack packing: documents into windows of a fixed length with hardly any padding.

A document is cut into whole windows, which need no partner, and one rest shorter than a window.
Rests have fewer lengths than a window has places, so the plan is made on the number of rests of
each length, whatever their total: the longest rest left opens a window, a bitset of reachable sums
finds the multiset of other lengths that fills it best, and the same filling is repeated as long as
the counts allow. Every filling uses up a length, so there are at most as many as lengths.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, known_id, read, store, whole_text
from linkrank.llm.tokens import default_vocabulary, encoder

CAPACITY = 1024
SLOT_PIECES = 100_000  #: pieces of one length that a task numbers, about


def best_filling(counts: dict[int, int], room: int) -> dict[int, int]:
    """How many of each length to take so that their sum is as near to ``room`` as it can be.

    Bit s of the bitset is set when sum s is reachable; the bitsets before each length are kept,
    so that the counts can be read off backwards.
    """
    mask, reach, kept = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        if not left:
            continue
        kept.append((length, left, reach))
        step = 1
        while left:
            take = min(step, left)
            reach |= reach << (take * length) & mask
            left -= take
            step *= 2
        if reach >> room & 1:
            break
    total, taken = reach.bit_length() - 1, {}
    for length, left, before in reversed(kept):
        n = 0
        while not before >> total & 1:
            total -= length
            n += 1
            if n > left or total < 0:
                raise AssertionError("no way back through the sums")
        if n:
            taken[length] = n
    return taken


def fillings(counts: dict[int, int], capacity: int) -> Iterator[tuple[dict[int, int], int]]:
    """Multisets of lengths, and how many windows each of them fills; uses up all counts."""
    counts = {k: v for k, v in counts.items() if v}
    while counts:
        longest = max(counts)
        counts[longest] -= 1
        taken = best_filling(counts, capacity - longest)
        counts[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        times = min(counts[k] // n for k, n in taken.items())
        yield taken, times
        for k, n in taken.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]


def _cut(vocabulary: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        for batch in batches:
            whole, bounds = arrow.raw_bytes(batch.column(1))
            given = batch.column(0).to_pylist()
            for low, high in arrow.chunks(bounds):
                found, at = encode(whole[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                rows = []
                for doc, first, last in zip(given[low:high], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    ids = np.append(found[first:last], np.uint32(end_id)).astype("<u4")
                    n = len(ids)
                    for a in range(0, n, capacity):
                        b = min(n, a + capacity)
                        rows.append((doc, a, b - a, zlib.crc32(ids[a:b].tobytes()), n))
                columns = [arrow.longs(np.array(x, np.int64)) for x in zip(*rows, strict=True)]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "start", "length", "ids_crc32", "doc_tokens"])

    return run


def pieces(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 0,
    capacity: int = CAPACITY,
) -> DataFrame:
    """The pieces of each document: doc, start, length, ids_crc32, doc_tokens."""
    rows = docs.select(known_id(id_col).alias("doc"), whole_text(text_col).alias("text"))
    schema = "doc bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    return rows.mapInArrow(_cut(vocabulary or default_vocabulary(), end_id, capacity), schema)


def assign(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to stored pieces; pieces of full length are sequences of their own.

    Pieces of a length are numbered within hashed slots, whose sizes are added up before, so no
    task holds all pieces of a length.
    """
    spark = cut.sparkSession
    counts = cut.groupBy("length").agg(F.count("*").alias("n")).collect()  # at most ``capacity`` rows
    totals = {r["length"]: r["n"] for r in counts}
    # As many slots for a length as its pieces need: all sizes together are few rows.
    slots = [(k, -(-n // SLOT_PIECES)) for k, n in totals.items()]
    slots = F.broadcast(spark.createDataFrame(slots, "length bigint, slots bigint"))
    key = F.xxhash64("doc", "start", "ids_crc32")
    cut = cut.join(slots, "length").withColumn("slot", F.pmod(key, F.col("slots"))).drop("slots")
    sizes = cut.groupBy("length", "slot").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    sizes = store(sizes.select("length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")))
    full = totals.pop(capacity, 0)
    plan, first_sequence = [(capacity, 0, full, 1, 0, 0)], full
    used = dict.fromkeys(totals, 0)
    for taken, times in fillings(totals, capacity):
        offset = 0
        for length in sorted(taken, reverse=True):
            n = taken[length]
            plan.append((length, used[length], used[length] + n * times, n, first_sequence, offset))
            used[length] += n * times
            offset += n * length
        first_sequence += times
    # At most capacity fillings, each of fewer than 2 * sqrt(capacity) lengths.
    steps = spark.createDataFrame(
        plan, "length bigint, low bigint, high bigint, each bigint, first_sequence bigint, first_offset bigint"
    )
    number = F.row_number().over(Window.partitionBy("length", "slot").orderBy("doc", "start", "ids_crc32"))
    numbered = cut.withColumn("number", number.cast("long") - 1).join(sizes, ["length", "slot"])
    numbered = numbered.withColumn("number", F.col("number") + F.col("base")).drop("slot", "base")
    numbered = numbered.withColumnRenamed("length", "piece_length")
    found = numbered.join(
        F.broadcast(steps),
        (F.col("piece_length") == F.col("length")) & (F.col("number") >= F.col("low")) & (F.col("number") < F.col("high")),
    )
    place = F.col("number") - F.col("low")
    return found.select(
        "doc",
        "start",
        F.col("piece_length").alias("length"),
        "ids_crc32",
        "doc_tokens",
        (F.col("first_sequence") + F.expr("(number - low) div each")).alias("sequence_id"),
        (F.col("first_offset") + F.pmod(place, F.col("each")) * F.col("piece_length")).alias("offset"),
    )


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, **options) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` ids; returns one row per piece.

    A NULL or empty text is a document of its end id alone. Repeated rows are packed each. An
    empty table gives no rows; other columns are ignored.
    """
    cut = store(pieces(docs, id_col, text_col, capacity=capacity, **options))
    return assign(cut, capacity).select(given_id("doc").alias("doc_id"), *PIECE_COLUMNS)


PIECE_COLUMNS = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


@query("op9_packing")
def packing(spark: SparkSession, folder: str) -> DataFrame:
    return pack(read(spark, folder, "documents"))
