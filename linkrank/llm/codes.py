"""Directly addressable codes: token files in which any id can be read without decoding a block.

An id is cut into chunks of ``CHUNK`` bits, lowest first. Level k holds chunk k of every id that
has one, and a bitmap that says whether chunk k + 1 exists. The number of ones before a bit, from
a directory with one count for each 512 bits and the ones of the words between, is the id's place
in the next level.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, known_id, read, whole_text
from linkrank.llm.tokens import default_vocabulary, encoder
from linkrank.runtime import scratch_path

CHUNK = 8
MAGIC = b"DAC1"
WORDS_PER_COUNT = 8

#: A block ends with the first document that brings it to so many ids.
BLOCK_IDS = 1 << 20


def pack(ids: np.ndarray) -> bytes:
    """The file form of a list of ids."""
    ids = np.asarray(ids, np.uint32)
    levels, rest = [], ids
    while True:
        chunk = (rest & np.uint32((1 << CHUNK) - 1)).astype(np.uint8)
        more = rest >= (1 << CHUNK)
        bits = np.packbits(more, bitorder="little")
        words = np.zeros(-(-len(bits) // 8) * 8, np.uint8)
        words[: len(bits)] = bits
        words = words.view(np.uint64)
        ones = np.bitwise_count(words).astype(np.int64)
        counts = np.concatenate([[0], np.cumsum(ones)])[:-1][::WORDS_PER_COUNT].astype(np.uint32)
        levels.append((len(chunk), chunk, words, counts))
        rest = rest[more] >> np.uint32(CHUNK)
        if not len(rest):
            break
    out = [MAGIC, struct.pack("<qi", len(ids), len(levels))]
    for n, chunk, words, counts in levels:
        out += [struct.pack("<q", n), chunk.tobytes(), words.tobytes(), counts.tobytes()]
    return b"".join(out)


class Codes:
    """Reads a packed list in place."""

    def __init__(self, raw: bytes):
        if raw[:4] != MAGIC:
            raise ValueError("not a token block")
        self.n, depth = struct.unpack_from("<qi", raw, 4)
        at, self.levels = 16, []
        for _ in range(depth):
            (n,) = struct.unpack_from("<q", raw, at)
            n_words = -(-n // 64)
            n_counts = -(-n_words // WORDS_PER_COUNT)
            at += 8
            chunk = np.frombuffer(raw, np.uint8, n, at)
            words = np.frombuffer(raw, np.uint64, n_words, at + n)
            counts = np.frombuffer(raw, np.uint32, n_counts, at + n + 8 * n_words)
            at += n + 8 * n_words + 4 * n_counts
            self.levels.append((chunk, words, counts))

    def __len__(self) -> int:
        return self.n

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = shift = 0
        for chunk, words, counts in self.levels:
            value |= int(chunk[i]) << shift
            word, bit = divmod(i, 64)
            if not int(words[word]) >> bit & 1:
                break
            block = word // WORDS_PER_COUNT
            before = int(counts[block]) + int(np.bitwise_count(words[block * WORDS_PER_COUNT : word]).sum())
            i = before + (int(words[word]) & ((1 << bit) - 1)).bit_count()
            shift += CHUNK
        return value

    def _ones(self, level: int, i: int) -> int:
        """Ones of a level's bitmap before a place, by its directory."""
        _, words, counts = self.levels[level]
        word, bit = divmod(i, 64)
        block = word // WORDS_PER_COUNT
        if block >= len(counts):  # the end of a level that fills its last block
            block -= 1
        before = int(counts[block]) + int(np.bitwise_count(words[block * WORDS_PER_COUNT : word]).sum())
        return before + ((int(words[word]) & ((1 << bit) - 1)).bit_count() if bit else 0)

    def read(self, low: int, high: int) -> np.ndarray:
        """The ids of a range. On each level they stand together, from the number of ones before
        the range on the level below; nothing outside of the range is decoded."""
        if not 0 <= low <= high <= self.n:
            raise IndexError((low, high))
        out = np.zeros(high - low, np.uint32)
        at = np.arange(high - low)
        for level, (chunk, words, _) in enumerate(self.levels):
            out[at] |= chunk[low:high].astype(np.uint32) << np.uint32(CHUNK * level)
            first = low // 64
            bits = np.unpackbits(words[first : -(-high // 64)].view(np.uint8), bitorder="little")
            more = bits[low - 64 * first : high - 64 * first].view(bool)
            at = at[more]
            if not len(at):
                break
            low = self._ones(level, low)
            high = low + len(at)
        return out

    def all(self) -> np.ndarray:
        return self.read(0, self.n)


_BLOCKS = "part int, block int, docs array<bigint>, lengths array<bigint>, codes binary"


def _encode_blocks(vocabulary: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary).encode
        part, block = TaskContext.get().partitionId(), 0
        docs, lists, size = [], [], 0

        def finished() -> pa.RecordBatch:
            lengths = np.array([len(x) for x in lists], np.int64)
            columns = [
                pa.array([part], pa.int32()),
                pa.array([block], pa.int32()),
                arrow.lists(np.array(docs, np.int64), [len(docs)]),
                arrow.lists(lengths, [len(docs)]),
                pa.array([pack(np.concatenate(lists))], pa.binary()),
            ]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "docs", "lengths", "codes"])

        for batch in batches:
            whole, bounds = arrow.raw_bytes(batch.column(1))
            given = batch.column(0).to_pylist()
            for low, high in arrow.chunks(bounds):
                ids, at = encode(whole[bounds[low] : bounds[high]], bounds[low : high + 1] - bounds[low])
                for doc, a, b in zip(given[low:high], at[:-1].tolist(), at[1:].tolist(), strict=True):
                    docs.append(doc)
                    lists.append(np.append(ids[a:b], np.uint32(end_id)))
                    size += b - a + 1
                    if size >= block_ids:
                        yield finished()
                        docs, lists, size, block = [], [], 0, block + 1
        if docs:
            yield finished()

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
    end_id: int = 2,
    block_ids: int = BLOCK_IDS,
) -> DataFrame:
    """Write the ids of whole texts, in ascending id order, as blocks of directly addressable codes.

    A NULL text is empty: its document has only the end id. Rows with equal ids are ordered by a
    hash of their texts and each is written; a NULL id comes first. Other columns are ignored.
    """
    rows = docs.select(known_id(id_col).alias("doc"), whole_text(text_col).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    ordered = rows.repartitionByRange("doc", "tie").sortWithinPartitions("doc", "tie").select("doc", "text")
    blocks = ordered.mapInArrow(_encode_blocks(vocabulary or default_vocabulary(), end_id, block_ids), _BLOCKS)
    blocks.write.option("compression", "zstd").parquet(path)
    return docs.sparkSession.read.schema(_BLOCKS).parquet(path)


def _decode_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            codes, lengths = Codes(row["codes"]), np.array(row["lengths"], np.int64)
            ends = np.cumsum(lengths)
            starts = ends - lengths
            each = (codes.read(a, b) for a, b in zip(starts.tolist(), ends.tolist(), strict=True))
            crcs = [zlib.crc32(ids.astype("<u4").tobytes()) for ids in each]
            n = len(lengths)
            columns = [
                pa.array([row["part"]] * n, pa.int32()),
                pa.array([row["block"]] * n, pa.int32()),
                arrow.longs(np.array(row["docs"], np.int64)),
                arrow.longs(starts),
                arrow.longs(lengths),
                arrow.longs(np.array(crcs, np.int64)),
            ]
            names = ["part", "block", "doc", "inside", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(columns, names)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per written document: doc_id, start among all ids, n_tokens, ids_crc32."""
    blocks = spark.read.schema(_BLOCKS).parquet(path)
    size = F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = blocks.select("part", "block", size.alias("n"))
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))  # one row per file
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    at = sizes.select("part", "block", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("block_start"))
    at = at.join(totals, "part").select("part", "block", (F.col("part_start") + F.col("block_start")).alias("base"))
    found = blocks.mapInArrow(
        _decode_blocks, "part int, block int, doc bigint, inside bigint, n_tokens bigint, ids_crc32 bigint"
    )
    return found.join(at, ["part", "block"]).select(
        given_id("doc").alias("doc_id"), (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


@query("op7_token_codes")
def token_codes(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_tokens(read(spark, folder, "documents"), path)
    return read_tokens(spark, path)
