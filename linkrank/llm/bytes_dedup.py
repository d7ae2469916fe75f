"""Repeated byte strings, by interval expansion on a Burrows-Wheeler transform per shard.

The intervals of all strings of one byte, of two and so on are found breadth first by backward
extension. So the common prefixes of neighbouring suffixes come out by increasing length, and the
expansion stops at the minimum length: suffixes that are not parted by then share that much.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.index import Suffixes, Wavelet, prefix_runs
from linkrank.llm.passages import Shard, Units, find_repeats, keyed, merged
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, read

WINDOW = 100
ANCHOR = 32


def _eight_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return arrow.mix(arrow.eights(data)[:-1]), bounds


def _single_bytes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return arrow.mix(data.astype(np.uint64) + np.uint64(1)), bounds


def _bytes_themselves(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return raw


def byte_units(window: int = WINDOW, anchor: int = ANCHOR) -> Units:
    if anchor >= 8:
        return Units(_eight_bytes, _bytes_themselves, np.uint8, window, anchor, span=8)
    return Units(_single_bytes, _bytes_themselves, np.uint8, window, anchor)


def expanded_intervals(shard: Shard, window: int) -> np.ndarray:
    """For each symbol: the smallest key among the windows equal to the one that begins there."""
    symbols, n_symbols = shard.numbered()
    keys = shard.window_keys(window)
    suffixes = Suffixes(symbols, window)
    new = prefix_runs(Wavelet(suffixes.transform, n_symbols), len(symbols), window)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(keys[suffixes.order], heads)[np.cumsum(new) - 1]
    earliest = np.empty(len(symbols), np.int64)
    earliest[suffixes.order] = least
    return earliest


def _kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for low, high in spans:
        parts.append(raw[at:low])
        at = high
    return b"".join([*parts, raw[at:]])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        whole, at = arrow.raw_bytes(batch.column(1))
        data, out = whole.tobytes(), []
        for a, b, spans in zip(at[:-1].tolist(), at[1:].tolist(), merged(batch.column(2)), strict=True):
            kept = _kept(data[a:b], spans)
            out.append((b - a, b - a - len(kept), len(spans), hashlib.sha256(kept).hexdigest()))
        n_bytes, n_removed, n_spans, digests = zip(*out, strict=True) if out else ((), (), (), ())
        columns = [batch.column(0), *(arrow.longs(x) for x in (n_bytes, n_removed, n_spans)), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = [_kept(x.encode(), spans) for x, spans in zip(batch.column(1).to_pylist(), merged(batch.column(2)), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], ["doc", "kept"])


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    ranges = find_repeats(rows, byte_units(window, min(ANCHOR, window)), expanded_intervals)
    return rows.join(ranges, ["doc", "tie"], "left").select("doc", "text", "ranges")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; see ``remove_repeats``."""
    schema = "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"
    found = _with_ranges(docs, id_col, text_col, window).mapInArrow(_digest, schema)
    return found.select(given_id("doc").alias("doc_id"), *found.columns[1:])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id and the UTF-8 bytes kept, as binary, as a cut may part a letter.

    A byte goes when a string of ``window`` bytes that covers it also starts earlier: in a
    document with a smaller id, or earlier in its own; matches may overlap. NULL and empty texts
    have no bytes. Rows with one id and one text are one document, so neither is earlier than the
    other; rows with one id and different texts are different documents. A NULL id comes before
    all others. An empty table gives no rows; other columns are ignored.
    """
    found = _with_ranges(docs, id_col, text_col, window).mapInArrow(_keep, "doc bigint, kept binary")
    return found.select(given_id("doc").alias("doc_id"), F.col("kept"))


@query("op8_repeated_bytes")
def repeated_bytes(spark: SparkSession, folder: str) -> DataFrame:
    return summary(read(spark, folder, "documents"))
