"""Repeated runs of words, by matching statistics on a compressed FM-index per shard.

A shard's word sequences are indexed by a wavelet matrix over their Burrows-Wheeler transform.
The same sequences are then streamed through backward search from right to left, all in step: the
interval of the last words is extended by the next word, and cut back to one word less than the
threshold once it is as long as the threshold. An interval of threshold length holds all
occurrences of the window that begins there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.index import Suffixes, Wavelet
from linkrank.llm.passages import Shard, Units, find_repeats, keyed, merged
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, read

WINDOW = 20
ANCHOR = 6


def _words_themselves(raw: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return arrow.word_hashes(raw, bounds)[0]


def word_units(window: int = WINDOW, anchor: int = ANCHOR) -> Units:
    return Units(arrow.word_hashes, _words_themselves, np.uint64, window, anchor)


def _run_ends(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First place of each place's run, and the place after its last."""
    heads = np.flatnonzero(new)
    run = np.cumsum(new) - 1
    return heads[run], np.append(heads[1:], len(new))[run]


def matching_statistics(shard: Shard, window: int) -> np.ndarray:
    """For each symbol: the smallest key among the windows equal to the one that begins there.

    Matches longer than the window are cut back to it, so a match length is at most ``window``.
    Each streamed sequence is also in the index, so a match never ends before its sequence does.
    """
    symbols, n_symbols = shard.numbered()
    keys = shard.window_keys(window)
    suffixes = Suffixes(symbols, window)
    index = Wavelet(suffixes.transform, n_symbols)
    new = suffixes.run_starts(window)
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(keys[suffixes.order], heads)[np.cumsum(new) - 1]
    shorter_low, shorter_high = _run_ends(suffixes.run_starts(window - 1))

    earliest = np.full(len(symbols), np.iinfo(np.int64).max)
    tails = np.cumsum(shard.lengths + 1) - 2  # the last word of each sequence
    by_length = np.argsort(-shard.lengths, kind="stable")
    tails, lengths = tails[by_length], shard.lengths[by_length]
    low, high = np.zeros(len(tails), np.int64), np.full(len(tails), len(symbols))
    for matched in range(int(lengths[0]) if len(lengths) else 0):
        active = int(np.searchsorted(-lengths, -matched, "left"))  # sequences longer than this
        low, high, at = low[:active], high[:active], tails[:active] - matched
        if matched >= window:
            low, high = shorter_low[low], shorter_high[low]
        low, high = index.step(symbols[at], low, high)
        if matched >= window - 1:
            earliest[at] = least[low]
    return earliest


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), merged(batch.column(2)), strict=True):
            words, kept, at = text.encode().split(), [], 0
            for low, high in spans:
                kept += words[at:low]
                at = high
            kept += words[at:]
            out.append((len(words), len(words) - len(kept), b" ".join(kept)))
        n_words, n_removed, kept = zip(*out, strict=True) if out else ((), (), ())
        digests = [hashlib.sha256(x).hexdigest() for x in kept]
        columns = [batch.column(0), arrow.longs(n_words), arrow.longs(n_removed), pa.array(digests, pa.string())]
        yield pa.RecordBatch.from_arrays(columns, ["doc", "n_words", "n_removed", "kept_sha256"])


def _kept_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column(1).to_pylist(), merged(batch.column(2)), strict=True):
            words, kept, at = text.encode().split(), [], 0
            for low, high in spans:
                kept += words[at:low]
                at = high
            out.append(b" ".join(kept + words[at:]).decode())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc", "kept"])


def _with_ranges(docs: DataFrame, id_col: str, text_col: str, window: int) -> DataFrame:
    rows = keyed(docs, id_col, text_col)
    ranges = find_repeats(rows, word_units(window, min(ANCHOR, window)), matching_statistics)
    return rows.join(ranges, ["doc", "tie"], "left").select("doc", "text", "ranges")


def summary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256; see ``remove_repeats``."""
    schema = "doc bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    found = _with_ranges(docs, id_col, text_col, window).mapInArrow(_cut_out, schema)
    return found.select(given_id("doc").alias("doc_id"), *found.columns[1:])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id and the words kept, joined by one space.

    A word goes when a run of ``window`` words that covers it also starts earlier: in a document
    with a smaller id, or earlier in its own. NULL and empty texts have no words. Rows with one id
    and one text are one document, so neither is earlier than the other; rows with one id and
    different texts are different documents. A NULL id comes before all others. An empty table
    gives no rows; other columns are ignored.
    """
    found = _with_ranges(docs, id_col, text_col, window).mapInArrow(_kept_words, "doc bigint, kept string")
    return found.select(given_id("doc").alias("doc_id"), F.col("kept"))


@query("op5_repeated_words")
def repeated_words(spark: SparkSession, folder: str) -> DataFrame:
    return summary(read(spark, folder, "documents"))
