"""Count-min sketches of 64-bit hashes, made by many tasks and merged slice by slice.

A sketch has ``ROWS`` rows of counters. Only one question is asked of it: can a hash have been seen
more than once? If any of its counters stands at one, it has been seen once for certain. So a
counter needs to tell none, one and more apart, and the finished sketch is one bit a counter.

Tasks write the counters they touched, two bytes each, by slices of 65,536 counters; a slice is
added up in one task, whose memory does not depend on the data. The finished bits, at most
``ROWS`` times ``MOST_CELLS`` of them (13 MB), are the only thing that goes through the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from linkrank.llm import arrow

ROWS = 3
SLICE = 1 << 16
FEWEST_CELLS, MOST_CELLS = SLICE, 1 << 25
_HELD = 1 << 20  #: hashes that a task adds up before it writes
_SEEDS = arrow.mix(np.arange(1, ROWS + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F))

#: Hashes of each batch of rows.
Hashes = Callable[[Iterator[pa.RecordBatch]], Iterator[np.ndarray]]


def cells_for(n: int) -> int:
    """Counters a row for ``n`` hashes: twice as many, within the bounds."""
    return min(MOST_CELLS, max(FEWEST_CELLS, 1 << (2 * n - 1).bit_length() if n else 0))


def _places(hashes: np.ndarray, cells: int) -> Iterator[np.ndarray]:
    for seed in _SEEDS:
        yield (arrow.mix(hashes ^ seed) & np.uint64(cells - 1)).astype(np.int64)


_PART = "slice int, once binary, twice binary"


def _parts(hashes: Hashes, cells: int):
    def written(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        slices, once, twice = [], [], []
        for row, places in enumerate(_places(np.concatenate(held), cells)):
            places, counts = np.unique(places, return_counts=True)
            bounds = np.searchsorted(places, np.arange(0, cells + SLICE, SLICE))
            low, many = (places % SLICE).astype(np.uint16), counts > 1
            for k in np.flatnonzero(bounds[1:] > bounds[:-1]).tolist():
                part, more = low[bounds[k] : bounds[k + 1]], many[bounds[k] : bounds[k + 1]]
                slices.append(row * (cells // SLICE) + k)
                once.append(part[~more].tobytes())
                twice.append(part[more].tobytes())
        columns = [pa.array(slices, pa.int32()), pa.array(once, pa.binary()), pa.array(twice, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "once", "twice"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for x in hashes(batches):
            held.append(x)
            size += len(x)
            if size >= _HELD:
                yield from written(held)
                held, size = [], 0
        if size:
            yield from written(held)

    return run


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by slice: one row for each slice, with a bit for each counter above one."""
    now, counters = None, np.zeros(SLICE, np.uint8)

    def finished() -> pa.RecordBatch:
        bits = np.packbits(counters > 1, bitorder="little").tobytes()
        return pa.RecordBatch.from_arrays([pa.array([now], pa.int32()), pa.array([bits], pa.binary())], ["slice", "bits"])

    for batch in batches:
        for row in batch.to_pylist():
            if row["slice"] != now:
                if now is not None:
                    yield finished()
                now = row["slice"]
                counters[:] = 0
            once = np.frombuffer(row["once"], np.uint16)
            counters[once] = np.minimum(counters[once], 1) + 1
            counters[np.frombuffer(row["twice"], np.uint16)] = 2
    if now is not None:
        yield finished()


class Repeated:
    """A finished sketch: which hashes may have been seen more than once."""

    def __init__(self, bits: np.ndarray, cells: int):
        self.bits, self.cells = bits, cells

    def may_have(self, hashes: np.ndarray) -> np.ndarray:
        """False is certain: such a hash has been seen once."""
        out = np.ones(len(hashes), bool)
        for row, places in enumerate(_places(hashes, self.cells)):
            places += row * self.cells
            out &= (self.bits[places >> 3] >> (places & 7).astype(np.uint8) & 1).astype(bool)
        return out


def repeated(rows: DataFrame, hashes: Hashes, cells: int):
    """Sketch the hashes of ``rows``; returns a broadcast of ``Repeated``."""
    parts = rows.mapInArrow(_parts(hashes, cells), _PART)
    merged = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(_merge, "slice int, bits binary")
    bits = np.zeros(ROWS * cells // 8, np.uint8)
    for row in merged.collect():  # at most ROWS * MOST_CELLS bits
        bits[row["slice"] * (SLICE // 8) : (row["slice"] + 1) * (SLICE // 8)] = np.frombuffer(row["bits"], np.uint8)
    return rows.sparkSession.sparkContext.broadcast(Repeated(bits, cells))
