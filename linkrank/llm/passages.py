"""Passages that occur more than once: finding candidates, spreading them over shards, merging.

Both operators on repeated passages ask which windows of a fixed number of units (words or bytes)
also start earlier. The window's rarest-looking part, the k units with the smallest hash, is its
anchor; equal windows have equal anchors at equal places. Neighbouring windows with one anchor
form a stretch. Stretches whose anchor occurs once in the corpus hold no repeat and end here.
The others are collapsed to distinct stretches with their first occurrence: all windows of any
later occurrence start earlier too. Where an anchor has several distinct stretches, these are
spread over shards by anchor, and an index finds the earliest occurrence of each window.

An anchor with more than ``MOST_STRETCHES`` distinct stretches would overfill a shard. Its windows
are dealt out by their 128-bit hashes instead, and the first start of each is taken.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkrank.llm import arrow, sketch
from linkrank.llm.stages import known_id, release, store, whole_text

MOST_STRETCHES = 4000
SHARD_UNITS = 1 << 19  #: units indexed together
_SEGMENT = 1 << 21
_CHUNK = 1 << 18  #: bytes of text looked at together
_PLACE = np.uint64((1 << 24) - 1)
_FIRST = np.uint64(0xA24BAED4963EE407)


@dataclass(frozen=True)
class Units:
    """How texts become sequences, and which windows count."""

    #: From the bytes of several texts and their bounds: a well-mixed value for each unit, bounds in units.
    values: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]
    #: From the bytes of a text and its bounds: one element per unit, of ``body_type``.
    body: Callable[[np.ndarray, np.ndarray], np.ndarray]
    body_type: type
    window: int
    anchor: int
    span: int = 1  #: units that a value tells

    def hashes(self, values: np.ndarray, at: np.ndarray | slice, low: int, high: int) -> np.ndarray:
        """Hashes of the units from ``low`` to ``high`` after each place, made of values."""
        return arrow.sequence_hashes(values, at, [*range(low, high - self.span, self.span), high - self.span])

    def window_hashes(self, grams: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Hashes of the windows that begin at some places, made of the hashes of anchors."""
        return arrow.sequence_hashes(grams, at, [*range(0, self.window - self.anchor, self.anchor), self.window - self.anchor])


def _stretches(units: Units, values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """Stretches of one segment: anchor, content, text number, start in the text, length.

    A stretch is shorter than two windows, so its first and its last window and its length tell
    its content.
    """
    n, window, k = len(values), units.window, units.anchor
    empty = np.zeros(0, np.int64)
    nothing = (empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty)
    inside = np.zeros(n + 1, np.int32)
    first = bounds[:-1]
    last = bounds[1:] - window + 1
    some = last > first
    if not some.any():
        return nothing
    np.add.at(inside, first[some], 1)
    np.add.at(inside, last[some], -1)
    starts = np.flatnonzero(np.cumsum(inside)[: n - window + 1])
    grams = units.hashes(values, slice(0, n - k + 1), 0, k)
    least = grams & ~_PLACE
    least |= np.arange(n - k + 1, dtype=np.uint64)
    width, wide = 1, window - k + 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < wide:
        least = np.minimum(least[: len(least) - (wide - width)], least[wide - width :])
    place = (least[starts] & _PLACE).astype(np.int64)
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
    heads = np.flatnonzero(new)
    low = starts[heads]
    ends = starts[np.append(heads[1:], len(starts)) - 1]
    text = np.searchsorted(bounds, low, "right") - 1
    length = ends - low + window
    both = units.window_hashes(grams, low) * _FIRST + units.window_hashes(grams, ends) + length.astype(np.uint64)
    return grams[place[heads]], arrow.mix(both), text, low - bounds[text], length


def _segments(units: Units, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, ...]]:
    """Stretches of a batch of texts, its last column: anchor, content, row, start, length."""
    whole, at = arrow.raw_bytes(batch.column(batch.num_columns - 1))
    for low, high in arrow.chunks(at, _CHUNK):
        values, bounds = units.values(whole[at[low] : at[high]], at[low : high + 1] - at[low])
        for a in range(0, max(1, len(values)), _SEGMENT):
            part = values[a : a + _SEGMENT + units.window - 1]
            inner = np.clip(bounds - a, 0, len(part))
            anchor, content, text, start, length = _stretches(units, part, inner)
            yield anchor, content, low + text, start + inner[text] + a - bounds[text], length


def _anchors(units: Units):
    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        return (x[0] for batch in batches for x in _segments(units, batch))

    return hashes


def _find(units: Units, repeated):
    """Stretches whose anchors may occur again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for anchor, content, row, start, length in _segments(units, batch):
                again = repeated.value.may_have(anchor)
                row = row[again]
                columns = [anchor[again], content[again], doc[row], tie[row], start[again], length[again]]
                names = ["anchor", "content", "doc", "tie", "start", "length"]
                yield pa.RecordBatch.from_arrays([arrow.longs(x) for x in columns], names)

    return run


_OCCURRENCE = "anchor bigint, content bigint, doc bigint, tie bigint, start bigint, length bigint"


def _bodies(units: Units):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = arrow.raw_bytes(batch.column(2))
            wanted = batch.column(3)
            firsts = np.append(wanted.offsets.to_numpy(), 0)[: len(wanted) + 1]
            flat = wanted.values
            fields = {x: flat.field(x).to_numpy() for x in ("anchor", "content", "start", "length")}
            doc, tie = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i in range(len(batch)):
                a, b = int(firsts[i]), int(firsts[i + 1])
                raw = whole[at[i] : at[i + 1]]
                values = units.body(raw, np.array([0, len(raw)]))
                data = values.tobytes()
                size = values.itemsize
                start, length = fields["start"][a:b], fields["length"][a:b]
                cut = [data[s * size : (s + n) * size] for s, n in zip(start.tolist(), length.tolist(), strict=True)]
                columns = [
                    arrow.longs(fields["anchor"][a:b]),
                    arrow.longs(fields["content"][a:b]),
                    arrow.longs(np.full(b - a, doc[i])),
                    arrow.longs(np.full(b - a, tie[i])),
                    arrow.longs(start),
                    pa.array(cut, pa.binary()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["anchor", "content", "doc", "tie", "start", "body"])

    return run


_BODY = "anchor bigint, content bigint, doc bigint, tie bigint, start bigint, body binary"


@dataclass
class Shard:
    """Distinct stretches whose windows are compared with each other."""

    values: np.ndarray  #: units of all stretches, one after the other
    lengths: np.ndarray
    starts: np.ndarray  #: of the first occurrence in its document
    doc_rank: np.ndarray  #: of the first occurrence's document

    def numbered(self) -> tuple[np.ndarray, int]:
        """Symbols from 1, with a 0 after each stretch; and how many symbols there are."""
        known, symbols = np.unique(self.values, return_inverse=True)
        ends = np.cumsum(self.lengths)
        return np.insert(symbols + 1, ends, 0), len(known) + 1

    def window_keys(self, window: int) -> np.ndarray:
        """For each symbol: where the window that begins there starts, as (document, start); the
        largest number where no window begins."""
        total = int(self.lengths.sum()) + len(self.lengths)
        heads = np.concatenate([[0], np.cumsum(self.lengths + 1)[:-1]])
        inside = np.arange(total) - np.repeat(heads, self.lengths + 1)
        which = np.repeat(np.arange(len(self.lengths)), self.lengths + 1)
        keys = (self.doc_rank[which] << 40) + self.starts[which] + inside
        return np.where(inside + window <= self.lengths[which], keys, np.iinfo(np.int64).max)


def _ranges(which: np.ndarray, offset: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Union of windows given by stretch number and offset, both ascending: stretch, from, to."""
    if not len(which):
        return which, offset, offset
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (offset[1:] > offset[:-1] + window)
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(which)) - 1
    return which[heads], offset[heads], offset[tails] + window


_VERDICT = "anchor bigint, content bigint, repeats array<struct<low:bigint,high:bigint>>"
_RANGE = pa.struct([("low", pa.int64()), ("high", pa.int64())])


def _verdicts(table: pa.Table, units: Units, earliest: Callable[[Shard, int], np.ndarray]) -> pa.RecordBatch:
    """Index the stretches of a table and report which parts of each also start earlier.

    ``earliest`` gives, for each symbol of ``Shard.numbered``, the smallest key of the windows
    equal to the one that begins there.
    """
    anchor, content = table["anchor"].to_numpy(), table["content"].to_numpy()
    _, one = np.unique(np.stack([anchor, content]), axis=1, return_index=True)  # a repeated row brings copies
    if len(one) < table.num_rows:
        one.sort()
        table, anchor, content = table.take(one), anchor[one], content[one]
    bodies = table["body"].to_pylist()
    size = np.dtype(units.body_type).itemsize
    lengths = np.array([len(x) // size for x in bodies], np.int64)
    documents = np.stack([table["doc"].to_numpy(), table["tie"].to_numpy()])
    rank = np.unique(documents, axis=1, return_inverse=True)[1].ravel()
    shard = Shard(np.frombuffer(b"".join(bodies), units.body_type), lengths, table["start"].to_numpy(), rank)
    own = shard.window_keys(units.window)
    late = np.flatnonzero((own != np.iinfo(np.int64).max) & (earliest(shard, units.window) < own))
    which = np.searchsorted(np.cumsum(lengths + 1), late, "right")
    heads = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]])
    which, low, high = _ranges(which, late - heads[which], units.window)
    counts = np.bincount(which, minlength=len(lengths))
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(counts, out=at[1:])
    ranges = pa.StructArray.from_arrays([arrow.longs(low), arrow.longs(high)], fields=list(_RANGE))
    columns = [arrow.longs(anchor), arrow.longs(content), pa.ListArray.from_arrays(pa.array(at), ranges)]
    return pa.RecordBatch.from_arrays(columns, ["anchor", "content", "repeats"])


def _index(units: Units, earliest: Callable[[Shard, int], np.ndarray]):
    """Work through rows sorted by anchor, some whole anchors at a time."""
    limit = SHARD_UNITS * np.dtype(units.body_type).itemsize

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for piece in (batch.slice(i, 2000) for i in range(0, len(batch), 2000)):
                held.append(piece)
                size += piece.column(5).nbytes
                if size < limit:
                    continue
                table = pa.Table.from_batches(held)
                anchors = table["anchor"].to_numpy()
                head = int(np.flatnonzero(anchors == anchors[-1])[0])
                if head:
                    yield _verdicts(table.slice(0, head), units, earliest)
                    rest = table.slice(head)
                    held, size = rest.to_batches(), rest["body"].nbytes
        if held:
            yield _verdicts(pa.Table.from_batches(held), units, earliest)

    return run


def _windows(units: Units):
    """Every window of each stretch, with a 128-bit hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 1000):
                some = batch.slice(i, 1000)
                bodies = [np.frombuffer(x, units.body_type) for x in some.column(5).to_pylist()]
                lengths = np.array([len(x) for x in bodies], np.int64)
                ends = np.cumsum(lengths)
                values = np.concatenate(bodies)
                if values.dtype == np.uint8:
                    values, _ = units.values(values, np.append(0, ends))
                counts = lengths - units.window + 1
                which = np.repeat(np.arange(len(bodies)), counts)
                offset = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts)
                at = (ends - lengths)[which] + offset
                columns = [
                    arrow.longs(units.hashes(values, at, 0, units.window)),
                    arrow.longs(units.hashes(arrow.mix(values), at, 0, units.window)),
                    *(arrow.longs(some.column(k).to_numpy()[which]) for k in range(4)),
                    arrow.longs(some.column(4).to_numpy()[which] + offset),
                    arrow.longs(offset),
                ]
                names = ["h1", "h2", "anchor", "content", "doc", "tie", "start", "place"]
                yield pa.RecordBatch.from_arrays(columns, names)

    return run


_WINDOW = "h1 bigint, h2 bigint, anchor bigint, content bigint, doc bigint, tie bigint, start bigint, place bigint"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc, tie, text: rows with one id and one text are one document; rows with one id and
    different texts are different documents, in the order of their texts' checksums."""
    text = whole_text(text_col)
    return docs.select(known_id(id_col).alias("doc"), F.crc32(text).alias("tie"), text.alias("text"))


def find_repeats(rows: DataFrame, units: Units, earliest: Callable[[Shard, int], np.ndarray]) -> DataFrame:
    """From ``keyed`` rows: doc, tie, and all ranges of units covered by a window that also starts
    earlier, as an array of (low, high) that may overlap. Documents without repeats are left out."""
    spark = rows.sparkSession
    # A sketch of bounded size first tells most anchors that occur once, so that few of their
    # stretches are stored; what it lets through is counted exactly.
    again = sketch.repeated(rows.select("text"), _anchors(units), sketch.MOST_CELLS)
    release(spark)
    found = store(rows.select("doc", "tie", "text").mapInArrow(_find(units, again), _OCCURRENCE))
    again.unpersist()
    # Stored, so that both sides of the join are shuffled for it and a frequent anchor can be split.
    again = store(found.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1").select("anchor"))
    occurrences = store(found.join(again, "anchor", "left_semi"))
    release(spark)

    first = F.min(F.struct("doc", "tie", "start")).alias("first")
    distinct = occurrences.groupBy("anchor", "content").agg(first, F.first("length").alias("length"))
    distinct = store(distinct.select("anchor", "content", "first.*", "length"))
    release(spark)
    counts = distinct.groupBy("anchor").agg(F.count("*").alias("c")).where("c > 1")
    counts = store(counts)
    unlike = distinct.join(counts.select("anchor"), "anchor", "left_semi")
    wanted = unlike.groupBy("doc", "tie").agg(F.collect_list(F.struct("anchor", "content", "start", "length")).alias("wanted"))
    bodies = store(rows.join(wanted, ["doc", "tie"]).select("doc", "tie", "text", "wanted").mapInArrow(_bodies(units), _BODY))
    release(spark)

    crowded = counts.where(F.col("c") > MOST_STRETCHES).select("anchor")
    crowded = store(crowded)
    spread = bodies.join(crowded, "anchor", "left_anti").repartition("anchor").sortWithinPartitions("anchor")
    verdicts = spread.mapInArrow(_index(units, earliest), _VERDICT)
    if not crowded.isEmpty():
        windows = store(bodies.join(crowded, "anchor", "left_semi").mapInArrow(_windows(units), _WINDOW))
        start = F.struct("doc", "tie", "start")
        firsts = windows.groupBy("h1", "h2").agg(F.min(start).alias("earliest"), F.max(start).alias("latest"))
        firsts = firsts.where("earliest < latest").select("h1", "h2", "earliest")
        late = windows.join(firsts, ["h1", "h2"]).where(start > F.col("earliest"))
        part = F.struct(F.col("place").alias("low"), (F.col("place") + units.window).alias("high"))
        dealt = late.groupBy("anchor", "content").agg(F.collect_list(part).alias("repeats"))
        verdicts = verdicts.unionByName(dealt)
    verdicts = store(verdicts)

    own = distinct.select("anchor", "content", F.struct("doc", "tie", "start").alias("first"))
    # Stored for the same reason: a stretch that a third of all rows share is dealt to several tasks.
    own = store(own.join(verdicts.where(F.size("repeats") > 0), ["anchor", "content"], "left"))
    release(spark)
    at = F.struct("doc", "tie", "start")
    everything = F.array(F.struct(F.lit(0).cast("long").alias("low"), F.col("length").alias("high")))
    parts = F.when(at == F.col("first"), F.col("repeats")).otherwise(everything)
    ranges = occurrences.join(own, ["anchor", "content"]).select("doc", "tie", "start", F.explode(parts).alias("r"))
    ranges = ranges.select(
        "doc", "tie", F.struct((F.col("start") + F.col("r.low")).alias("low"), (F.col("start") + F.col("r.high")).alias("high")).alias("r")
    )
    return ranges.groupBy("doc", "tie").agg(F.collect_list("r").alias("ranges"))


def merged(ranges: pa.ListArray) -> Iterator[list[tuple[int, int]]]:
    """For each row of a column of (low, high): overlapping and touching ranges joined, in order."""
    at = np.append(ranges.offsets.to_numpy(), 0)[: len(ranges) + 1]
    low, high = (ranges.values.field(x).to_numpy() for x in ("low", "high"))
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if a == b:
            yield []
            continue
        order = np.argsort(low[a:b], kind="stable")
        first, last = low[a:b][order], np.maximum.accumulate(high[a:b][order])
        new = np.ones(b - a, bool)
        new[1:] = first[1:] > last[:-1]
        heads = np.flatnonzero(new)
        yield list(zip(first[heads].tolist(), last[np.append(heads[1:], b - a) - 1].tolist(), strict=True))
