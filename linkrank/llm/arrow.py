"""Text columns as NumPy arrays: words, 64-bit hashes and pieces of bounded size, without a loop per word."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

#: White space between words: 0x20 and 0x09-0x0D.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

#: A-Z to a-z, all other bytes unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

CHUNK_BYTES = 1 << 20

#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit values (the finishing step of splitmix64)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_FIRST_BYTES = np.array([(1 << 8 * k) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
_LENGTH = np.uint64(0x9E3779B97F4A7C15)


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each place as one number, with zeros after the end."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray(len(data) + 1, np.uint64, padded, strides=(1,))


def range_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hashes of ranges of bytes, equal for equal ranges.

    Eight bytes after the other are mixed in, so no pattern of bytes makes different ranges
    collide more often than chance; ranges of up to eight bytes and one length never do.
    """
    parts, length = eights(data), end - start
    out = mix((parts[start] & _FIRST_BYTES[np.minimum(length, 8)]) + length.astype(np.uint64) * _LENGTH)
    rest, at = np.flatnonzero((length > 8) & (length <= LONG_WORD)), 8
    while len(rest):
        more = parts[start[rest] + at] & _FIRST_BYTES[np.minimum(length[rest] - at, 8)]
        out[rest] = mix(out[rest] ^ more)
        at += 8
        rest = rest[length[rest] > at]
    for i in np.flatnonzero(length > LONG_WORD).tolist():
        out[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes(), int(length[i]) & 0xFFFF)
    return out


def sequence_hashes(values: np.ndarray, at: np.ndarray | slice, offsets: Iterable[int]) -> np.ndarray:
    """Hashes of the values at ``at`` + each of ``offsets``; the values must be well mixed."""
    total = None
    for k, o in enumerate(offsets):
        part = values[slice(at.start + o, at.stop + o)] if isinstance(at, slice) else values[at + o]
        part = part * _FACTORS[k]
        total = part if total is None else np.add(total, part, out=total)
    return mix(total)


def raw_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes of a string column and where each text begins; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return whole, at


def chunks(bounds: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    low, n = 0, len(bounds) - 1
    while low < n:
        high = int(np.searchsorted(bounds, bounds[low] + limit, "right")) - 1
        high = min(n, max(high, low + 1))
        yield low, high
        low = high


class Words(NamedTuple):
    """Words of several texts: byte ranges, and the number of the first word of each text."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray


#: Odd factors of the places of a sequence.
_FACTORS = mix(np.arange(1, 1 << 12, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) | np.uint64(1)


def find_words(data: np.ndarray, bounds: np.ndarray, between: np.ndarray = IS_SPACE) -> Words:
    """Maximal runs without white space, or without the bytes of another table; no word crosses
    the end of a text.

    ``bounds`` are positions in ``data``: where each text begins, and where the last ends.
    """
    word = np.zeros(len(data) + 1, bool)
    word[:-1] = ~between[data]
    begins = word[:-1].copy()
    begins[1:] &= ~word[:-2]
    inner = bounds[:-1]
    inner = inner[inner < len(data)]
    begins[inner] = word[inner]
    ends = word[:-1] & ~word[1:]
    last = bounds[1:]
    last = last[last > 0] - 1
    ends[last] = word[last]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    return Words(start, end, np.searchsorted(start, bounds))


def strings(values: list[str] | np.ndarray) -> pa.Array:
    return pa.array(values, pa.string())


def longs(values) -> pa.Array:
    values = np.asarray(values)
    return pa.array(values.view(np.int64) if values.dtype == np.uint64 else values.astype(np.int64), pa.int64())


def lists(values: np.ndarray, lengths) -> pa.Array:
    """List column of 64-bit numbers from all its values and the length of each list."""
    at = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=at[1:])
    return pa.ListArray.from_arrays(pa.array(at), longs(values))


def word_hashes(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of several texts, and the number of the first word of each text.

    Long data are worked on piece by piece, cut at white space.
    """
    if len(data) <= 4 * CHUNK_BYTES:
        words = find_words(data, bounds)
        return range_hashes(data, words.start, words.end), words.first
    if len(bounds) > 2:
        parts = [word_hashes(data[a:b], np.array([0, b - a])) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        first = np.cumsum([0, *(len(x) for x, _ in parts)])
        return np.concatenate([x for x, _ in parts]), first
    found, at = [], 0
    while at < len(data):
        end = min(len(data), at + CHUNK_BYTES)
        while end < len(data) and not IS_SPACE[data[end]]:
            end += 1
        words = find_words(data[at:end], np.array([0, end - at]))
        found.append(range_hashes(data[at:end], words.start, words.end))
        at = end
    whole = np.concatenate(found)
    return whole, np.array([0, len(whole)])
