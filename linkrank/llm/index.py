"""Suffix indexes of one shard: Burrows-Wheeler transform, wavelet matrix, backward search.

A shard holds a bounded number of short strings over numbered symbols. Suffixes are sorted up to a
fixed depth, which is enough for patterns up to that length.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """Packed bits; the ones before a place come from a count per word and the word's own bits."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        raw = np.zeros((len(bits) // 64 + 1) * 8, np.uint8)
        raw[: len(packed)] = packed
        self.words = raw.view(np.uint64)
        ones = np.bitwise_count(self.words)
        self.before = np.zeros(len(self.words), np.uint32)
        np.cumsum(ones[:-1], out=self.before[1:])

    def ones(self, i: np.ndarray) -> np.ndarray:
        """How many ones stand before each place."""
        word = i >> 6
        low = self.words[word] & ((np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1))
        return self.before[word].astype(np.int64) + np.bitwise_count(low)


class Wavelet:
    """Rank of symbols in a sequence, one bit vector per bit of a symbol, highest first."""

    def __init__(self, sequence: np.ndarray, n_symbols: int):
        self.n_symbols = n_symbols
        self.depth = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        now = sequence
        for level in range(self.depth - 1, -1, -1):
            ones = (now >> level & 1).astype(bool)
            self.levels.append((Bits(ones), len(now) - int(ones.sum())))
            now = np.concatenate([now[~ones], now[ones]])
        symbols = np.arange(n_symbols)
        smaller = np.zeros(n_symbols + 1, np.int64)
        np.cumsum(np.bincount(sequence, minlength=n_symbols), out=smaller[1:])
        #: From a place after the last level to the place of a suffix that begins with the symbol.
        self.shift = smaller[:-1] - self._down(symbols, np.zeros(n_symbols, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.ones(at)
            up = (symbols >> (self.depth - 1 - k) & 1).astype(bool)
            at = np.where(up, zeros + ones, at - ones)
        return at

    def step(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: intervals of the patterns with each symbol put before them."""
        both = self._down(np.concatenate([symbols, symbols]), np.concatenate([low, high]))
        shift = self.shift[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def all_steps(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Backward search with every symbol that stands before the patterns: symbol, intervals."""
        symbols = np.zeros(len(low), np.int64)
        for bits, zeros in self.levels:
            a, b = bits.ones(low), bits.ones(high)
            one, zero = b > a, high - b > low - a
            symbols = np.concatenate([symbols[zero] << 1, symbols[one] << 1 | 1])
            low, high = np.concatenate([(low - a)[zero], zeros + a[one]]), np.concatenate([(high - b)[zero], zeros + b[one]])
        shift = self.shift[symbols]
        return symbols, low + shift, high + shift


class Suffixes:
    """Suffixes of several strings, sorted up to ``depth`` symbols.

    ``symbols`` holds the strings one after the other, each followed by a 0 that stands nowhere
    else. A suffix ends at its string's 0. Ranks of the first so many symbols are made of three
    shorter ones at a time; the first ranks are symbols packed into one number.
    """

    BITS = 21  #: of a rank; three fit into a number

    def __init__(self, symbols: np.ndarray, depth: int):
        if len(symbols) >= 1 << self.BITS:
            raise ValueError("the shard is too large")
        ends = np.flatnonzero(symbols == 0)
        self.end = np.repeat(ends, np.diff(np.concatenate([[-1], ends])))
        self.place = np.arange(len(symbols))
        self.ranks = {1: symbols.astype(np.int64)}
        width = min(depth, max(1, 3 * self.BITS // int(symbols.max()).bit_length()))
        if width > 1:
            self.ranks[width] = self._packed(width)
        while width * 3 <= depth:
            self.ranks[width * 3] = self._named([(width, 0), (width, width), (width, 2 * width)])
            width *= 3
        key = self._combined(self._parts(depth))
        self.order = np.argsort(key, kind="stable")
        self.transform = np.where(self.order > 0, symbols[self.order - 1], 0)

    def _packed(self, width: int) -> np.ndarray:
        symbols, bits = self.ranks[1], int(self.ranks[1].max()).bit_length()
        key = symbols.copy()
        for k in range(1, width):
            key = key << bits | symbols[np.minimum(self.place + k, self.end)]
        return np.unique(key, return_inverse=True)[1]

    def _parts(self, depth: int) -> list[tuple[int, int]]:
        """Widths and offsets of known ranks that cover ``depth`` symbols; the last may overlap."""
        parts, have = [], 0
        while have < depth:
            enough = [w for w in self.ranks if w >= depth - have and w <= depth]
            if enough:
                parts.append((min(enough), depth - min(enough)))
                break
            parts.append((max(w for w in self.ranks if w <= depth), have))
            have += parts[-1][0]
        return parts

    def _combined(self, parts: list[tuple[int, int]]) -> np.ndarray:
        """One number that sorts by several ranks."""
        key = None
        for k, (width, skip) in enumerate(parts):
            rank = self.ranks[width][np.minimum(self.place + skip, self.end)]
            if key is None:
                key = rank
                continue
            if k >= 3:
                key = np.unique(key, return_inverse=True)[1]
            key = key << self.BITS | rank
        return key

    def _named(self, parts: list[tuple[int, int]]) -> np.ndarray:
        return np.unique(self._combined(parts), return_inverse=True)[1]

    def run_starts(self, depth: int) -> np.ndarray:
        """Whether a suffix differs from the one before it within the first ``depth`` symbols."""
        new = np.zeros(len(self.order), bool)
        new[0] = True
        end = self.end[self.order]
        for width, skip in self._parts(depth):
            values = self.ranks[width][np.minimum(self.order + skip, end)]
            new[1:] |= values[1:] != values[:-1]
        return new


def prefix_runs(wavelet: Wavelet, n: int, depth: int) -> np.ndarray:
    """Where the common prefix of neighbouring suffixes is shorter than ``depth``.

    Breadth-first expansion: the intervals of all strings of one symbol, then of two and so on.
    A boundary that is first met at the end of an interval of strings of length k + 1 parts
    suffixes with k common symbols; an interval that ends at a known boundary brings no new one
    and is not expanded. Nothing is expanded beyond ``depth``.
    """
    known = np.zeros(n + 1, bool)
    known[0] = known[n] = True
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for k in range(depth):
        symbols, low, high = wavelet.all_steps(low, high)
        fresh = ~known[high]
        if k:
            fresh &= symbols > 0  # no string runs over the end of another
        known[high[fresh]] = True
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
    return known[:n]
