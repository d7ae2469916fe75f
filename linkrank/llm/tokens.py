"""Token ids of whole texts by a public byte-level BPE vocabulary."""

from __future__ import annotations

from functools import cache

import numpy as np

from linkrank.llm import arrow

#: Pieces of text that each Python worker keeps with their ids (about 100 bytes each).
KEPT_PIECES = 2_000_000

#: Pieces looked up together, and unknown ones encoded as one text.
_TOGETHER, _JOINED = 100_000, 1000

# How the bytes of UTF-8 texts begin white space, by the Unicode standard. The lead
# bytes C2, E1, E2 and E3 may begin white space; 1C to 1F count as neither.
_WHITE = np.zeros(256, bool)
_WHITE[[0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20]] = True
_MAYBE_WHITE_LEAD = np.zeros(256, bool)
_MAYBE_WHITE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_SOLID = ~_WHITE & ~_MAYBE_WHITE_LEAD  # begins a letter that is no white space
_SOLID[0x1C:0x20] = _SOLID[0x80:0xC0] = False


@cache
def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_starts(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Where texts may be cut without changing their ids, in order; each text's begin is among them.

    The vocabulary's own splitting never joins a letter with white space after it. A space before a
    letter belongs to that letter's word, whatever stands before the space, and a single other
    white space character between letters is a part of its own.
    """
    n = len(data)
    white, solid = _WHITE[data], _SOLID[data]
    after_solid = np.zeros(n, bool)  # the letter that ends before this place is no white space
    after_solid[1:] = solid[:-1] & (data[:-1] < 0x80)
    wide = np.zeros(n, bool)
    wide[1:] = data[:-1] >= 0x80
    wide[2:] &= data[:-2] != 0xC2
    wide[3:] &= ~_MAYBE_WHITE_LEAD[data[:-3]]
    after_solid |= wide
    cuts = white & after_solid
    single = np.zeros(n, bool)
    single[1:] = cuts[:-1] & (data[:-1] != 0x20) & solid[1:]
    spaces = np.zeros(n, bool)
    spaces[:-1] = (data[:-1] == 0x20) & solid[1:]
    spaces[bounds[1:][bounds[1:] > 0] - 1] = False  # what follows is another text
    cuts |= single | spaces
    begins = bounds[:-1]
    cuts[begins[begins < n]] = True
    return np.flatnonzero(cuts)


class Encoder:
    """Ids of many texts. The strings of special tokens count as ordinary text.

    Texts are cut into pieces, about words; each is encoded once by the library and then found in
    a hash table of arrays. A piece is known by a 64-bit hash.
    """

    def __init__(self, vocabulary: str, kept_pieces: int = KEPT_PIECES):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # no piece is encoded twice
        names = self.tokenizer.get_vocab(with_added_tokens=False)
        self.id_bytes = np.zeros(max(names.values()) + 1, np.int64)  # one letter stands for one byte
        self.id_bytes[list(names.values())] = [len(x) for x in names]
        self.kept_pieces = kept_pieces
        self.slots = 1 << (2 * (kept_pieces + _TOGETHER) - 1).bit_length()
        self.keys = np.zeros(self.slots, np.uint64)
        self.entry = np.zeros(self.slots, np.int32)
        self._clear()

    def _clear(self) -> None:
        self.keys[:] = 0
        self.n, self.used = 0, 0
        self.first = np.zeros(1 << 16, np.int32)
        self.count = np.zeros(1 << 16, np.int32)
        self.pool = np.zeros(1 << 18, np.uint32)

    def _slots_of(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, or the free one where it belongs."""
        slot = (hashes & np.uint64(self.slots - 1)).astype(np.int64)
        key = self.keys[slot]
        rest = np.flatnonzero((key != hashes) & (key != 0))
        while len(rest):
            slot[rest] = (slot[rest] + 1) & (self.slots - 1)
            key = self.keys[slot[rest]]
            rest = rest[(key != hashes[rest]) & (key != 0)]
        return slot

    def _insert(self, hashes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> None:
        """Add distinct unknown pieces, with the ids of all one after the other."""
        n = len(hashes)
        while self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool, np.zeros_like(self.pool)])
        while self.n + n > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.count = np.concatenate([self.count, np.zeros_like(self.count)])
        self.pool[self.used : self.used + len(ids)] = ids
        self.first[self.n : self.n + n] = self.used + np.cumsum(counts) - counts
        self.count[self.n : self.n + n] = counts
        rest = np.arange(n)
        while len(rest):
            slot = self._slots_of(hashes[rest])
            slot, one = np.unique(slot, return_index=True)  # others that want the same slot try again
            self.keys[slot] = hashes[rest[one]]
            self.entry[slot] = self.n + rest[one]
            rest = np.delete(rest, one)
        self.n += n
        self.used += len(ids)

    def _ids(self, text: bytes) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text.decode()], add_special_tokens=False)[0].ids, np.uint32)

    def _encoded(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All ids of some pieces, how many each has, and in which order the pieces are.

        Words with a space before are encoded many in one text: each of them is cut off there.
        """
        length = end - start
        second = data[np.minimum(start + 1, len(data) - 1)]
        plain = (length > 1) & (data[start] == 0x20) & _SOLID[second]
        order = np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])
        n_plain, ids, counts = int(plain.sum()), [], []
        for low in range(0, n_plain, _JOINED):
            some = order[low : min(n_plain, low + _JOINED)]
            ends = np.cumsum(length[some])
            place = np.repeat(start[some] - ends + length[some], length[some]) + np.arange(ends[-1])
            ids.append(self._ids(data[place].tobytes()))
            cuts = np.searchsorted(np.cumsum(self.id_bytes[ids[-1]]), ends) + 1
            counts.append(np.diff(cuts, prepend=0))
        for i in order[n_plain:].tolist():
            ids.append(self._ids(data[start[i] : end[i]].tobytes()))
            counts.append([len(ids[-1])])
        return np.concatenate(ids), np.concatenate(counts), order

    def encode(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of several texts, and where each text's begin; give some hundred kilobytes."""
        start = piece_starts(data, bounds)
        end = np.append(start[1:], len(data))
        hashes = arrow.range_hashes(data, start, end)
        hashes[hashes == 0] = 1
        found, counts = [], np.zeros(len(start) + 1, np.int64)
        for low in range(0, len(start), _TOGETHER):
            some = hashes[low : low + _TOGETHER]
            if self.n >= self.kept_pieces:
                self._clear()
            slot = self._slots_of(some)
            missing = np.flatnonzero(self.keys[slot] == 0)
            if len(missing):
                new, one = np.unique(some[missing], return_index=True)
                at = low + missing[one]
                ids, count, order = self._encoded(data, start[at], end[at])
                self._insert(new[order], ids, count)
                slot[missing] = self._slots_of(some[missing])
            entry = self.entry[slot]
            count = self.count[entry]
            ends = np.cumsum(count, dtype=np.int64)
            place = np.repeat(self.first[entry] - ends + count, count) + np.arange(ends[-1])
            found.append(self.pool[place])
            counts[low + 1 : low + 1 + len(some)] = count
        ids = np.concatenate(found) if found else np.zeros(0, np.uint32)
        return ids, np.cumsum(counts)[np.searchsorted(start, bounds)]


@cache
def encoder(vocabulary: str, kept_pieces: int = KEPT_PIECES) -> Encoder:
    """One per Python worker."""
    return Encoder(vocabulary, kept_pieces)
