"""Repeated words and bytes against a set of all windows seen so far."""

import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from odd_rows import ODD

from linkrank.llm import bytes_dedup, passages, substrings
from linkrank.llm.index import Suffixes, Wavelet, prefix_runs
from linkrank.llm.passages import Shard


def covered(sequences, window):
    """For each (id, sequence), in order: which units a window that also starts earlier covers.
    Equal (id, sequence) pairs are one document."""
    seen, out = set(), {}
    for key, units in sequences:
        if key in out:
            continue
        flags, new = np.zeros(len(units), bool), set()
        for k in range(len(units) - window + 1):
            part = units[k : k + window]
            if part in seen or part in new:
                flags[k : k + window] = True
            new.add(part)
        seen |= new
        out[key] = flags
    return out


def ordered(rows):
    import zlib

    keyed = [((-1 if i is None else i), zlib.crc32((t or "").encode()), t or "") for i, t in rows]
    return sorted(keyed)


def passages_texts(seed=2):
    rng = random.Random(seed)
    words = [f"t{k}" for k in range(300)]
    shared = [" ".join(rng.choices(words, k=n)) for n in (19, 20, 21, 35, 60, 120)]
    rows = []
    for doc in range(100, 150):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            parts.append(rng.choice(shared) if rng.random() < 0.5 else " ".join(rng.choices(words, k=rng.randrange(1, 60))))
        rows.append((doc, " ".join(parts)))
    rng.shuffle(rows)
    return rows + [(90, " ".join(["x y"] * 60)), (91, "z " * 45), (92, shared[3] + " " + shared[3])]


@pytest.mark.parametrize("most", [4000, 1])
def test_words(docs, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST_STRETCHES", most)
    rows = passages_texts() + ODD
    keyed = ordered(rows)
    flags = covered([((i, c), tuple(t.encode().split())) for i, c, t in keyed], 20)
    expected = []
    for i, c, t in keyed:
        words = t.encode().split()
        kept = b" ".join(w for w, f in zip(words, flags[i, c], strict=True) if not f)
        expected.append((None if i == -1 else i, len(words), int(flags[i, c].sum()), hashlib.sha256(kept).hexdigest()))
    got = substrings.summary(docs(rows))
    assert got.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("most", [4000, 1])
def test_bytes(docs, monkeypatch, most):
    monkeypatch.setattr(passages, "MOST_STRETCHES", most)
    rows = passages_texts(4) + ODD
    keyed = ordered(rows)
    flags = covered([((i, c), t.encode()) for i, c, t in keyed], 100)
    expected = []
    for i, c, t in keyed:
        f = flags[i, c]
        kept = bytes(b for b, x in zip(t.encode(), f, strict=True) if not x)
        spans = int((np.diff(np.concatenate([[0], f.astype(int)])) == 1).sum())
        expected.append((None if i == -1 else i, len(f), int(f.sum()), spans, hashlib.sha256(kept).hexdigest()))
    got = bytes_dedup.summary(docs(rows))
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(expected, key=str)


def test_texts_that_are_kept(docs):
    long = " ".join(f"u{k}" for k in range(30))
    rows = [(1, long), (2, "before " + long + " after"), (3, None)]
    kept = {r["doc_id"]: r["kept"] for r in substrings.remove_repeats(docs(rows)).collect()}
    assert kept == {1: long, 2: "before after", 3: ""}
    kept = {r["doc_id"]: bytes(r["kept"]) for r in bytes_dedup.remove_repeats(docs(rows), window=60).collect()}
    assert kept == {1: long.encode(), 2: b"before  after", 3: b""}


def test_empty_tables(docs):
    assert substrings.summary(docs([])).collect() == []
    assert bytes_dedup.summary(docs([])).collect() == []


def test_long_texts_are_found_segment_by_segment(docs, monkeypatch):
    monkeypatch.setattr(passages, "_SEGMENT", 64)
    rng = random.Random(9)
    long = [f"q{rng.randrange(50)}" for _ in range(900)]
    units = substrings.word_units()
    from linkrank.llm import arrow

    data = np.frombuffer(" ".join(long + long[100:400]).encode(), np.uint8)
    values, bounds = units.values(data, np.array([0, len(data)]))
    whole = [x.tolist() for x in passages._stretches(units, values, bounds)]
    assert len(values) == 1200 and arrow.word_hashes(data, np.array([0, len(data)]))[1].tolist() == [0, 1200]
    windows = set()
    for _, _, _, start, length in zip(*whole, strict=True):
        windows |= set(range(start, start + length - 19))
    assert windows == set(range(1181))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(1, 3), min_size=6, max_size=30), min_size=1, max_size=8))
def test_both_indexes_find_the_earliest_window(sequences):
    window = 6
    values = np.array([x for s in sequences for x in s], np.uint64)
    lengths = np.array([len(s) for s in sequences], np.int64)
    starts = np.arange(len(sequences)) * 3 % 7
    shard = Shard(values, lengths, starts, np.arange(len(sequences))[::-1].copy())
    keys, first = shard.window_keys(window), {}
    symbols, _ = shard.numbered()
    for p, key in enumerate(keys.tolist()):
        if key != np.iinfo(np.int64).max:
            part = tuple(symbols[p : p + window].tolist())
            first[part] = min(first.get(part, key), key)
    for earliest in (substrings.matching_statistics(shard, window), bytes_dedup.expanded_intervals(shard, window)):
        for p, key in enumerate(keys.tolist()):
            if key != np.iinfo(np.int64).max:
                assert earliest[p] == first[tuple(symbols[p : p + window].tolist())]


def test_common_prefixes_stop_at_the_depth():
    text = np.array([1, 2, 1, 2, 1, 2, 3, 0, 1, 2, 1, 0])
    suffixes = Suffixes(text, 4)
    runs = prefix_runs(Wavelet(suffixes.transform, 4), len(text), 3)

    def first(p, n):
        out = []
        for x in text[p : p + n]:
            out.append(int(x))
            if not x:
                break
        return out

    order = suffixes.order.tolist()
    expected = [True] + [first(a, 3) != first(b, 3) for a, b in zip(order, order[1:])]
    assert runs.tolist() == expected


def test_wavelet_ranks():
    rng = np.random.default_rng(4)
    sequence = rng.integers(0, 11, 700)
    index = Wavelet(sequence, 11)
    smaller = np.array([int((sequence < c).sum()) for c in range(11)])
    for c in range(11):
        low = np.arange(0, 701, 7)
        got, _ = index.step(np.full(len(low), c), low, low)
        assert got.tolist() == [int(smaller[c] + (sequence[:i] == c).sum()) for i in low]
