"""SimHash fingerprints and groups against a comparison of all pairs."""

import random
import re

import duckdb
import numpy as np
import pytest
import xxhash
from odd_rows import ODD

from linkrank.llm import simhash
from linkrank.llm.catalog import QUERIES

SMALL = "/root/testdata/sf0.001"


def plain_print(text, size=3):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split(b" ")
    words = [w for part in words for w in re.split(rb"[\x09-\x0d]+", part) if w]
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def plain_groups(prints, radius=3):
    """From (id, fingerprint) rows: the smallest id reachable from each id."""
    rows = [(i, p) for i, p in prints if i is not None]
    label = {i: i for i, _ in rows}

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, (i, p) in enumerate(rows):
        for j, q in rows[:k]:
            if (p ^ q).bit_count() <= radius:
                a, b = top(i), top(j)
                label[max(a, b)] = min(a, b)
    return {i: top(i) for i in label}


def check(rows, got):
    prints = [(i, plain_print(t)) for i, t in rows]
    groups = plain_groups(prints)
    expected = [(i, f"{p:016x}", groups.get(i)) for i, p in prints]
    assert sorted(map(tuple, got), key=str) == sorted(expected, key=str)


def test_query_on_all_documents(spark):
    rows = duckdb.sql(f"SELECT doc_id, text FROM '{SMALL}/documents.parquet'").fetchall()
    got = QUERIES["op11_simhash_groups"](spark, SMALL)
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    check(rows, got.collect())


@pytest.mark.parametrize("tile", [4096, 3])
def test_odd_rows_and_copies(docs, tile):
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    rows = list(ODD)
    for k in range(12):
        base = rng.choices(words, k=rng.randrange(30, 200))
        for j in range(rng.randrange(1, 7)):
            base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((100 * k + 20 + j, " ".join(base)))
    rng.shuffle(rows)
    check(rows, simhash.group(docs(rows), tile=tile).collect())


def test_empty_table(docs):
    assert simhash.group(docs([])).collect() == []


@pytest.mark.parametrize("radius", [0, 1, 3, 7])
def test_tiles_connect_what_all_pairs_connect(radius):
    rng = np.random.default_rng(radius)
    centres = rng.integers(0, 1 << 63, 12, dtype=np.uint64)
    prints = np.repeat(centres, 50)
    for _ in range(radius + 1):
        prints = prints ^ (np.uint64(1) << rng.integers(0, 64, len(prints)).astype(np.uint64))
    prints = np.unique(prints)
    expected = plain_groups(list(enumerate(prints.tolist())), radius)
    half = len(prints) // 2
    links = []
    for part in (slice(0, half), slice(half, None)):
        links += zip(*(x + (part.start or 0) for x in simhash.tile_links(prints[part], None, radius)))
    links += zip(*simhash.tile_links(prints[:half], prints[half:], radius))
    assert len(links) <= 30 * len(prints)
    label = list(range(len(prints)))

    def top(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        assert (int(prints[a]) ^ int(prints[b])).bit_count() < 64
        a, b = top(int(a)), top(int(b))
        label[max(a, b)] = min(a, b)
    assert {i: top(i) for i in range(len(label))} == expected
