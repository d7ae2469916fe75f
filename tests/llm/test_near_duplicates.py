"""Near duplicates against all pairs."""

import random
from itertools import combinations

import numpy as np
import pytest
from odd_rows import ODD

from linkrank.llm import arrow, neardup
from linkrank.llm.components import components


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(zip(*[words[k:] for k in range(size)], strict=False))


def brute(rows, size, percent=80):
    sets = {}
    for i, t in rows:
        sets.setdefault(i, []).append(shingles(t, size))
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations([i for i in sorted(x for x in sets if x is not None)], 2):
        if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
            ra, rb = root(a), root(b)
            parent[max(ra, rb)] = min(ra, rb)
    out = []
    for i, t in rows:
        one = shingles(t, size)
        component = None if i is None else root(i)
        out.append((i, len(one), component, i is None or component == i))
    return sorted(out, key=str)


def texts(seed=3, n=60):
    """Families of texts with more and more words changed, some chained, and strangers."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(4000)]
    rows, doc = [], 100
    for family in range(n // 6):
        base = rng.choices(words, k=rng.choice([12, 40, 90]))
        for step in range(6):
            rows.append((doc, " ".join(base)))
            doc += 1
            base = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 5])):
                base[rng.randrange(len(base))] = rng.choice(words)
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("size", [2, 5])
def test_groups_equal_all_pairs(docs, size):
    rows = texts() + ODD
    got = neardup.group(docs(rows), size=size)
    assert got.columns == ["doc_id", "n_shingles", "component_id", "kept"]
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, size)


def test_a_hub_with_many_unlike_members(docs):
    """Bucket members that only a member other than the centre is like are linked all the same."""
    rng = random.Random(1)
    words = [f"v{k}" for k in range(60)]
    rows = [(k, " ".join(rng.sample(words, 40))) for k in range(40)]
    rows = [(i, t + " " + " ".join(f"common{k}" for k in range(120))) for i, t in rows]
    got = neardup.group(docs(rows), size=2, percent=75)
    assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 2, 75)


def test_one_document_of_each_group_stays_with_all_columns(docs):
    rows = texts(5) + ODD
    frame = docs(rows)
    kept = neardup.drop_near_duplicates(frame, size=5)
    assert kept.dtypes == frame.dtypes
    names = {i for i, _, _, k in brute(rows, 5) if k}
    assert {r["doc_id"] for r in kept.collect()} == names


def test_unlike_texts_of_one_id_all_stay(docs):
    rng = random.Random(8)
    base = [" ".join(rng.choices([f"z{k}" for k in range(500)], k=80)) for _ in range(4)]
    rows = [(7, None), (7, base[0]), (7, base[0]), (7, base[1]), (9, base[1] + " end"), (3, base[2]), (3, base[3] + " x"), (12, base[3])]
    kept = neardup.drop_near_duplicates(docs(rows)).collect()
    found = {(r["doc_id"], r["text"]) for r in kept}
    assert len(kept) == len(found)
    # Of the last pair one stays: the further text of an id comes after ordinary ids.
    both = {(7, None), (7, base[0]), (3, base[2])}
    assert both <= found and len(found & {(7, base[1]), (9, base[1] + " end")}) == 1 and len(found & {(3, base[3] + " x"), (12, base[3])}) == 1
    assert len(found) == 5


def test_words_of_one_pattern_are_not_taken_for_each_other(docs):
    one = "a"
    for _ in range(10):
        one += one.translate(str.maketrans("ab", "ba"))
    rows = [(1, f"{one} x y"), (2, f"{one.translate(str.maketrans('ab', 'ba'))} x y"), (3, f"{one} x y z")]
    got = {r["doc_id"]: r["component_id"] for r in neardup.group(docs(rows), size=2).collect()}
    assert got == {1: 1, 2: 2, 3: 3}


def test_members_of_several_components_meet(docs):
    """Two groups in common buckets, and chains between them that no centre sees."""
    rng = random.Random(4)
    core = [f"c{k}" for k in range(150)]
    rows = []
    for i in range(60):
        own = rng.sample([f"o{k}" for k in range(70)], 24 + i % 9)
        rows.append((i, " ".join(core + own)))
    for percent in (70, 76):
        got = neardup.group(docs(rows), size=1, percent=percent)
        assert sorted(map(tuple, got.collect()), key=str) == brute(rows, 1, percent)


def test_empty_table(docs):
    assert neardup.group(docs([])).collect() == []


def test_signatures_agree_as_often_as_sets_do():
    rng = np.random.default_rng(1)
    common = rng.integers(0, 1 << 62, 800).astype(np.uint64)
    a = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    b = np.unique(np.concatenate([common, rng.integers(0, 1 << 62, 100).astype(np.uint64)]))
    assert abs((neardup.signature(a) == neardup.signature(b)).mean() - 0.8) < 0.1


def test_white_space_and_case_are_bytes():
    raw = "Ab\x0bc d\u0085 Été\x1cx".encode()
    data = np.frombuffer(raw, np.uint8)
    words = arrow.find_words(data, np.array([0, len(data)]))
    assert [raw[a:b] for a, b in zip(words.start, words.end, strict=True)] == raw.split()


def test_components_of_a_long_path(spark):
    path = spark.createDataFrame([(k + 1, k) for k in range(60)] + [(500, 499), (499, 501)], "a bigint, b bigint")
    got = {r["node"]: r["component"] for r in components(path).collect()}
    assert got == {k: 0 for k in range(61)} | {499: 499, 500: 499, 501: 499}
