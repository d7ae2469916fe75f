"""The trie of conversations against one built turn by turn."""

import hashlib
import random
import zlib

import pytest

from linkrank.llm import prefixes, sketch

SCHEMA = "conv_id long, turn long, role string, text string, pos string, length string"


def in_order(rows):
    """Turns (role, text) of each conversation; NULL turns first, NULL texts empty."""
    out = {}
    for c, turn, role, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "")):
        if c is not None:
            out.setdefault(c, []).append((role or "", text or ""))
    return out


def rebuild(given):
    out = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - int(c / 100) * 100  # the remainder has the sign of c
        out[c] = given.get(c - base, [])[:h] + turns[h:]
    return out


def plain_trie(conversations):
    members = {}
    for c, turns in conversations.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children = {node: set() for node in members}
    for node in members:
        if node:
            children[node[:-1]].add(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        own = (len(members[node]) - 1) * len(node[-1][1]) if node else 0
        saved[node] = own + sum(saved[x] for x in children[node])
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
    out = []
    for node, who in members.items():
        ends = ",".join(str(c) for c in sorted(who) if len(conversations[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        digest = hashlib.sha256(ends.encode()).hexdigest()
        out.append((min(who), len(node), parent, len(who), len(children[node]), leaves[node], saved[node], digest))
    return sorted(out, key=str)


def rows_of(rng, n=60):
    first = [("user", f"first {k}") for k in range(3)]
    texts = [("assistant", "yes"), ("user", "é\U0001f600"), ("user", ""), ("assistant", "a longer answer " * 5)]
    rows = []
    for c in rng.sample(range(-150, 700), n):
        turns = [rng.choice(first)] + [rng.choice(texts) for _ in range(rng.randrange(0, 9))]
        rows += [(c, k, *t) for k, t in enumerate(turns)]
    copy = [("user", "the same"), *texts, *texts]
    rows += [(c, k, *t) for c in range(800, 830) for k, t in enumerate(copy)]
    rows += [(900, k, "user", f"turn {k}") for k in range(300)] + [(901, k, "user", f"turn {k}") for k in range(300)]
    rows += [(7001, None, "user", "before all"), (7001, 3, None, None), (7001, 3, None, None), (None, 1, "user", "nobody's")]
    rows += [(7002, 1, "b", "tie"), (7002, 1, "a", "tie"), (7003, 0, "user", "x\0:y")]
    rng.shuffle(rows)
    return rows


@pytest.fixture
def turns(spark):
    return lambda rows: spark.createDataFrame([(*r, "p", "l") for r in rows], SCHEMA)


@pytest.mark.parametrize("seed", [1, 2])
def test_rebuilt(docs, turns, seed, monkeypatch):
    if seed == 2:  # counters run full: nearly all prefixes are grouped exactly
        monkeypatch.setattr(sketch.Repeated, "may_have", lambda self, x: x % 7 != 99)
    rows = rows_of(random.Random(seed))
    got = prefixes.trie(*prefixes.rebuilt(prefixes.turns_of(turns(rows))))
    assert got.columns == prefixes.COLUMNS
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(rebuild(in_order(rows)))


def test_as_they_are(docs, turns):
    rows = rows_of(random.Random(3), 25)
    got = prefixes.conversation_trie(turns(rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(in_order(rows))


def test_without_turns_left(docs, turns):
    """A conversation shorter than what it takes from an absent one ends at the root."""
    c = next(c for c in range(101, 200) if zlib.crc32(str(c).encode()) % 6 == 3)
    got = prefixes.trie(*prefixes.rebuilt(prefixes.turns_of(turns([(c, 0, "user", "gone")])))).collect()
    assert list(map(tuple, got)) == [(c, 0, None, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


def test_empty_table(docs, turns):
    assert prefixes.conversation_trie(turns([])).collect() == []


def test_ties_go_by_role_and_text(docs, turns):
    """Turns that only their texts tell apart are put in order by them, NULL last, as in the SQL."""
    texts = ["b", "a", "é", "", "\U0001f600", "B", None, "aa", "a"]
    rows = [(c, t, r, x) for c in (3, 4) for t in (None, 1) for r in ("user", None, "assistant", "") for x in texts]
    random.Random(4).shuffle(rows)
    in_sql = sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] is None, r[2] or "", r[3] is None, (r[3] or "").encode()))
    want = {c: [(r or "", x or "") for k, _, r, x in in_sql if k == c] for c in (3, 4)}
    got = prefixes.conversation_trie(turns(rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(want)


def test_wrongly_screened_prefixes_have_parents(docs, turns):
    """Among so many prefixes of one member, counters make some look shared below others that do not."""
    rows = [(c, k, "user", f"{c} {k}") for c in range(700) for k in range(20)]
    got = prefixes.conversation_trie(turns(rows))
    assert sorted(map(tuple, got.collect()), key=str) == plain_trie(in_order(rows))
