"""Ranked search against scores of all documents."""

import math
import random
import re

import numpy as np
import pytest
from odd_rows import ODD

from linkrank.llm import ranked


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(ranked.TERM, lower)


def plain_search(docs, items, k):
    counted = [(i, terms(t)) for i, t in docs]
    n_docs, n_terms = sum(bool(x) for _, x in counted), sum(len(x) for _, x in counted)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(terms(t))
    out = []
    for item, words in wanted.items():
        found = []
        for doc, x in counted:
            score = 0
            m = 50 + 50 * len(x) * n_docs // max(n_terms, 1)
            for w in words.intersection(x):
                tf, df = x.count(w), sum(w in set(y) for _, y in counted)
                score += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * (10**9 * tf // (1000 * tf + 20 * m))
            if score > 0:
                found.append((-score, doc is not None, doc or 0, doc))
        out += [(item, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


@pytest.fixture
def items(spark):
    return lambda rows: spark.createDataFrame([(*r, "x", 1) for r in rows], "item_id long, text string, score string, n long")


def corpus(seed):
    rng = random.Random(seed)
    words = [f"W{k}" for k in range(60)] + ["東京", "née", "x2"]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(100 + k, " ".join(rng.choices(words, weights, k=rng.randrange(1, 80)))) for k in range(150)]
    asked = [(k, " ".join(rng.choices(words, k=rng.randrange(1, 12)))) for k in range(12)]
    asked += [(50, None), (51, "..."), (52, "W0 w0 W0"), (None, "W1, née"), (53, "never seen"), (5, "w3-w4 x2")]
    return rows + ODD + rows[:5], asked


@pytest.mark.parametrize(("k", "at_once"), [(7, 10**6), (3, 10), (500, 10**6)])
def test_best_documents(docs, items, k, at_once):
    rows, asked = corpus(k)
    got = ranked.search(docs(rows), items(asked), k=k, terms_at_once=at_once)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=str) == plain_search(rows, asked, k)


def test_creation_of_accumulators_stops_only_when_no_document_can_enter():
    """Blocks in turn give the same as all scores at once, ties included."""
    rng = np.random.default_rng(3)
    n, vocabulary, k = 4000, 12, 5
    best, scores = ranked._Best(k), []
    chosen, weights = np.arange(vocabulary), np.arange(vocabulary, 0, -1) ** 3
    for low in range(0, n, 1000):
        held = rng.random((1000, vocabulary)) < np.linspace(0.002, 0.9, vocabulary)
        doc, term = np.nonzero(held)
        counts, sizes = rng.integers(1, 4, len(doc)), rng.integers(1, 9, 1000)
        block = ranked.Block(np.arange(low, low + 1000), sizes, doc, term.astype(np.int32), counts.astype(np.int32), n, 5 * n, vocabulary)
        block.search(chosen, weights, best)
        part = np.zeros(1000, np.int64)
        m = 50 + 50 * sizes * n // (5 * n)
        np.add.at(part, doc, weights[term] * (10**9 * counts // (1000 * counts + 20 * m[doc])))
        scores.append(part)
    scores = np.concatenate(scores)
    order = np.lexsort((np.arange(n), -scores))[:k]
    assert best.docs.tolist() == order.tolist() and best.scores.tolist() == scores[order].tolist()


def test_empty_tables(docs, items):
    assert ranked.search(docs([]), items([(1, "a")])).collect() == []
    assert ranked.search(docs(ODD), items([])).collect() == []
