"""Every registered query of the subpackage against its SQL, or against brute force."""

import zlib

import duckdb
import numpy as np
import pytest
from checking import compare, duck

from linkrank.llm.catalog import QUERIES, SQL
from linkrank.llm.tokens import default_vocabulary

SMALL, MEDIUM = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


def documents(folder):
    return sorted(duckdb.sql(f"SELECT doc_id, text FROM '{folder}/documents.parquet'").fetchall())


def test_one_query_per_operator():
    assert sorted(int(name[2:].split("_")[0]) for name in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, name):
    assert compare(QUERIES[name](spark, MEDIUM), duck(MEDIUM), SQL[name]) == []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(default_vocabulary())
    found.encode_special_tokens = True
    return found


def test_token_files(spark, tokenizer):
    start, expected = 0, []
    for doc, text in documents(SMALL):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 2], "<u4")
        expected.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = QUERIES["op7_token_codes"](spark, SMALL)
    assert got.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert sorted(map(tuple, got.collect())) == expected


def check_packing(rows, texts, tokenizer, capacity=1024):
    """Each id in exactly one piece with the right digest; sequences gapless and within capacity."""
    by_doc, by_sequence = {}, {}
    for doc, start, length, crc, total, sequence, offset in rows:
        by_doc.setdefault(doc, []).append((start, length, crc, total))
        by_sequence.setdefault(sequence, []).append((offset, length))
    assert set(by_doc) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for start, length, crc, total in sorted(by_doc[doc]):
            assert (start, total) == (at, len(ids)) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_packing(spark, tokenizer):
    texts = dict(documents(SMALL))
    rows = [tuple(r) for r in QUERIES["op9_packing"](spark, SMALL).collect()]
    sequences = check_packing(rows, texts, tokenizer)
    total = sum(r[2] for r in rows)
    assert sequences <= -(-total // 1024) * 1.02 + 1


def test_leaks_on_whole_texts(spark):
    items = duckdb.sql(f"SELECT item_id, text FROM '{MEDIUM}/benchmark.parquet'").fetchall()
    expected = {d: sorted(i for i, b in items if b in t) for d, t in documents(MEDIUM)}
    got = QUERIES["op2_benchmark_leaks"](spark, MEDIUM).collect()
    found = {r["doc_id"]: [int(x) for x in r["item_ids"].split(",") if x] for r in got}
    assert all(set(expected[d]) <= set(found[d]) for d in expected)
    clean = [d for d, x in found.items() if x and not expected[d]]
    assert all(r["coverage"] >= 0.5 for r in got if r["doc_id"] in clean)
    assert all(r["contaminated"] == bool(found[r["doc_id"]]) for r in got)
