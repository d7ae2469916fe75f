"""The pipeline's stages, each against a plain version on its own input."""

import corpus_pipeline
import pytest
from odd_rows import ODD
from test_near_duplicates import brute
from test_operators import base_spans
from test_registered import check_packing

from linkrank.llm import quality
from linkrank.llm.stages import store
from linkrank.llm.tokens import default_vocabulary, encoder

SMALL = "/root/testdata/sf0.001"
STAGES = dict(corpus_pipeline.STAGES)


def test_stages_in_order():
    assert list(STAGES) == ["quality rules", "near duplicates", "decontamination", "personal data", "packing"]


@pytest.fixture(scope="module")
def passed(spark):
    """The input and the result of each stage, as lists of rows."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    out = {"documents": docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        docs = store(stage(spark, docs, SMALL))
        out[name] = docs.collect()
    return out


def texts(rows):
    return {r["doc_id"]: r["text"] for r in rows}


def test_quality(passed):
    kept = texts(passed["quality rules"])
    for doc, text in texts(passed["documents"]).items():
        n_words, _, _, _, n_repeat = quality.measure_text(text.encode())
        assert (doc in kept) == (n_words >= 50 and 100 * n_repeat <= 50 * n_words)


def test_near_duplicates(passed):
    rows = list(texts(passed["quality rules"]).items())
    assert set(texts(passed["near duplicates"])) == {i for i, _, _, kept in brute(rows, 5) if kept}


def test_decontamination(spark, passed):
    items = [r["text"] for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    kept = texts(passed["decontamination"])
    for doc, text in texts(passed["near duplicates"]).items():
        if any(x in text for x in items):
            assert doc not in kept
    gone = set(texts(passed["near duplicates"])) - set(kept)
    assert all(any(x[10:60] in texts(passed["near duplicates"])[d] for x in items) for d in gone)


def test_personal_data(passed):
    before, after = texts(passed["decontamination"]), texts(passed["personal data"])
    assert set(before) == set(after)
    for doc, text in before.items():
        if not base_spans(text) and "[SECRET]" not in after[doc]:
            assert after[doc] == text
        assert not [s for s in base_spans(after[doc]) if s.startswith(("email", "ip", "card"))]
    assert all(r["n_chars"] == len(r["text"]) for r in passed["personal data"] if base_spans(before[r["doc_id"]]))


def test_packing(passed):
    rows = [tuple(r) for r in passed["packing"]]
    check_packing(rows, texts(passed["personal data"]), encoder(default_vocabulary()).tokenizer)


def test_run_is_its_stages(spark, passed):
    key = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    got = sorted(tuple(r[k] for k in key) for r in corpus_pipeline.run(spark, SMALL).collect())
    assert got == sorted(tuple(r[k] for k in key) for r in passed["packing"])


def test_odd_rows_pass_all_stages(spark, docs):
    rows = ODD + [(None, " ".join(f"w{k}" for k in range(90))), (None, " ".join(f"w{k}" for k in range(90)))]
    frame = docs(rows)
    for name, stage in corpus_pipeline.STAGES:
        out = store(stage(spark, frame, SMALL))
        if name != "packing":
            assert out.dtypes == frame.dtypes, name
            frame = out
    assert out.where("doc_id is null").count() >= 2
