"""Ranked lexical search, term at a time with limited accumulators.

Each task works through blocks of documents. For an item, the postings of its terms are added up
rarest term first, into one accumulator per document. What a term can add at most is known from
its postings in the block. Once all terms that are left together cannot lift a new document to
the kth best score so far, no accumulators are created any more; the documents that have one go
on being updated, so their scores are exact. The kth best score is that of the task's earlier
blocks, or a partial one of this block.

Items are searched for in blocks of bounded size, so that a block's terms can be sent to all tasks.
"""

from __future__ import annotations

import math
import string
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import given_id, known_id, read, store, whole_text
from linkrank.operators.rank import top_n_per_group

TOP = 50
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
TERMS_AT_ONCE = 200_000  #: terms of items, about, that are searched for together

#: Bytes that stand between terms: all of ASCII but letters and digits.
BETWEEN = np.zeros(256, bool)
BETWEEN[:128] = [not chr(x).isalnum() for x in range(128)]


@dataclass(frozen=True)
class Items:
    """A block of items with the numbers of their terms, rarest first."""

    ids: list[int]
    terms: list[np.ndarray]
    weights: list[np.ndarray]


def _index(known: np.ndarray):
    """From doc, text: doc, n (terms with repeats), and the numbers and counts of known terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, at = arrow.raw_bytes(batch.column(1))
            for low, high in arrow.chunks(at):
                data, bounds = arrow.LOWER[whole[at[low] : at[high]]], at[low : high + 1] - at[low]
                words = arrow.find_words(data, bounds, BETWEEN)
                hashes = arrow.range_hashes(data, words.start, words.end)
                number = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
                same = np.flatnonzero(known[number] == hashes) if len(known) else np.zeros(0, np.int64)
                doc = np.searchsorted(words.first, same, "right") - 1
                pairs, counts = np.unique(doc * max(len(known), 1) + number[same], return_counts=True)
                doc, number = np.divmod(pairs, max(len(known), 1))
                ends = np.zeros(high - low + 1, np.int32)
                np.cumsum(np.bincount(doc, minlength=high - low), out=ends[1:])
                columns = [
                    batch.column(0).slice(low, high - low),
                    arrow.longs(np.diff(words.first)),
                    *(pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (number, counts)),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "terms", "counts"])

    return run


class _Best:
    """The best documents of an item so far: at most k, higher scores and then smaller ids first."""

    def __init__(self, k: int):
        self.k = k
        self.docs, self.scores = np.zeros(0, np.int64), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must reach: the kth best score, or a score above 0."""
        return int(self.scores[-1]) if len(self.scores) == self.k else 1

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        enough = scores >= self.least
        docs, scores = np.concatenate([self.docs, docs[enough]]), np.concatenate([self.scores, scores[enough]])
        order = np.lexsort((docs, -scores))[: self.k]
        self.docs, self.scores = docs[order], scores[order]


class Block:
    """Postings of a block of documents."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, doc: np.ndarray, terms: np.ndarray, counts: np.ndarray, n_docs: int, n_terms: int, vocabulary: int):
        self.docs = docs
        order = np.argsort(terms, kind="stable")
        self.doc, terms, counts = doc[order], terms[order], counts[order].astype(np.int64)
        lengths = 50 + 50 * sizes * n_docs // max(n_terms, 1)
        self.parts = 1_000_000_000 * counts // (1000 * counts + 20 * lengths[self.doc])
        self.at = np.searchsorted(terms, np.arange(vocabulary + 1))
        self.most = np.zeros(vocabulary, np.int64)
        some = self.at[1:] > self.at[:-1]
        if some.any():
            self.most[some] = np.maximum.reduceat(self.parts, self.at[:-1][some])

    def search(self, terms: np.ndarray, weights: np.ndarray, best: _Best) -> None:
        """Add the block's best documents for an item; its terms come rarest first."""
        scores = np.zeros(len(self.docs), np.int64)
        bounds = weights * self.most[terms]
        left = np.cumsum(bounds[::-1])[::-1]  # what a document can get from here on
        k, least, creating = best.k, best.least, True
        for j, (term, weight) in enumerate(zip(terms.tolist(), weights.tolist(), strict=True)):
            if not bounds[j]:
                continue
            if creating and j:
                if len(scores) >= k:
                    partial = int(np.partition(scores, len(scores) - k)[len(scores) - k])
                    least = max(least, partial)
                creating = bool(left[j] >= least)
            a, b = self.at[term], self.at[term + 1]
            doc, part = self.doc[a:b], self.parts[a:b]
            if not creating:
                alive = scores[doc] > 0
                doc, part = doc[alive], part[alive]
                if not len(doc):
                    continue
            scores[doc] += weight * part  # a document has one posting per term
        found = np.flatnonzero(scores >= best.least)
        best.add(self.docs[found], scores[found])


def _search(items, n_docs: int, n_terms: int, vocabulary: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: Items = items.value
        best = [_Best(k) for _ in given.ids]
        for batch in batches:
            column = batch.column(2)
            at = np.append(column.offsets.to_numpy(), 0)[: len(column) + 1]
            doc = np.repeat(np.arange(len(batch)), np.diff(at))
            flat = [batch.column(c).values.to_numpy()[at[0] : at[-1]] for c in (2, 3)]
            block = Block(batch.column(0).to_numpy(), batch.column(1).to_numpy(), doc, *flat, n_docs, n_terms, vocabulary)
            for terms, weights, mine in zip(given.terms, given.weights, best, strict=True):
                block.search(terms, weights, mine)
        for item, mine in zip(given.ids, best, strict=True):
            if len(mine.docs):
                columns = [np.full(len(mine.docs), item), mine.docs, mine.scores]
                yield pa.RecordBatch.from_arrays([arrow.longs(x) for x in columns], ["item", "doc", "score"])

    return run


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _item_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct terms of each item: item, term."""
    lower = F.translate(whole_text(text_col), string.ascii_uppercase, string.ascii_lowercase)
    terms = F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))
    return items.select(known_id(id_col).alias("item"), F.explode(terms).alias("term")).distinct()


def search(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    k: int = TOP,
    terms_at_once: int = TERMS_AT_ONCE,
) -> DataFrame:
    """The k best documents of each item: item_id, rank (from 1), doc_id, score.

    Each row of ``docs`` is a document, repeated ones too; equal scores are ranked by doc_id, NULL
    first. Rows of ``items`` with one id are one item. A NULL or empty text has no terms: such a
    document is never found and such an item has no rows. Empty tables give no rows; other
    columns are ignored. Terms are compared by 64-bit hashes.
    """
    rows = docs.select(known_id(id_col).alias("doc"), whole_text(text_col).alias("text"))
    wanted = store(_item_terms(items, item_id_col, item_text_col))
    blocks = max(1, -(-wanted.count() // terms_at_once))
    found = None
    for block in range(blocks):
        some = wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        ranked = _search_block(rows, some, k)
        found = ranked if found is None else found.unionByName(ranked)
    # First per share of the tasks' results, then over all.
    order = [F.desc("score"), F.asc("doc")]
    found = found.withColumn("share", F.pmod(F.xxhash64("doc"), F.lit(16)))
    found = top_n_per_group(found, ["item", "share"], order, k)
    found = top_n_per_group(found.drop("share"), ["item"], order, k, "rank")
    return found.select(given_id("item").alias("item_id"), F.col("rank").cast("int").alias("rank"), given_id("doc").alias("doc_id"), "score")


def _search_block(rows: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    spark = rows.sparkSession
    pairs = [(r["item"], r["term"]) for r in wanted.collect()]  # about TERMS_AT_ONCE rows
    raw = [x.encode() for x in sorted({t for _, t in pairs})]
    ends = np.cumsum([len(x) for x in raw], dtype=np.int64) if raw else np.zeros(0, np.int64)
    starts = ends - [len(x) for x in raw] if raw else ends
    hashes = arrow.range_hashes(np.frombuffer(b"".join(raw), np.uint8), starts, ends)
    known, number = np.unique(hashes, return_inverse=True)
    numbers = dict(zip((x.decode() for x in raw), number.tolist(), strict=True))

    index = store(rows.mapInArrow(_index(known), "doc bigint, n bigint, terms array<int>, counts array<int>"))
    totals = index.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("terms")).first()
    n_docs, n_terms = totals["docs"], totals["terms"] or 0
    frequencies = index.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("n")).collect()  # one row per known term
    df = np.zeros(max(len(known), 1), np.int64)
    for r in frequencies:
        df[r["t"]] = r["n"]

    by_item: dict[int, list[int]] = {}
    for item, term in pairs:
        by_item.setdefault(item, []).append(numbers[term])
    ids = sorted(by_item)
    terms = [np.array(sorted(by_item[x], key=lambda t: (df[t], t))) for x in ids]
    weights = [np.array([_weight(n_docs, int(df[t])) for t in x], np.int64) for x in terms]
    block = spark.sparkContext.broadcast(Items(ids, terms, weights))
    results = index.where(F.size("terms") > 0).mapInArrow(_search(block, n_docs, n_terms, len(known), k), "item bigint, doc bigint, score bigint")
    return store(results)


_SQL = rf"""
WITH terms AS MATERIALIZED (
  SELECT doc_id, row, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) AS term
  FROM (SELECT doc_id, text, row_number() OVER () AS row FROM documents)
), totals AS (
  SELECT count(DISTINCT row) AS n_docs, count(*) AS n_terms FROM terms
), wanted AS MATERIALIZED (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{TERM}')) AS term
  FROM benchmark
), sizes AS (
  SELECT row, doc_id, 50 + (50 * count(*) * (SELECT n_docs FROM totals)) // (SELECT n_terms FROM totals) AS m FROM terms GROUP BY row, doc_id
), counted AS (
  SELECT row, term, count(*) AS tf FROM terms WHERE term IN (SELECT term FROM wanted) GROUP BY row, term
), weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * (SELECT n_docs FROM totals) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM counted GROUP BY term
), scored AS (
  SELECT item_id, row, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM wanted JOIN counted USING (term) JOIN weights USING (term) JOIN sizes USING (row) GROUP BY item_id, row, doc_id
)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scored WHERE score > 0) WHERE rank <= {TOP}
"""


@query("op13_ranked_search", _SQL)
def ranked_search(spark: SparkSession, folder: str) -> DataFrame:
    return search(read(spark, folder, "documents"), read(spark, folder, "benchmark"))
