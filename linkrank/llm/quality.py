"""Quality rules with host verdicts.

Each document is measured and tested by itself: length, repeated words, symbols, repeated lines,
length of words. Then the failures of each rule are added up by host. The hosts' rates are shrunk
towards a beta prior that is fitted to all hosts by moments, rule by rule, so that a host with few
documents is not judged by them alone. A host is rejected, with all its documents, when a rate
stands out of the prior by two standard deviations and most of its documents are sure to fail.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from linkrank.llm import arrow
from linkrank.llm.registry import query
from linkrank.llm.stages import read, store

SYMBOLS = b"#*$%&|<>"
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@dataclass(frozen=True)
class Rules:
    """Limits of the rules; a document fails the base when any base rule fails.

    The other rules speak about hosts only: a single document may be a table or a poem.
    """

    min_words: int = 50
    max_repeat_percent: int = 50
    max_symbol_percent: int = 10  #: of words
    max_dup_line_percent: int = 5  #: of words
    min_word_chars: int = 2  #: on average
    max_word_chars: int = 30
    deviations: float = 2.0  #: a host's rate stands out so far from the prior's mean,
    min_host_rate: float = 0.5  #: and is above this by as many of its own


def _repeated_words(words: list[bytes]) -> int:
    """Words in windows of three words that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    names: dict[bytes, int] = {}
    ids = np.array([names.setdefault(w, len(names)) for w in words], np.int64)
    size = len(names)
    if size < 1 << 20:
        windows = (ids[:-2] * size + ids[1:-1]) * size + ids[2:]
    else:
        _, pairs = np.unique(ids[:-1] * size + ids[1:], return_inverse=True)
        windows = pairs[:-1] * size + ids[2:]
    _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
    again = counts[place] > 1
    covered = np.zeros(n, bool)
    covered[:-2] |= again
    covered[1:-1] |= again
    covered[2:] |= again
    return int(covered.sum())


def measure_text(raw: bytes) -> tuple[int, int, int, int, int]:
    """The measures of one UTF-8 text, in the order of ``MEASURES``."""
    words = raw.split()  # of bytes: at 0x20 and 0x09-0x0D only
    joined = b"".join(words)
    follow = joined.translate(None, _FIRST_BYTES)
    symbols = len(joined) - len(joined.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    again = 0
    for line in raw.split(b"\n"):
        if line in seen:
            again += 1
        elif line.strip():
            seen.add(line)
    return len(words), len(joined) - len(follow), symbols, again, _repeated_words(words)


#: All bytes but the second to last bytes of a code point.
_FIRST_BYTES = bytes(x for x in range(256) if x & 0xC0 != 0x80)


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, bounds = arrow.raw_bytes(batch.column(batch.num_columns - 1))
        raw = data.tobytes()
        rows = [measure_text(raw[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        found = np.array(rows, np.int64).reshape(-1, len(MEASURES))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(arrow.longs(found[:, i]) for i in range(len(MEASURES)))], ["row", *MEASURES]
        )


def base_failed(rules: Rules) -> Column:
    few = F.col("n_words") < rules.min_words
    return few | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))


def failures(rules: Rules) -> dict[str, Column]:
    """The rules that are added up by host; none fails a text without words but the first."""
    n = F.col("n_words")
    short, long = F.col("word_chars") < rules.min_word_chars * n, F.col("word_chars") > rules.max_word_chars * n
    return {
        "base": F.col("base_failed"),
        "symbols": 100 * F.col("n_symbols") > rules.max_symbol_percent * n,
        "lines": 100 * F.col("n_dup_lines") > rules.max_dup_line_percent * n,
        "words": short | long,
    }


def measure(docs: DataFrame, keep: list[str], text_col: str, host_col: str, rules: Rules) -> DataFrame:
    """One row per document: the kept columns in a struct ``row``, host, measures, base_failed."""
    held = F.struct(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("given"), F.col(host_col).cast("string").alias("host"))
    rows = docs.select(held.alias("row"), F.col(text_col).alias("text"))
    kind = rows.schema["row"].dataType.simpleString()
    schema = f"row {kind}, " + ", ".join(f"{x} bigint" for x in MEASURES)
    found = rows.mapInArrow(_measure, schema).withColumn("base_failed", base_failed(rules))
    return found.select(F.col("row.given").alias("row"), F.col("row.host").alias("host"), *MEASURES, "base_failed")


def host_verdicts(measured: DataFrame, rules: Rules) -> DataFrame:
    """One row per known host and rule: documents, failures, shrunken rate, the cut, host_rejected.

    A prior's mean and weight come from the mean and variance of the hosts' rates, less the
    variance that their numbers of documents bring. Where hosts differ by no more than that, none
    stands out and there is no cut.
    """
    hosts = measured.where(F.col("host").isNotNull()).groupBy("host")
    sums = {name: F.count_if(F.coalesce(test, F.lit(False))) for name, test in failures(rules).items()}
    hosts = hosts.agg(F.count("*").alias("n"), *(x.alias(name) for name, x in sums.items()))
    each = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(name).alias("failed")) for name in sums])
    hosts = store(hosts.select("host", "n", F.inline(each)))
    rate = F.col("failed") / F.col("n")
    priors = hosts.groupBy("rule").agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("var"), F.avg(1 / F.col("n")).alias("noise"))
    spread = F.col("mean") * (1 - F.col("mean"))
    priors = priors.withColumn("between", F.col("var") - spread * F.col("noise"))
    weight = F.when(F.col("between") > 0, F.greatest(F.lit(1.0), spread / F.col("between") - 1))
    priors = priors.withColumn("weight", weight).select(
        "rule", "mean", "weight", (F.col("mean") + rules.deviations * F.sqrt(spread / (F.col("weight") + 1))).alias("cut")
    )
    judged = hosts.join(F.broadcast(priors), "rule")  # one row per rule
    shrunk = (F.col("failed") + F.col("mean") * F.col("weight")) / (F.col("n") + F.col("weight"))
    rate = F.col("host_rate")
    unsure = rules.deviations * F.sqrt(rate * (1 - rate) / (F.col("n") + F.col("weight") + 1))
    rejected = (rate > F.col("cut")) & (rate - unsure > rules.min_host_rate)
    return judged.withColumn("host_rate", shrunk).select("host", "rule", "n", "failed", "host_rate", "cut", F.coalesce(rejected, F.lit(False)).alias("host_rejected"))


def judge(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Join host verdicts to measures. Only rejected hosts are joined; a hot host's rows
    stay where they are or are split by adaptive execution."""
    bad = verdicts.where("host_rejected").select(F.col("host").alias("bad_host")).distinct()
    found = measured.join(bad, F.col("host") == F.col("bad_host"), "left")
    return found.withColumn("kept", ~F.col("base_failed") & F.col("bad_host").isNull()).drop("bad_host")


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", rules: Rules | None = None) -> DataFrame:
    """One row per document: its id, the measures, base_failed and kept.

    A NULL or empty text has no words and fails the base. A NULL host is judged by its documents
    alone. Repeated rows are judged each and count each; an empty table gives no rows; other
    columns are ignored.
    """
    rules = rules or Rules()
    measured = store(measure(docs.select(F.col(id_col).alias("id"), text_col, host_col), ["id"], text_col, host_col, rules))
    return judge(measured, host_verdicts(measured, rules)).select(F.col("row.id").alias("doc_id"), *MEASURES, "base_failed", "kept")


def filter_documents(docs: DataFrame, text_col: str = "text", host_col: str = "source", rules: Rules | None = None) -> DataFrame:
    """Only the documents that pass, with all their columns; see ``score``."""
    rules = rules or Rules()
    measured = store(measure(docs.select(text_col, host_col), [host_col], text_col, host_col, rules))
    bad = host_verdicts(measured, rules)
    return judge(measure(docs, docs.columns, text_col, host_col, rules), bad).where("kept").select("row.*")


_SQL = r"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls
  FROM documents
), g AS (
  SELECT doc_id, i, [ws[i], ws[i + 1], ws[i + 2]] AS win
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, win) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id
), base AS (
  SELECT w.doc_id, w.source, CAST(len(ws) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id
), tested AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base
), hosts AS (
  SELECT source, count(*) AS n, unnest(['base', 'symbols', 'lines', 'words']) AS rule,
         unnest([count_if(base_failed), count_if(100 * n_symbols > 10 * n_words), count_if(100 * n_dup_lines > 5 * n_words),
                 count_if(word_chars < 2 * n_words OR word_chars > 30 * n_words)]) AS failed
  FROM tested WHERE source IS NOT NULL GROUP BY source
), m AS (
  SELECT rule, avg(failed / n) AS mean, avg(failed / n) * (1 - avg(failed / n)) AS spread,
         var_pop(failed / n) - avg(failed / n) * (1 - avg(failed / n)) * avg(1 / n) AS between_hosts
  FROM hosts GROUP BY rule
), prior AS (
  SELECT rule, mean, spread, greatest(1.0, spread / between_hosts - 1) AS weight FROM m WHERE between_hosts > 0
), bad AS (
  SELECT source, (failed + mean * weight) / (n + weight) AS rate FROM hosts JOIN prior USING (rule)
  WHERE rate > mean + 2 * sqrt(spread / (weight + 1)) AND rate - 2 * sqrt(rate * (1 - rate) / (n + weight + 1)) > 0.5
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM bad WHERE bad.source = tested.source) AS kept
FROM tested
"""


@query("op4_host_quality", _SQL)
def host_quality(spark: SparkSession, folder: str) -> DataFrame:
    return score(read(spark, folder, "documents"))
