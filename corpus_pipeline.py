"""From raw documents to packed training sequences, stage by stage.

Each stage works on all rows that the one before kept and passes on the columns of ``documents``;
the last one returns the pieces of the packed sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkrank.llm import leaks, neardup, packing, private, quality
from linkrank.llm.stages import read, ship_code, store


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules, or whose host does, go."""
    ship_code(spark)
    return quality.filter_documents(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, the one with the smallest id: five-word
    shingles, similarity 0.8."""
    ship_code(spark)
    return neardup.drop_near_duplicates(docs, size=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go."""
    ship_code(spark)
    return leaks.drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts give way to their kinds in brackets; n_chars follows."""
    ship_code(spark)
    return private.redact(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 1024 ids."""
    ship_code(spark)
    return packing.pack(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("near duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal data", personal_data),
    ("packing", packed),
]

#: MinHash components and token ids are beyond SQL; tests/llm checks run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on the whole ``documents`` table: the pieces of the packed sequences.

    A NULL or empty text fails the quality rules. A row with a NULL id is judged by its text like
    any other and is nobody's near duplicate; its pieces have a NULL doc_id. Of rows with one id
    and one text one stays, unlike texts of one id all do. An empty table gives no rows, an empty
    benchmark drops none. Further columns go with their rows until packing.
    """
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
