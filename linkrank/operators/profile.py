"""Data-quality checks: a profile of any table and the six standard dimensions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkrank.functions.text import MISSING_MARKERS, has_nondigit


def profile_table(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row per column: rows, nulls, blanks, distinct values, min, max, non-digit values.

    Distinct values are counted by 128-bit hashes, deduplicated in two phases, so long
    texts are not shuffled and no distinct set is built in one task. All else is one pass.
    """
    columns = columns or df.columns
    texts = {c: F.col(f"`{c}`").cast("string") for c in columns}
    hashes = F.array(
        *[
            F.struct(
                F.lit(c).alias("column_name"),
                F.when(v.isNotNull(), F.xxhash64(v)).alias("h1"),
                F.xxhash64(F.lit(1), v).alias("h2"),
            )
            for c, v in texts.items()
        ]
    )
    distinct = (
        df.select(F.inline(hashes))
        .groupBy("column_name", "h1", "h2")
        .agg(F.lit(1))
        .groupBy("column_name")
        .agg(F.count("h1").alias("distinct_count"))
    )
    rest = _one_pass(df, columns, {k: v for k, v in _MEASURES.items() if k != "distinct_count"})
    return rest.join(distinct, "column_name", "left").select(
        "column_name",
        "row_count",
        "null_count",
        "blank_count",
        F.coalesce("distinct_count", F.lit(0)).alias("distinct_count"),
        "min_value",
        "max_value",
        "nondigit_count",
    )


_MEASURES = {
    "row_count": lambda v: F.count("*"),
    "null_count": lambda v: F.count_if(v.isNull()),
    "blank_count": lambda v: F.count_if(v == ""),
    "distinct_count": lambda v: F.approx_count_distinct(v),
    "min_value": F.min,
    "max_value": F.max,
    "nondigit_count": lambda v: F.count_if(has_nondigit(v)),
}


def _one_pass(df: DataFrame, columns: list[str], measures: dict) -> DataFrame:
    wide = df.agg(
        *[
            F.struct(*[m(F.col(f"`{c}`").cast("string")).alias(k) for k, m in measures.items()]).alias(c)
            for c in columns
        ]
    )
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("m")) for c in columns])
    return wide.select(F.inline(cells)).select("column_name", "m.*")


def profile_table_approx(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """As :func:`profile_table` in one pass without a shuffle of values; distinct is a sketch."""
    return _one_pass(df, columns or df.columns, _MEASURES)


#: Buckets of a stored sketch, as a power of two: a relative error of 1.04 / sqrt(2 ** 14), 0.8 percent.
SKETCH_SIZE = 14


def profile_sketches(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """A profile that can be merged: one row per column with counts, least and greatest value and a
    sketch of the distinct ones. One pass; store it with the snapshot it describes."""
    measures = {k: v for k, v in _MEASURES.items() if k != "distinct_count"}
    measures["distinct_sketch"] = lambda v: F.hll_sketch_agg(F.concat(F.lit("="), v), F.lit(SKETCH_SIZE))  # the sketch skips empty text
    return _one_pass(df, columns or df.columns, measures)


def merged_profile(stored: DataFrame) -> DataFrame:
    """The profile of all snapshots together from their stored ones; no snapshot is read again.

    Counts, least and greatest values are exact. Distinct values are estimated: a value that is in
    several snapshots counts once, with a relative error of 0.8 percent on average.
    """
    sums = [F.sum(c).alias(c) for c in ("row_count", "null_count", "blank_count", "nondigit_count")]
    distinct = F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("distinct_count")
    ends = [F.min("min_value").alias("min_value"), F.max("max_value").alias("max_value")]
    return stored.groupBy("column_name").agg(*sums, distinct, *ends)


def count_blank(df: DataFrame, columns: list[str]) -> DataFrame:
    test = reduce(lambda a, b: a | b, [F.col(c) == "" for c in columns])
    return df.where(test).agg(F.count("*").alias("blank_rows"))


def distinct_nondigit(df: DataFrame, columns: list[str]) -> DataFrame:
    test = reduce(lambda a, b: a | b, [has_nondigit(F.col(c)) for c in columns])
    return df.where(test).select(*columns).distinct()


def oddity_counts(df: DataFrame, tests: dict[str, Column]) -> DataFrame:
    """Rows in total and rows meeting each test, one scan."""
    return df.agg(
        F.count("*").alias("total_rows"), *[F.count_if(t).alias(n) for n, t in tests.items()]
    )


def missing_markers(df: DataFrame, columns: list[str], markers=MISSING_MARKERS) -> DataFrame:
    """Rows per column and missing marker."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("marker")) for c in columns]
    )
    return (
        df.select(F.inline(cells))
        .where(F.col("marker").isin(*markers))
        .groupBy("column_name", "marker")
        .agg(F.count("*").alias("marked_rows"))
    )


def roundtrip_cast_check(df: DataFrame, col: str) -> DataFrame:
    """Values that text -> integer -> text does not give back, with how they fail."""
    as_int = F.col(col).try_cast("int")
    kind = F.when(as_int.isNull(), F.lit("not a number")).otherwise(F.lit("rewritten"))
    return (
        df.where(F.col(col).isNotNull() & (as_int.isNull() | (as_int.cast("string") != F.col(col))))
        .groupBy(F.col(col), kind.alias("problem"))
        .agg(F.count("*").alias("rows_with_value"))
    )


def legal_range(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Rows of each column outside its legal range."""
    return df.agg(
        F.count("*").alias("total_rows"),
        *[
            F.count_if(~F.col(c).between(F.lit(lo), F.lit(hi))).alias(f"{c}_outside")
            for c, (lo, hi) in ranges.items()
        ],
    )


def six_dimensions(
    df: DataFrame,
    *,
    expected_rows: int | Column,
    blank: Column,
    invalid: Column,
    inconsistent: Column,
    identity: list[str],
    inaccurate: Column,
    date_col: str,
    stale_before: str | Column,
) -> DataFrame:
    """One row per quality dimension: what was checked, failing rows, verdict.

    Duplicates are counted from rows per identity, so the pass is one two-phase
    aggregate whatever the skew.
    """
    per_row = df.groupBy(*identity).agg(
        F.count("*").alias("n"),
        F.count_if(blank).alias("blank"),
        F.count_if(invalid).alias("invalid"),
        F.count_if(inconsistent).alias("inconsistent"),
        F.count_if(inaccurate).alias("inaccurate"),
        F.max(date_col).alias("latest"),
    )
    totals = per_row.agg(
        F.sum("n").alias("n"),
        F.sum("blank").alias("blank"),
        F.sum("invalid").alias("invalid"),
        F.sum("inconsistent").alias("inconsistent"),
        F.sum(F.col("n") - 1).alias("duplicate"),
        F.sum("inaccurate").alias("inaccurate"),
        F.max("latest").alias("latest"),
    )
    expected = expected_rows if isinstance(expected_rows, Column) else F.lit(expected_rows)
    rows = [
        ("completeness", F.col("blank") + F.abs(F.col("n") - expected)),
        ("validity", F.col("invalid")),
        ("consistency", F.col("inconsistent")),
        ("uniqueness", F.col("duplicate")),
        ("accuracy", F.col("inaccurate")),
        ("timeliness", F.when(F.col("latest") < stale_before, 1).otherwise(0)),
    ]
    cells = F.array(
        *[
            F.struct(F.lit(n).alias("dimension"), v.cast("long").alias("failures"))
            for n, v in rows
        ]
    )
    return totals.select(F.inline(cells)).withColumn("passed", F.col("failures") == 0)


def ledger(stages: dict[str, DataFrame]) -> DataFrame:
    """Named row counts of the stages of a build, in order."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(i).alias("step"), F.lit(name).alias("stage"), "row_count"
        )
        for i, (name, df) in enumerate(stages.items(), start=1)
    ]
    return reduce(DataFrame.unionByName, counts)
