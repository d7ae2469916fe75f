"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# At most so many hot keys are looked for; the partners of more are not broadcast.
MAX_HOT = 10_000
# Size of the frequent-items sketch relative to the number of hot keys; keeps its error far below a share.
SKETCH_FACTOR = 16
# First-level sketch groups, so that no single task merges one sketch per input split.
SKETCH_GROUPS = 64


def hot_shares(spark: SparkSession) -> int:
    """A key is hot when it has more than one of so many even shares of the rows."""
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), MAX_HOT)


def hot_hashes(df: DataFrame, keys: list[str]) -> list[int]:
    """Hashes of the key values with more rows than a shuffle partition should hold.

    That is a partition's even share of the rows, so there are fewer such keys than
    shuffle partitions. One pass over the key columns with a mergeable sketch; no key is
    shuffled and at most MAX_HOT numbers reach the driver. The sketch only steers the
    plan: a key it misses takes the shuffled path and the result is the same.
    """
    shares = hot_shares(df.sparkSession)
    size = shares * SKETCH_FACTOR
    found = (
        df.select(
            F.xxhash64(*keys).alias("h"),
            F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g"),
        )
        .groupBy("g")
        .agg(F.expr(f"approx_top_k_accumulate(h, {size})").alias("s"), F.count("*").alias("n"))
        .agg(F.expr(f"approx_top_k_combine(s, {size})").alias("s"), F.sum("n").alias("n"))
        .select(F.expr(f"approx_top_k_estimate(s, {shares})").alias("top"), "n")
        .select(F.inline("top"), "n")
        .where((F.col("count") > F.col("n") / shares) & (F.col("count") > 1))
        .select("item")
    )
    return [row["item"] for row in found.collect()]


def _common_types(left: DataFrame, right: DataFrame, on: list[str]) -> tuple[DataFrame, DataFrame]:
    """Both sides with their key columns in the type that holds the values of either."""
    types = dict(left.select(*on).limit(0).union(right.select(*on).limit(0)).dtypes)

    def cast(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(f"`{c}`").cast(types[c]).alias(c) if c in on else F.col(f"`{c}`") for c in df.columns])

    return cast(left), cast(right)


def one_row_per_key(df: DataFrame, keys: list[str], *aggregates: Column) -> DataFrame:
    """Collapse to one row per key; map-side aggregation takes the skew out."""
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates)


def lookup_join(
    left: DataFrame,
    right: DataFrame,
    on: list[str],
    how: str = "left",
    hot: list[int] | None = None,
) -> DataFrame:
    """Join many rows to a side with one row per key, safe against hot keys.

    Rows of hot keys meet their partners in a broadcast join and are never shuffled, if
    there are as few partners as one row per key makes; else they take a join of their
    own that Spark plans. All other rows take the ordinary shuffled join. Where nothing
    is hot the plan is the plain join. ``left`` is read once to look for hot keys and,
    where there are some, once per path: store it first when it is costly. ``hot`` hands
    over the hashes when the caller has them already.
    """
    left, right = _common_types(left, right, on)
    hot = hot_hashes(left, on) if hot is None else hot
    if not hot:
        return left.join(right, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    partners = right.where(is_hot)
    if how in ("left_semi", "left_anti"):
        partners = one_row_per_key(partners, on)
    few = partners.limit(MAX_HOT + 1).count() <= MAX_HOT
    warm = left.where(is_hot).join(F.broadcast(partners) if few else partners, on, how)
    cold = left.where(~is_hot).join(right.where(~is_hot), on, how)
    return cold.unionByName(warm)


def unmatched(left: DataFrame, right: DataFrame, keys: list[str], **options) -> DataFrame:
    """Rows of ``left`` with no partner; a NULL key never has one."""
    return lookup_join(left, one_row_per_key(right, keys), keys, "left_anti", **options)


def _pair_counts(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key on both sides: two aggregates, then a join of unique keys."""
    return one_row_per_key(left, keys, F.count("*").alias("n_left")).join(
        one_row_per_key(right, keys, F.count("*").alias("n_right")), keys, "left"
    )


def match_rate(left: DataFrame, right: DataFrame, keys: list[str], by: tuple[str, ...] = ()) -> DataFrame:
    """Total, matched and matched % of a LEFT JOIN, fan-out included.

    Counted from rows per key, so no pair is ever produced. ``by`` names keys to report
    separately.
    """
    pairs = F.col("n_left") * F.coalesce("n_right", F.lit(1))
    return (
        _pair_counts(left, right, keys)
        .groupBy(*by)
        .agg(
            F.coalesce(F.sum(pairs), F.lit(0)).alias("total"),
            F.coalesce(F.sum(F.when(F.col("n_right").isNotNull(), pairs)), F.lit(0)).alias(
                "matched"
            ),
        )
        .withColumn(
            "matched_pct",
            F.round(F.try_divide(F.col("matched") * F.lit(100.0), F.col("total")), 1),
        )
    )


def fanout_report(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Rows before and after a LEFT JOIN, and how many left keys meet several rows."""
    pairs = F.col("n_left") * F.coalesce("n_right", F.lit(1))
    return _pair_counts(left, right, keys).agg(
        F.sum("n_left").alias("rows_before"),
        F.sum(pairs).alias("rows_after"),
        F.count_if(F.col("n_right") > 1).alias("fanning_keys"),
    )


def fanning_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The keys that make a LEFT JOIN grow: rows of either side, and rows beyond those of the left."""
    return (
        _pair_counts(left, right, keys)
        .where(F.col("n_right") > 1)
        .select(*keys, "n_left", "n_right", (F.col("n_left") * (F.col("n_right") - 1)).alias("extra_rows"))
    )


def orphan_report(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    """Child rows and distinct child keys that point at no parent row."""
    return (
        one_row_per_key(child, keys, F.count("*").alias("n"))
        .join(one_row_per_key(parent, keys), keys, "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphan_rows"), F.count("*").alias("orphan_keys"))
    )


def reconcile(a: DataFrame, b: DataFrame, keys: list[str], value: str) -> DataFrame:
    """FULL OUTER comparison of two lists that hold one row per key."""
    a = a.select(*keys, F.col(value).alias("a_value"), F.lit(True).alias("in_a"))
    b = b.select(*keys, F.col(value).alias("b_value"), F.lit(True).alias("in_b"))
    side = (
        F.when(F.col("in_a") & F.col("in_b"), F.lit("both"))
        .when(F.col("in_a"), F.lit("A only"))
        .otherwise(F.lit("B only"))
    )
    return a.join(b, keys, "full").select(*keys, "a_value", "b_value", side.alias("side"))
