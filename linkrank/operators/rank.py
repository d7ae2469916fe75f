"""Percentile scores and best-N-per-group picks."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from linkrank.runtime import materialize


#: Facts about a group's slot that are broadcast, at most.
MOST_SLOTS = 100_000


def _slotted(df: DataFrame, order: list) -> DataFrame:
    """``df`` range-partitioned and sorted by ``order``, with each row's slot and place in it.

    Stored, so that a lost executor cannot move a row to another slot.
    """
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__id", F.monotonically_increasing_id())
    slot, place = F.shiftright("__id", 33).cast("int"), F.col("__id").bitwiseAND((1 << 33) - 1)
    return materialize(placed.withColumns({"__slot": slot, "__place": place}).drop("__id"))


def _at_slot(df: DataFrame, slots: DataFrame, parts: list[str]) -> DataFrame:
    """Join facts about a group's slot, one row each, to the rows there; NULL is a group too."""
    names = {c: f"__of_{c}" for c in [*parts, "__slot"]}
    slots = slots.withColumnsRenamed(names)
    same = reduce(and_, [F.col(f"`{c}`").eqNullSafe(F.col(f"`{n}`")) for c, n in names.items()])
    return df.join(slots, same).drop(*names.values())


def _starts(sizes: DataFrame, parts: list[str], size: str) -> DataFrame:
    """Rows before each slot and rows in all, per group: one row per group and slot."""
    lower_slots = W.partitionBy(*parts).orderBy("__slot").rowsBetween(W.unboundedPreceding, -1)
    return sizes.withColumns(
        {
            "__start": F.coalesce(F.sum(size).over(lower_slots), F.lit(0)),
            "__total": F.sum(size).over(W.partitionBy(*parts)),
        }
    )


def percent_rank_at_scale(
    df: DataFrame, col: str, out: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """``PERCENT_RANK() OVER ([PARTITION BY ...] ORDER BY col)`` without a one-task sort.

    Rows are range-partitioned into slots by group, value and a hash of the row, so a value
    with many rows spans slots. Rows below a value = rows in lower slots + rows below it in its
    own slot. For a slot's first value, rows of that value in lower slots are taken off again;
    they are known from one row per slot. NULLs rank first; NULL is a group like any other.

    Rows are stored once, with their slot and the rank in it: sizes and result read that.
    """
    parts = list(partition_by)
    spread = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    slotted = df.repartitionByRange(*parts, F.col(col).asc_nulls_first(), spread).withColumn("__slot", F.spark_partition_id())
    inside = F.rank().over(W.partitionBy(*parts, "__slot").orderBy(F.col(col).asc_nulls_first()))
    ranked = materialize(slotted.withColumn("__inside", inside))
    value = F.struct(F.col(col).alias("v"))  # a struct, so that NULL is a value too
    sizes = ranked.groupBy(*parts, "__slot").agg(
        F.count("*").alias("__size"),
        F.min(value).alias("__low"),
        F.max(value).alias("__high"),
        F.max("__inside").alias("__last"),
    )
    slots = _starts(materialize(sizes), parts, "__size")
    ends = slots.select(
        *parts, "__slot", F.col("__high").alias("__v"), (F.col("__size") - F.col("__last") + 1).alias("__n"), F.lit(1).alias("__end")
    )
    heads = slots.select(*parts, "__slot", F.col("__low").alias("__v"), F.lit(0).cast("long").alias("__n"), F.lit(0).alias("__end"))
    before = W.partitionBy(*parts, "__v").orderBy("__slot", "__end").rowsBetween(W.unboundedPreceding, -1)
    tied = ends.unionByName(heads).withColumn("__tied", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    tied = tied.where("__end = 0").select(*parts, "__slot", "__tied")
    slots = _at_slot(slots.select(*parts, "__slot", "__start", "__total"), tied, parts)
    below = F.col("__start") + F.col("__inside") - 1 - F.when(F.col("__inside") == 1, F.col("__tied")).otherwise(0)
    rank = F.when(F.col("__total") > 1, below / (F.col("__total") - 1)).otherwise(F.lit(0.0))
    return _at_slot(ranked, slots, parts).select(*[F.col(f"`{c}`") for c in df.columns], rank.alias(out))


def weighted_score(weights: dict[str, float]) -> Column:
    """Weighted sum of percent ranks as a 0-100 score with one decimal."""
    total = None
    for name, weight in weights.items():
        term = F.lit(weight) * F.col(name)
        total = term if total is None else total + term
    return F.round(total * 100, 1)


def composite_score(
    df: DataFrame, weights: dict[str, float], out: str, partition_by: tuple[str, ...] = ()
) -> DataFrame:
    """Composite percentile score over a table of any size."""
    names = {col: f"__pr{i}" for i, col in enumerate(weights)}
    ranked = df
    for col, name in names.items():
        ranked = percent_rank_at_scale(ranked, col, name, partition_by)
    score = weighted_score({names[col]: w for col, w in weights.items()})
    return ranked.select(*df.columns, score.alias(out))


def top_n_per_group(
    df: DataFrame, group: list[str], order: list[Column], n: int, rank: str | None = None
) -> DataFrame:
    """Best n rows of each group; ``order`` must be total. ``rank`` keeps the row number.

    Spark cuts every task's rows to n per group before the shuffle, so a hot group
    arrives as n rows per task, as long as n is within its own limit for that. Longer
    lists are numbered slot by slot instead.
    """
    name = rank or "__rank"
    limit = int(df.sparkSession.conf.get("spark.sql.optimizer.windowGroupLimitThreshold", "1000"))
    if n <= limit:
        number = F.row_number().over(W.partitionBy(*group).orderBy(*order))
        kept = df.withColumn(name, number).where(F.col(name) <= n)
    else:
        kept = numbered(df, group, order, name, n)
    return kept if rank else kept.drop(name)


def numbered(df: DataFrame, group: list[str], order: list[Column], name: str, n: int | None = None) -> DataFrame:
    """``ROW_NUMBER()`` per group without a task that holds a group; at most ``n`` rows of each.

    Row number = rows of the group in lower slots + row number in the own slot, which follows from
    the row's place there and that of the group's first row. So rows are shuffled and sorted once;
    afterwards they only meet one row per group and slot. Slots that start beyond n are dropped.
    """
    slotted = _slotted(df, [*group, *order])
    sizes = slotted.groupBy(*group, "__slot").agg(F.count("*").alias("__size"), F.min("__place").alias("__low"))
    starts = _starts(sizes, group, "__size").select(*group, "__slot", "__start", "__low")
    if n is not None:
        starts = starts.where(F.col("__start") < n)
    starts = materialize(starts)
    few = starts.limit(MOST_SLOTS + 1).count() <= MOST_SLOTS
    number = F.col("__start") + F.col("__place") - F.col("__low") + 1
    found = _at_slot(slotted, F.broadcast(starts) if few else starts, group).withColumn(name, number.cast("int"))
    if n is not None:
        found = found.where(F.col(name) <= n)
    return found.select(*df.columns, name)


def top_k(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)
