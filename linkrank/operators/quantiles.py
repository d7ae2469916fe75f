"""Exact percentiles by group, for cutoffs that come from measured distributions.

A mergeable KLL sketch per group picks a bracket of values around each wanted rank; a second pass
counts the values below the bracket and inside it exactly. So no group's values are sorted or
gathered as a whole. A bracket that still holds too many values is halved, at a middle that a sketch of its own tells.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linkrank.operators.joins import lookup_join
from linkrank.runtime import materialize

SKETCH_K = 800  #: rank error of about 0.4 percent
MARGIN = 0.02  #: of the ranks on either side of a bracket
MOST_INSIDE = 1_000_000  #: distinct values of a bracket that one task may sort
_ROUNDS = 60


def exact_quantiles(
    df: DataFrame, group: list[str], col: str, shares: list[float], k: int = SKETCH_K, margin: float = MARGIN, most_inside: int = MOST_INSIDE
) -> DataFrame:
    """One row per group and share: the group columns, share, rows (of the group), value.

    The value is the smallest one that at least that share of the group's rows do not exceed
    (``PERCENTILE_DISC``). ``col`` holds whole numbers; NULLs do not count, a group without
    values has no rows.
    """
    rows = materialize(df.select(F.struct(*group).alias("g"), F.col(col).cast("long").alias("v")).where("v is not null"))
    if rows.isEmpty():  # the sketch function of this Spark does not take an empty input
        kind = rows.schema["g"].dataType.simpleString()
        none = df.sparkSession.createDataFrame([], f"g {kind}, share double, rows bigint, value bigint")
        return none.select("g.*", "share", "rows", "value")
    first = rows.groupBy("g").agg(
        F.kll_sketch_agg_bigint("v", k).alias("s"), F.count("*").alias("n"), F.min("v").alias("least"), F.max("v").alias("most")
    )
    first = materialize(first)
    brackets = F.explode(F.array(*[_bracket(float(x), margin) for x in shares])).alias("b")
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("share") * F.col("n"), 6))).cast("long")
    wanted = first.select("g", "n", brackets).select("g", "n", "b.*").withColumn("rank", rank)
    wanted = materialize(wanted.select("g", "share", "n", "rank", "low", "high"))
    for _ in range(_ROUNDS):
        inside = _inside(rows, wanted)
        counted = inside.groupBy("g", "share").agg(
            F.sum(F.when(F.col("where") == 0, F.col("c"))).alias("below"),
            F.sum(F.when(F.col("where") == 1, F.col("c"))).alias("held"),
            F.count_if(F.col("where") == 1).alias("values"),
        )
        wanted = wanted.drop("below", "held", "values").join(counted, ["g", "share"])
        wanted = materialize(wanted.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("below", "held", "values")}))
        hit = F.col("rank").between(F.col("below") + 1, F.col("below") + F.col("held"))
        missed = wanted.where(~hit)
        large = wanted.where(hit & (F.col("values") > most_inside))
        if missed.isEmpty() and large.isEmpty():
            break
        # A missed bracket grows to all values of its side; a large one is narrowed.
        bounds = first.select("g", "least", "most")
        grown = missed.join(bounds, "g").withColumns(
            {
                "low": F.when(F.col("rank") <= F.col("below"), F.col("least")).otherwise(F.col("high")),
                "high": F.when(F.col("rank") <= F.col("below"), F.col("low")).otherwise(F.col("most")),
            }
        )
        parts = inside.where("where = 1").join(large.select("g", "share"), ["g", "share"], "left_semi")
        middles = parts.groupBy("g", "share").agg(F.kll_sketch_agg_bigint("v", k).alias("s"))
        middles = middles.select("g", "share", F.kll_sketch_get_quantile_bigint("s", F.lit(0.5)).alias("middle"))
        halves = _chosen_half(rows, large.join(middles, ["g", "share"]))
        done = wanted.where(hit & (F.col("values") <= most_inside))
        names = ["g", "share", "n", "rank", "low", "high"]
        wanted = materialize(done.select(*names).unionByName(grown.select(*names)).unionByName(halves.select(*names)))
    inside = _inside(rows, wanted.select("g", "share", "n", "rank", "low", "high"))
    upto = Window.partitionBy("g", "share").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = inside.where("where = 1").withColumn("upto", F.sum("c").over(upto))
    placed = placed.join(wanted.select("g", "share", "n", "rank", "below"), ["g", "share"]).where(F.col("below") + F.col("upto") >= F.col("rank"))
    found = placed.groupBy("g", "share").agg(F.min("v").alias("value"), F.first("n").alias("rows"))
    return found.select("g.*", "share", "rows", "value")


def _bracket(share: float, margin: float) -> Column:
    low = F.col("least") if share <= margin else F.kll_sketch_get_quantile_bigint("s", F.lit(share - margin))
    high = F.col("most") if share >= 1 - margin else F.kll_sketch_get_quantile_bigint("s", F.lit(share + margin))
    return F.struct(F.lit(share).alias("share"), low.alias("low"), high.alias("high"))


def _inside(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """g, share, where (0 below the bracket, 1 inside), v (inside only), c: counts, map side first."""
    brackets = wanted.groupBy("g").agg(F.collect_list(F.struct("share", "low", "high")).alias("b"))
    met = lookup_join(rows, brackets, ["g"], "inner")
    met = met.select("g", "v", F.inline("b")).where("v <= high")
    place = F.when(F.col("v") < F.col("low"), 0).otherwise(1)
    value = F.when(F.col("v") >= F.col("low"), F.col("v"))
    return met.select("g", "share", place.alias("where"), value.alias("v")).groupBy("g", "share", "where", "v").agg(F.count("*").alias("c"))


def _chosen_half(rows: DataFrame, halves: DataFrame) -> DataFrame:
    """The half of a large bracket that holds the wanted rank."""
    upto = rows.join(halves.select("g", "share", "middle"), "g").where("v <= middle").groupBy("g", "share").agg(F.count("*").alias("upto"))
    halves = halves.join(upto, ["g", "share"], "left")
    lower = F.col("rank") <= F.coalesce("upto", F.lit(0))
    return halves.withColumns({"low": F.when(lower, F.col("low")).otherwise(F.col("middle")), "high": F.when(lower, F.col("middle")).otherwise(F.col("high"))})
