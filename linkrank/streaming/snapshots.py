"""Dated snapshots picked up as they land, with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from linkrank.sources.files import SNAPSHOT, csv_options, read_snapshots

RUN = "loaded_in_run"


def follow_snapshots(spark: SparkSession, root: str, schema: T.StructType, table: str, state: str) -> list[str]:
    """Bring ``table`` up to date with the dated folders under ``root``; returns the dates loaded.

    The file source remembers in ``state`` which files it has seen, so a run opens new files only,
    and a run that is broken off is taken up again. A date with new files is read as a whole and
    replaces that date's partition: a second delivery of a date is no second copy, and doing a
    step again changes nothing. Rows that break the contract are left out, as in
    ``read_snapshots``. The number of the run that loaded a date is kept in ``loaded_in_run``.
    """
    dated = T.StructType([*schema.fields, T.StructField(SNAPSHOT, T.DateType())])
    landed = csv_options(spark.readStream.schema(dated)).csv(root)
    loaded: list[str] = []

    def replace(batch: DataFrame, run: int) -> None:
        dates = sorted(str(r[SNAPSHOT]) for r in batch.select(SNAPSHOT).distinct().collect())  # one per folder
        if not dates:
            return
        rows = read_snapshots(batch.sparkSession, root, schema, dates=dates).good
        writer = rows.withColumn(RUN, F.lit(run).cast("long")).write.mode("overwrite")
        writer.option("partitionOverwriteMode", "dynamic").partitionBy(SNAPSHOT).parquet(table)
        loaded.extend(dates)

    query = landed.writeStream.foreachBatch(replace).option("checkpointLocation", state).trigger(availableNow=True).start()
    query.awaitTermination()
    return loaded


def snapshot_table(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """The table that ``follow_snapshots`` keeps."""
    kept = T.StructType([*schema.fields, T.StructField(RUN, T.LongType()), T.StructField(SNAPSHOT, T.DateType())])
    return spark.read.schema(kept).parquet(table)
