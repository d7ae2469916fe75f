"""Session settings and the shared folder that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: str = "8", partitions: int = 8, memory: str = "12g") -> SparkSession:
    """Single-machine session for tests and the benchmark."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("linkrank")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, named by ``spark.checkpoint.dir``.

    Only a local master may fall back to a temporary folder: on a cluster such
    a folder would be lost together with the machine that holds it.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    return _local_dir(spark.sparkContext.applicationId)


@cache
def _local_dir(application: str) -> str:
    return tempfile.mkdtemp(prefix="linkrank-")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, under one folder per application.

    Nothing is deleted here: drop the application's folder when its results are no
    longer read.
    """
    home = f"{shared_dir(spark).rstrip('/')}/linkrank/{spark.sparkContext.applicationId}"
    return f"{home}/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as Parquet, replacing what was there, and read it back."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df``: a table in the shared folder that later steps read.

    A table rather than a row checkpoint, so that readers get only the columns they
    need and Spark knows its size when it picks a join.
    """
    return write_table(df, scratch_path(df.sparkSession, "stage"))
