"""Steps that several operators share."""

from __future__ import annotations

import gc
import tempfile
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import linkrank
from linkrank.runtime import materialize

#: Stands for a NULL id while rows are worked on; it sorts first, as NULL does.
NO_ID = -(1 << 63)


def read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


def store(df: DataFrame) -> DataFrame:
    """A table in the cluster's shared folder that later steps read; it survives lost executors."""
    return materialize(df)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps whose DataFrames are gone."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def known_id(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(column.cast("long"), F.lit(NO_ID))


def given_id(column: str | Column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.when(column != NO_ID, column)


def whole_text(column: str | Column) -> Column:
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


@cache
def _archive() -> str:
    home = Path(linkrank.__file__).parent
    path = f"{tempfile.mkdtemp(prefix='linkrank-code-')}/linkrank.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(home.rglob("*.py")):
            out.write(file, file.relative_to(home.parent))
    return path


@cache
def _shipped(application: str) -> set[str]:
    return set()


def ship_code(spark: SparkSession) -> None:
    """Send this package to the Python workers, which may not have it installed."""
    done = _shipped(spark.sparkContext.applicationId)
    if not done:
        spark.sparkContext.addPyFile(_archive())
        done.add(_archive())
