"""Queries of this subpackage, by name; `catalog` imports the modules that define them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from linkrank.llm.stages import ship_code

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def with_code(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        ship_code(spark)
        return build(spark, folder)

    return run


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(build: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"{name} registered twice")
        QUERIES[name] = with_code(build)
        if sql is not None:
            SQL[name] = sql
        return build

    return add
