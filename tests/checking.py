"""Run a registered query and its SQL on the same tables and compare whole results."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

KINDS = {
    "TINYINT": "int", "SMALLINT": "int", "INTEGER": "int", "int": "int", "BIGINT": "bigint",
    "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean", "DATE": "date",
}


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{Path(folder) / name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.12g}")
    return value


def compare(df, con, sql: str) -> list[str]:
    """Differences between the two results; an empty list means they are equal."""
    expected = con.execute(sql)
    want_types = {d[0]: KINDS.get(str(d[1]), str(d[1])) for d in expected.description}
    want_names = [d[0] for d in expected.description]
    want_rows = expected.fetchall()
    got_types = dict(df.dtypes)
    problems = []
    if got_types != want_types:
        problems.append(f"types: spark {got_types} sql {want_types}")
    names = sorted(got_types)
    if names != sorted(want_names):
        return problems
    order = [want_names.index(n) for n in names]
    got = Counter(tuple(cell(r[n]) for n in names) for r in df.collect())
    want = Counter(tuple(cell(r[i]) for i in order) for r in want_rows)
    if got != want:
        problems.append(f"rows: spark {got.total()} sql {want.total()}")
        problems.append(f"only spark: {list((got - want).items())[:3]}")
        problems.append(f"only sql: {list((want - got).items())[:3]}")
    if not want:
        problems.append("empty result")
    return problems
