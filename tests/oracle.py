"""Compare a query with its SQL equivalent the way the driver does: columns by name, rows in any order."""

from __future__ import annotations

import decimal
import math
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{sf_dir}/{table}.parquet')")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    return value


def rows_of(columns: list[str], rows) -> tuple[list[str], Counter]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def spark_rows(frame):
    return rows_of(frame.columns, frame.collect())


def duck_rows(con, statement: str):
    result = con.execute(statement)
    return rows_of([d[0] for d in result.description], result.fetchall())


def difference(con, statement: str, frame) -> str | None:
    """None if equal, else a short description."""
    columns, mine = spark_rows(frame)
    expected_columns, expected = duck_rows(con, statement)
    if columns != expected_columns:
        return f"columns {columns} instead of {expected_columns}"
    if mine != expected:
        extra, missing = mine - expected, expected - mine
        return (
            f"{sum(mine.values())} rows instead of {sum(expected.values())}; "
            f"extra {list(extra)[:3]}; missing {list(missing)[:3]}"
        )
    return None
