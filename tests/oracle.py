"""Comparing a Spark query with its SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    """The tables of a folder as views."""
    con = duckdb.connect()
    for p in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def plain(value):
    """Numbers without a trace of their type, lists as tuples."""
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        return round(float(value), 6) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in sorted(value.items()))
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return value


def rows_of_spark(df) -> tuple[list[str], list]:
    columns = sorted(df.columns)
    return columns, sorted((tuple(plain(v) for v in r) for r in df.select(*columns).collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list]:
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=repr)
