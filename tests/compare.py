"""Runs registered queries and their SQL on the same tables and compares the rows."""

from __future__ import annotations

import decimal
import glob
import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for table in TABLES:
        path = f"{folder}/{table}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else glob.escape(path) + '/*.parquet'}')")
    return con


def plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9) + 0.0
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def difference(name: str, query, sql: str, spark, con, folder: str) -> str | None:
    """None if the rows are the same, else what differs."""
    df = query(spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    answer = con.execute(sql)
    columns = [d[0] for d in answer.description]
    want = rows_of(columns, answer.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"{name}: columns {sorted(df.columns)} and {sorted(columns)}"
    if len(got) != len(want):
        return f"{name}: {len(got)} rows and {len(want)}"
    wrong = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    return f"{name}: {len(wrong)} of {len(got)} rows differ, such as {wrong[0]} (columns {sorted(columns)})" if wrong else None
