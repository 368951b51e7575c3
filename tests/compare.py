"""Runs a query and its SQL on the same tables and compares the rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return ("n", value.normalize())
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return ("v", value)
    if isinstance(value, int):
        return ("n", decimal.Decimal(value).normalize())
    if isinstance(value, (datetime.datetime, datetime.date)):
        return ("t", value.isoformat())
    return ("v", value)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, sf_dir, query, sql, con=None) -> str | None:
    """None if both give the same columns and rows, else what differs."""
    got = query(spark, sf_dir)
    want = (con or connect(sf_dir)).execute(sql)
    want_names = [d[0] for d in want.description]
    if sorted(got.columns) != sorted(want_names):
        return f"columns {sorted(got.columns)} != {sorted(want_names)}"
    a, b = rows_of(got.columns, got.collect()), rows_of(want_names, want.fetchall())
    if a == b:
        return None
    first = next(((x, y) for x, y in zip(a, b) if x != y), None)
    return f"{len(a)} rows against {len(b)}; first difference {first}"
