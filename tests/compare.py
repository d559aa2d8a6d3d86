"""Run a registered query and its SQL twin over the same tables and compare them."""

from __future__ import annotations

import datetime as dt
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _plain(value):
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, (dt.date, dt.datetime)):
        return value.isoformat()
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return sorted(plain, key=repr)


def difference(df, con, sql: str) -> str | None:
    """None when both sides hold the same rows, else a short description."""
    expected = con.execute(sql)
    columns = [d[0] for d in expected.description]
    want = _sorted_rows(columns, expected.fetchall())
    if sorted(df.columns) != sorted(columns):
        return f"columns {sorted(set(df.columns) ^ set(columns))}"
    have = _sorted_rows(df.columns, df.collect())
    if len(have) != len(want):
        return f"{len(have)} rows, expected {len(want)}"
    wrong = [(h, w) for h, w in zip(have, want) if repr(h) != repr(w)]
    if wrong:
        h, w = wrong[0]
        cells = [(c, x, y) for c, x, y in zip(sorted(columns), h, w) if repr(x) != repr(y)]
        return f"{len(wrong)} of {len(have)} rows differ, first in {cells[:4]}"
    return None
