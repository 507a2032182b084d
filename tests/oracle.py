"""Compare a Spark result with the checking engine, order-insensitively."""

from __future__ import annotations

import datetime
import decimal
import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str):
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.execute(f"create view {file.stem} as select * from read_parquet('{file}')")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 9)
    if isinstance(value, decimal.Decimal):
        return value.normalize() + 0
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat(timespec="microseconds")
    return value


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(plain(row[i]) for i in order) for row in rows)


def compare(df, con, sql: str) -> str | None:
    """None when equal, else what differs."""
    cursor = con.execute(sql)
    columns = [d[0] for d in cursor.description]
    if sorted(columns) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(columns)}"
    expected = rows_of(columns, cursor.fetchall())
    found = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if expected == found:
        return None if expected else "both empty"
    extra, missing = found - expected, expected - found
    return (
        f"{sum(found.values())} rows vs {sum(expected.values())}; {sorted(df.columns)} "
        f"only spark {list(extra)[:2]} only sql {list(missing)[:2]}"
    )
