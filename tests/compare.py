"""Compares a query's rows with its SQL on the same parquet files, as multisets over columns sorted by name."""

from __future__ import annotations

import math
from collections import Counter
from pathlib import Path

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for f in sorted(Path(folder).glob("*.parquet")):
        con.execute(f"create view {f.stem} as select * from read_parquet('{f}')")
    return con


def _cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else repr(x + 0.0)
    return x


def differences(df, con, sql: str) -> list[str]:
    """Empty where both sides agree in columns and rows."""
    found = con.execute(sql)
    columns = sorted(d[0] for d in found.description)
    if sorted(df.columns) != columns:
        return [f"columns: {sorted(df.columns)} vs {columns}"]
    place = {d[0]: i for i, d in enumerate(found.description)}
    expected = Counter(tuple(_cell(row[place[c]]) for c in columns) for row in found.fetchall())
    actual = Counter(tuple(_cell(row[c]) for c in columns) for row in df.collect())
    missing, extra = expected - actual, actual - expected
    if not missing and not extra:
        return []
    key = lambda c: sorted(c.items(), key=str)[:3]
    return [f"{sum(expected.values())} vs {sum(actual.values())} rows", f"only SQL {key(missing)}", f"only Spark {key(extra)}"]
