"""Compare a registered query with its SQL in DuckDB: names, row count and values, any order."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _cell(value):
    if value is None:
        return (0, "", 0)
    if isinstance(value, bool):
        return (1, float(value), 1)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        number = float(value)
        return (2, "nan", 0) if math.isnan(number) else (1, number, math.copysign(1, number))
    return (3, str(value), 0)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def differences(df, con, sql: str, limit: int = 5) -> list[str]:
    """Empty when both sides agree exactly."""
    found = con.execute(sql)
    want_names, want = rows_of([d[0] for d in found.description], found.fetchall())
    got_names, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if want_names != got_names:
        return [f"columns {got_names} instead of {want_names}"]
    if len(want) != len(got):
        return [f"{len(got)} rows instead of {len(want)}"]
    return [f"{g} instead of {w}" for g, w in zip(got, want) if g != w][:limit]
