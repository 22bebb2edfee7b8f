"""Run registered queries against DuckDB and report differences."""

from __future__ import annotations

import glob
import math
import os
from datetime import datetime

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _value(v):
    if isinstance(v, float) and math.isnan(v):
        return "NaN"
    if isinstance(v, datetime):
        return v.isoformat()
    return v


def _sorted(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(_value(r[i]) for i in order) for r in rows), key=repr)


def spark_result(df) -> tuple[list[str], list[tuple]]:
    return sorted(df.columns), _sorted(df.columns, [tuple(r) for r in df.collect()])


def duck_result(con, sql: str) -> tuple[list[str], list[tuple]]:
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    return sorted(columns), _sorted(columns, cur.fetchall())


def difference(df, con, sql: str) -> str | None:
    """None when columns, row count, value types and values agree exactly."""
    ours, theirs = spark_result(df), duck_result(con, sql)
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} != {theirs[0]}"
    if len(ours[1]) != len(theirs[1]):
        return f"{len(ours[1])} rows != {len(theirs[1])}"
    for a, b in zip(ours[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            cells = zip(ours[0], a, b)
            wrong = [c for c in cells if c[1] != c[2] or type(c[1]) is not type(c[2])]
            return f"row differs: {wrong[:4]}"
    return None
