"""Run a registered query in Spark and its SQL twin in DuckDB and compare the rows."""

from __future__ import annotations

import datetime as dt
import math
from pathlib import Path

import duckdb


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (dt.datetime,)):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, fn, sql: str) -> str:
    """'' if equal, else what differs."""
    con = duckdb.connect()
    con.execute("set timezone='UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    df = fn(spark, sf_dir)
    mine = rows_of(df.columns, df.collect())
    cur = con.execute(sql)
    cols = [c[0] for c in cur.description]
    theirs = rows_of(cols, cur.fetchall())
    if sorted(df.columns) != sorted(cols):
        return f"columns {sorted(df.columns)} and {sorted(cols)}"
    if mine == theirs:
        return ""
    bad = next(((a, b) for a, b in zip(mine, theirs) if a != b), None)
    return f"{len(mine)} and {len(theirs)} rows; first: {str(bad)[:700]}"
