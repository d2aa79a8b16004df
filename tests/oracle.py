"""Runs queries in Spark and their SQL in DuckDB over the same tables and compares the rows."""

from __future__ import annotations

import math
from decimal import Decimal
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def cell(x):
    if x is None or (isinstance(x, float) and math.isnan(x)):
        return None
    if isinstance(x, Decimal):
        return float(x)
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def order(row):
    return tuple((x is not None, str(type(x).__name__ if not isinstance(x, (int, float)) else "n"), f"{x:.4f}" if isinstance(x, float) else f"{x:.4f}" if isinstance(x, int) and not isinstance(x, bool) else str(x)) for x in row)


def compare(df, con, statement: str, digits: float = 2e-6) -> str:
    """Empty if all rows agree, else what differs."""
    names = sorted(df.columns)
    found = con.execute(statement)
    other = [d[0] for d in found.description]
    if sorted(other) != names:
        return f"columns {names} and {sorted(other)}"
    at = [other.index(n) for n in names]
    theirs = sorted((tuple(cell(r[i]) for i in at) for r in found.fetchall()), key=order)
    mine = sorted((tuple(cell(r[n]) for n in names) for r in df.collect()), key=order)
    if len(mine) != len(theirs):
        return f"{len(mine)} rows, not {len(theirs)}"
    bad = 0
    first = ""
    for a, b in zip(mine, theirs, strict=True):
        for x, y, n in zip(a, b, names, strict=True):
            same = x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and not isinstance(x, bool) and abs(x - y) <= digits * max(1, abs(y)))
            if not same:
                bad += 1
                first = first or f"{n}: {x!r} and {y!r} in {a} and {b}"
    return f"{bad} cells differ, {first}" if bad else ""
