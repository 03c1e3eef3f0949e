"""Runs a query and its SQL side by side and compares their rows."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        if Path(f"{sf_dir}/{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def _plain(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6) + 0.0
    return x


def rows(columns: list[str], data) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return sorted(out, key=lambda r: tuple((v is not None, str(type(v)), v) if v is not None else (False, "", 0) for v in r))


def differences(df, con: duckdb.DuckDBPyConnection, sql: str) -> str:
    """Empty if the rows agree; else the first difference."""
    mine = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    theirs = rows(names, cur.fetchall())
    if len(mine) != len(theirs):
        return f"{len(mine)} and {len(theirs)} rows"
    for a, b in zip(mine, theirs):
        if a != b:
            return f"{sorted(df.columns)}: {a} and {b}"
    return ""
