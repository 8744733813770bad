"""Rows of a Spark query against rows of its SQL in DuckDB, whatever the order."""

from __future__ import annotations

import datetime
import math
from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = Path(sf_dir, f"{t}.parquet")
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{f'{p}/*.parquet' if p.is_dir() else p}'")
    return c


def same(df, connection, sql: str) -> None:
    got = df.collect()
    r = connection.execute(sql)
    names = [d[0] for d in r.description]
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    ours = sorted(tuple(plain(row[c]) for c in order) for row in got)
    theirs = sorted(tuple(plain(row[names.index(c)]) for c in order) for row in r.fetchall())
    assert len(ours) == len(theirs)
    wrong = [(a, b) for a, b in zip(ours, theirs, strict=True) if a != b]
    assert not wrong, wrong[:3]
