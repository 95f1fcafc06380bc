"""Compares a query with its SQL twin: column names, then rows in any order."""

from __future__ import annotations

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, decimal.Decimal):
        return int(x) if x == x.to_integral() else float(x)
    if isinstance(x, float):
        return float(f"{x:.10g}") if x != int(x) else int(x) if abs(x) < 1e15 else x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None)
    return x


def expected(sql: str, folder: str):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{folder}/{t}.parquet"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    return names, found.fetchall()


def compare(spark, folder: str, query, sql: str) -> str:
    """Empty if both agree, else what differs."""
    df = query(spark, folder)
    names, rows = expected(sql, folder)
    if sorted(df.columns) != sorted(names):
        return f"columns {df.columns} and {names}"
    order = sorted(names)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    want = sorted((tuple(plain(r[names.index(c)]) for c in order) for r in rows), key=repr)
    if got == want:
        return ""
    wrong = {c for g, w in zip(got, want, strict=False) for c, x, y in zip(order, g, w, strict=True) if x != y} if len(got) == len(want) else "?"
    return f"{len(got)} and {len(want)} rows, columns {wrong}; " + repr([p for p in zip(got, want, strict=False) if p[0] != p[1]][:2])
