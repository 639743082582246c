"""Holds a query's rows against those of its SQL in DuckDB."""

from __future__ import annotations

import datetime
import decimal
import math
import os
from collections import Counter

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    """A value in a form that both engines agree on: floats to nine significant digits, whole numbers as int."""
    if isinstance(x, (bytes, bytearray, memoryview)):
        return bytes(x)
    if isinstance(x, bool) or x is None or isinstance(x, str):
        return x
    if isinstance(x, (float, decimal.Decimal)):
        x = float(x)
        return "nan" if math.isnan(x) else int(x) if x.is_integer() and abs(x) < 1e15 else float(f"{x:.9g}")
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in (x.asDict().values() if hasattr(x, "asDict") else x))
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    return x.isoformat() if isinstance(x, (datetime.date, datetime.datetime)) else x


def spark_rows(df) -> tuple[list[str], Counter]:
    names = sorted(df.columns)
    return names, Counter(tuple(plain(r[n]) for n in names) for r in df.select(*[f"`{n}`" for n in names]).collect())


def duck_rows(sql: str, sf_dir: str) -> tuple[list[str], Counter]:
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(path := f"{sf_dir}/{t}.parquet"):
            con.execute(f"create view {t} as select * from read_parquet('{path}')")
    got = con.execute(sql)
    have = [d[0] for d in got.description]
    order = sorted(range(len(have)), key=lambda i: have[i])
    return sorted(have), Counter(tuple(plain(r[i]) for i in order) for r in got.fetchall())


def differences(df, sql: str, sf_dir: str) -> list[str]:
    """What differs, in words; nothing if all rows agree."""
    (a, x), (b, y) = spark_rows(df), duck_rows(sql, sf_dir)
    if a != b:
        return [f"columns {a} against {b}"]
    return [f"only in Spark {n} x {str(r)[:300]}" for r, n in (x - y).most_common(3)] + [f"only in SQL {n} x {str(r)[:300]}" for r, n in (y - x).most_common(3)]
