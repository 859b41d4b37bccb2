"""Runs a query and its SQL over the same tables and compares rows without order."""

from __future__ import annotations

import glob
import os

import duckdb


def connect(sf_dir: str):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def plain(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v + 0.0:.6f}"
    return str(v)


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted(tuple(plain(r[k]) for k in order) for r in rows)


def differences(df, sql: str, con) -> str:
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    rel = con.sql(sql)
    want_names, want = rel.columns, rel.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(got_names)} and {sorted(want_names)}"
    a, b = table(got_names, got), table(want_names, want)
    if a != b:
        left, right = [x for x in a if x not in set(b)][:2], [x for x in b if x not in set(a)][:2]
        return f"{len(a)} and {len(b)} rows; only here {left}; only in SQL {right}"
    return ""
