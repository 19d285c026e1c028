"""Runs queries and their SQL side by side, as sorted rows with columns by name."""

import glob
import math
import os

import duckdb


def connect(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        at = f"{f}/*.parquet" if os.path.isdir(f) else f
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{at}')")
    return con


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(r[i] for i in order) for r in data], key=lambda r: tuple((v is None, str(type(v)), v) if v is not None else (True, "", 0) for v in r))


def same(a, b):
    if isinstance(a, float) or isinstance(b, float):
        return a is not None and b is not None and (a == b or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-9))
    return a == b


def difference(spark, con, query, sql, sf_dir):
    """None if equal, else what differs."""
    df = query(spark, sf_dir)
    got = rows(df.columns, df.collect())
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    want = rows(names, cur.fetchall())
    if sorted(df.columns) != sorted(names):
        return f"columns {sorted(df.columns)} and {sorted(names)}"
    if len(got) != len(want):
        return f"{len(got)} rows and {len(want)}"
    off = [(g, w) for g, w in zip(got, want) if len(g) != len(w) or not all(map(same, g, w))]
    return f"{len(off)} of {len(got)} rows differ, first {off[0]}" if off else None
