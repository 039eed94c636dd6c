"""Compares a query with its SQL the way the driver does: rows, columns, values."""

from __future__ import annotations

import math
import os

import duckdb

ROOT = "/root/testdata"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle(sf: str):
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        p = f"{ROOT}/{sf}/{t}.parquet"
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p + '/**/*.parquet' if os.path.isdir(p) else p}')")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict(recursive=True)
    if isinstance(v, dict):
        return tuple((k, plain(x)) for k, x in sorted(v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (bytes, bytearray)):
        return bytes(v)
    try:
        f = float(v)
        return int(v) if f == int(f) and abs(f) < 2**53 and not isinstance(v, int) else v if isinstance(v, int) else float(f"{f:.9g}")
    except (TypeError, ValueError):
        return str(v)


def same(x):
    return float(x) if isinstance(x, int) and not isinstance(x, bool) else tuple(map(same, x)) if isinstance(x, tuple) else x


def compare(spark, fn, sql, sf):
    df = fn(spark, f"{ROOT}/{sf}")
    cols = sorted(df.columns)
    got = sorted((tuple(same(plain(r[c])) for c in cols) for r in df.collect()), key=repr)
    rel = oracle(sf).sql(sql)
    names = list(rel.columns)
    assert sorted(names) == cols, (cols, names)
    at = [names.index(c) for c in cols]
    want = sorted((tuple(same(plain(r[i])) for i in at) for r in rel.fetchall()), key=repr)
    assert len(got) == len(want), (len(got), len(want), got[:2], want[:2])
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    assert not bad, f"{len(bad)} of {len(got)} rows differ: {bad[0]}"
    return len(got)
