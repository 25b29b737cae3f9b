"""Compares a query with its DuckDB oracle on one folder of tables."""

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = "/root/testdata/sf0.001"


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


def same(df, sql, con):
    names = sorted(df.columns)
    got = Counter(tuple(plain(v) for v in r) for r in df.select(*names).collect())
    cursor = con.execute(sql)
    have = [c[0] for c in cursor.description]
    assert sorted(have) == names
    want = Counter(tuple(plain(r[have.index(c)]) for c in names) for r in cursor.fetchall())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
