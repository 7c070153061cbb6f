"""Compares a query with its SQL in DuckDB."""

import datetime
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return None
    if hasattr(x, "tolist"):
        x = x.tolist()
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    if isinstance(x, bool):
        return x
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return round(float(x), 5) + 0.0
    return str(x)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted(([plain(r[i]) for i in order] for r in rows), key=repr)


def check(spark, sf_dir, run, sql):
    df = run(spark, sf_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = connect(sf_dir).execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    want = rows_of(names, found.fetchall())
    assert len(got) == len(want)
    assert got == want
