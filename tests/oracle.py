"""Runs a query in Spark and its SQL in DuckDB over the same tables, and compares the rows as multisets."""

import datetime
import decimal
import glob
import os

import duckdb


def canon(v):
    if isinstance(v, float):
        return None if v != v else round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6)
    if isinstance(v, (list, tuple)):
        return tuple(map(canon, v))
    if isinstance(v, dict):
        return tuple(map(canon, v.values()))
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def connect(sf):
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        name = os.path.basename(f).removesuffix(".parquet")
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{f if os.path.isfile(f) else f + '/*.parquet'}')")
    return con


def both(spark, sf, query, sql):
    df = query(spark, sf)
    names = sorted(df.columns)
    mine = sorted(repr(tuple(canon(r[n]) for n in names)) for r in df.collect())
    cur = connect(sf).execute(sql)
    theirs_names = [d[0] for d in cur.description]
    at = [theirs_names.index(n) for n in sorted(theirs_names)]
    theirs = sorted(repr(tuple(canon(r[i]) for i in at)) for r in cur.fetchall())
    return names, mine, sorted(theirs_names), theirs
