"""Compares a query's rows with those of its SQL on the smallest test tables."""

import glob
import math
import os

import duckdb

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect():
    c = duckdb.connect()
    c.sql("SET timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        name = os.path.basename(p)[:-8]
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{p}'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return str(v) if not isinstance(v, (int, bool, str)) else v


def rows_of(df):
    columns = sorted(df.columns)
    return columns, sorted(repr(tuple(plain(r[c]) for c in columns)) for r in df.collect())


def sql_rows(sql):
    rel = connect().sql(sql)
    columns = sorted(rel.columns)
    at = [rel.columns.index(c) for c in columns]
    return columns, sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
