"""Run a query and its SQL on the same tables and compare rows, order aside."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb

SF = "/root/testdata/sf0.001"


def plain(v):
    if isinstance(v, (float, decimal.Decimal)) and not isinstance(v, bool):
        return "nan" if math.isnan(float(v)) else float(f"{float(v):.9g}")
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, int):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


def connect(sf_dir: str = SF):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return c


def compare(spark, connection, query, sql, sf_dir: str = SF) -> None:
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    cursor = connection.execute(sql)
    theirs = [d[0] for d in cursor.description]
    assert sorted(theirs) == names
    at = [theirs.index(n) for n in names]
    want = sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=repr)
    got = sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=repr)
    assert got == want
