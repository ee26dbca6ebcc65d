"""Run a query and its DuckDB twin on the same tables and compare rows without regard to order."""

import datetime
import decimal
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    if isinstance(v, (list, tuple)):
        return tuple(map(_plain, v))
    return v


def check(spark, query, sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    df = query(spark, sf_dir)
    columns = sorted(df.columns)
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = sorted(repr(tuple(_plain(r[names.index(c)]) for c in columns)) for r in found.fetchall())
    got = sorted(repr(tuple(_plain(r[c]) for c in columns)) for r in df.collect())
    assert got == want
