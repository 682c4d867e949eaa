"""Runs a query and its SQL on the same tables and compares rows, whatever their order."""

import decimal

import duckdb

SMALL = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = int(v) if v == int(v) else float(v)
    if isinstance(v, float):
        return round(v, 9)
    return v


def same(spark, con, make, sql, sf_dir):
    df = make(spark, sf_dir)
    names = sorted(df.columns)
    ours = [tuple(plain(v) for v in r) for r in df.select(*names).collect()]
    found = con.execute(sql)
    columns = [c[0] for c in found.description]
    assert sorted(columns) == names
    at = [columns.index(n) for n in names]
    theirs = [tuple(plain(r[i]) for i in at) for r in found.fetchall()]
    assert sorted(map(repr, ours)) == sorted(map(repr, theirs))
    return len(ours)
