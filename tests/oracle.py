"""Runs a query's SQL in a second engine and compares rows."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = os.environ.get("TESTDATA_DIR", "/root/testdata/sf0.01")


def expected(sql: str, folder: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(sql)
    names = [c[0] for c in out.description]
    return sorted_rows(names, out.fetchall())


def sorted_rows(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(r[k] for k in order) for r in rows), key=repr)


def actual(df):
    return sorted_rows(df.columns, [tuple(r) for r in df.collect()])
