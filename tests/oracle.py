"""Runs a query and its SQL side by side."""

import math

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(folder=SF):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return c


def normal(rows):
    return sorted(repr(tuple(None if isinstance(v, float) and math.isnan(v) else v for v in r)) for r in rows)


def assert_same(spark, query, sql, folder=SF):
    df = query(spark, folder)
    columns = sorted(df.columns)
    mine = normal(tuple(r) for r in df.select(*(f"`{c}`" for c in columns)).collect())
    found = connection(folder).sql(sql)
    assert sorted(found.columns) == columns
    places = [found.columns.index(c) for c in columns]
    assert mine == normal(tuple(r[p] for p in places) for r in found.fetchall())
    assert mine
