"""Run a query and its SQL side by side."""

import decimal

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def sql_rows(sql, sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    rel = con.sql(sql)
    return rel.columns, rel.fetchall()


def plain(v):
    return float(v) if isinstance(v, decimal.Decimal) else v


def check(spark, query, sql, sf):
    df = query(spark, sf)
    cols = sorted(df.columns)
    names, want = sql_rows(sql, sf)
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(map(plain, r)) for r in df.select(*(f"`{c}`" for c in cols)).collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want), key=key)
