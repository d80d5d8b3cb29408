"""Comparison of Spark rows with DuckDB rows, without order; doubles to six digits."""

import decimal
import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.6g}") + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def same_rows(df, con, sql):
    cols = sorted(df.columns)
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    assert sorted(names) == cols
    at = [names.index(c) for c in cols]
    a = sorted((tuple(plain(v) for v in r) for r in df.select(*[df[c] for c in cols]).collect()), key=repr)
    b = sorted((tuple(plain(r[i]) for i in at) for r in cur.fetchall()), key=repr)
    assert a == b
