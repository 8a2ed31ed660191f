"""Compare a registered query with its DuckDB twin."""

import math

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, (int, float)):
        return round(float(v), 6)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark, con, query, sql, sf_dir):
    got = query(spark, sf_dir)
    names = got.columns
    want = con.execute(sql)
    assert sorted(names) == sorted(c[0] for c in want.description)
    assert rows_of(names, [tuple(r) for r in got.collect()]) == rows_of([c[0] for c in want.description], want.fetchall())
