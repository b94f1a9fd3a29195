"""Rows of a query against rows of its SQL, without order."""

import math
import os

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def value(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else round(x, 5) + 0.0
    return x


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def duckdb_rows(sql, sf=SF):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def same(df, sql, sf=SF):
    names, rows = duckdb_rows(sql, sf)
    assert sorted(df.columns) == sorted(names)
    got, want = rows_of(df.columns, df.collect()), rows_of(names, rows)
    assert len(got) == len(want)
    differ = [(a, b) for a, b in zip(got, want, strict=True) if a != b]
    assert not differ, differ[:3]
