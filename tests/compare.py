"""Row-for-row comparison of a Spark result with DuckDB SQL over the same Parquet tables."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DATA = "/root/testdata/sf0.001"


def cell(x):
    if x is None or x != x:
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    if isinstance(x, (int, float)) or type(x).__name__ == "Decimal":
        return repr(round(float(x), 5) + 0.0)
    return str(x)


def rows(columns, data):
    at = [columns.index(c) for c in sorted(columns)]
    return sorted("|".join(cell(r[i]) for i in at) for r in data)


def duck(sql, sf_dir=DATA):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    r = c.sql(sql)
    return r.columns, r.fetchall()


def assert_same(df, sql, sf_dir=DATA):
    columns, want = duck(sql, sf_dir)
    assert sorted(df.columns) == sorted(columns)
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    want = rows(columns, want)
    assert got == want, (len(got), len(want), sorted(set(got) - set(want))[:3], sorted(set(want) - set(got))[:3])


def has_data():
    return os.path.isdir(DATA)
