"""Holds a query's rows against those of its SQL in DuckDB."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plain(value):
    if value is None or value != value:
        return None
    if isinstance(value, float):
        return f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return tuple(map(plain, value))
    if hasattr(value, "asDict"):
        return tuple((k, plain(v)) for k, v in sorted(value.asDict().items()))
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    return str(value)


def rows(columns, found):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in found), key=repr)


def expected(sql, folder=FOLDER):
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    out = con.execute(sql)
    return rows([c[0] for c in out.description], out.fetchall())


def assert_same(df, sql, folder=FOLDER):
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == expected(sql, folder)
