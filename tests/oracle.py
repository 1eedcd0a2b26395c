"""Runs a query in Spark and its SQL in DuckDB and compares rows without regard to order."""

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.execute(f"create view {t} as select * from '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return con


def _key(row):
    return tuple((v is None, round(v, 6) if isinstance(v, float) else v) if v is not None else (True, "") for v in row)


def assert_same(df, con, sql):
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in found.fetchall()), key=lambda r: str(_key(r)))
    got = sorted((tuple(r) for r in df.select(*sorted(df.columns)).collect()), key=lambda r: str(_key(r)))
    assert [_key(r) for r in got] == [_key(r) for r in want]
