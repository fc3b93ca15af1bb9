"""Runs a query in Spark and its SQL in DuckDB and compares the rows."""

import glob
import math
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        files = f"{p}/*.parquet" if os.path.isdir(p) else p
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.9g}")
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def check(spark, con, sf_dir: str, query, sql: str) -> None:
    df = query(spark, sf_dir)
    got = df.collect()
    r = con.execute(sql)
    names = [d[0] for d in r.description]
    want = r.fetchall()
    assert sorted(names) == sorted(df.columns)
    at = [names.index(c) for c in sorted(names)]
    a = sorted((tuple(norm(x[c]) for c in sorted(names)) for x in got), key=repr)
    b = sorted((tuple(norm(x[i]) for i in at) for x in want), key=repr)
    assert len(a) == len(b)
    assert a == b
