"""Comparison of a query with its SQL on the same tables."""

import glob
import os

import duckdb
import pandas as pd

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir=SF):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        files = path if os.path.isfile(path) else f"{path}/*.parquet"
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{files}')")
    return con


def plain(frame):
    def cell(v):
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        return f"{v:.6g}" if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)].map(cell)
    return list(frame.columns), sorted(map(tuple, frame.itertuples(index=False)))


def same(query, sql, spark, con, sf_dir=SF):
    assert plain(query(spark, sf_dir).toPandas()) == plain(con.execute(sql).df())
