"""Compares a query with its SQL, row by row."""

import glob
import os

import duckdb


def rounded(value):
    return round(value, 6) if isinstance(value, float) and value == value else None if value != value else value


def compare(spark, query, sql, sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path if os.path.isfile(path) else path + '/*.parquet'}')")
    frame = query(spark, sf_dir)
    columns = sorted(frame.columns)
    want = con.sql(sql)
    assert sorted(want.columns) == columns
    wanted = want.select(", ".join(columns)).fetchall()
    got = [tuple(rounded(x) for x in row) for row in frame.select(*columns).collect()]
    key = lambda row: tuple(map(str, row))
    assert sorted(got, key=key) == sorted((tuple(rounded(x) for x in row) for row in wanted), key=key)
