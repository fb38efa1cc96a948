"""Compare a query's rows with DuckDB's for its SQL."""

import os

import duckdb
import pandas as pd


def connect(sf):
    c = duckdb.connect()
    for name in os.listdir(sf):
        path = f"{sf}/{name}"
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS FROM '{path + '/*.parquet' if os.path.isdir(path) else path}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v != v:
        return "null"
    if isinstance(v, float):
        return repr(round(v, 6) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows(frame):
    columns = sorted(frame.columns)
    return columns, sorted(tuple(plain(r[c]) for c in columns) for r in frame.collect())


def sql_rows(connection, sql):
    cursor = connection.execute(sql)
    names = [d[0] for d in cursor.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(names), sorted(tuple(plain(r[i]) for i in order) for r in cursor.fetchall())
