"""Rows of a Spark query and of DuckDB SQL in a form that can be compared."""

import math
import os

import duckdb
import pandas as pd


def duck(sf_dir):
    con = duckdb.connect()
    for name in os.listdir(sf_dir):
        con.execute(f"create view {name.removesuffix('.parquet')} as select * from '{sf_dir}/{name}'")
    return con


def text(v):
    if v is None or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, (list, tuple)) and not hasattr(v, "asDict"):
        return "[" + ",".join(map(text, v)) + "]"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return f"{v:.9g}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(text(r[i]) for i in order) for r in data)


def same(df, con, sql):
    got = rows(df.columns, [tuple(r) for r in df.collect()])
    rel = con.sql(sql)
    want = rows(list(rel.columns), rel.fetchall())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    for a, b in zip(got[1], want[1]):
        if a != b:
            for x, y in zip(a, b):
                assert x == y or float(x) == float(y), (a, b)
    return len(got[1])
