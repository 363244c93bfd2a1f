"""A query's rows against those of its SQL in DuckDB."""

import os

import duckdb
import numpy as np

SF = "/root/testdata/sf0.001"


def connect(sf=SF):
    con = duckdb.connect()
    for p in os.listdir(sf):
        con.execute(f"CREATE VIEW {p.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{sf}/{p}')")
    return con


def _plain(df):
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        kind = str(df[c].dtype)
        df[c] = df[c].round(6).astype(float) if kind.startswith("float") else df[c].astype("Float64").astype(float) if kind.lower().startswith(("int", "uint")) else df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def same(spark, query, sql, sf=SF):
    a, b = _plain(query(spark, sf).toPandas()), _plain(connect(sf).execute(sql).df())
    assert list(a.columns) == list(b.columns) and len(a) == len(b)
    for c in a.columns:
        if a[c].dtype == float:
            assert np.allclose(a[c], b[c].astype(float), equal_nan=True, atol=1e-6), c
        else:
            assert a[c].tolist() == b[c].tolist(), c
