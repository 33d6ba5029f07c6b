"""A query's rows against its SQL's in DuckDB, in any order, doubles to six places."""

import glob
import os

import duckdb
import numpy as np
import pandas as pd


def duck(sf):
    c = duckdb.connect()
    for p in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return c


def _shown(v):
    if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, (float, np.floating)) and v != v):
        return "-"
    if isinstance(v, (bool, np.bool_)):
        return str(bool(v))
    if isinstance(v, (float, np.floating)):
        return str(round(float(v), 6) + 0.0)
    return str(int(v)) if isinstance(v, (int, np.integer)) else str(v)


def rows(df):
    # a column of whole numbers may come as doubles because of nulls
    whole = {c: df[c].dtype.kind == "f" and bool((df[c].dropna() % 1 == 0).all()) for c in df.columns}
    return sorted(tuple(_shown(int(v) if whole[c] and v == v else v) for c, v in zip(sorted(df.columns), r, strict=True)) for r in df[sorted(df.columns)].itertuples(index=False, name=None))


def same(spark, query, sql, sf):
    got, want = query(spark, sf).toPandas(), duck(sf).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)
