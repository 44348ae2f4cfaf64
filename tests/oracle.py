"""Compare a query with its SQL on the same files, columns by name and rows in any order."""

import decimal
import glob
import os

import duckdb
import numpy as np
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        files = f"{path}/*.parquet" if os.path.isdir(path) else path
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{files}'")
    return con


def plain(x):
    if x is None or x is pd.NaT or x is pd.NA or (isinstance(x, float) and x != x):
        return ""
    if isinstance(x, (int, float, np.integer, np.floating, decimal.Decimal)) and not isinstance(x, bool):
        return f"{float(x) + 0.0:.9g}"
    return str(x)


def canonical(df):
    out = df[sorted(df.columns)].copy()
    for c in out.columns:
        if pd.api.types.is_datetime64_any_dtype(out[c]):
            out[c] = pd.to_datetime(out[c], utc=True).dt.strftime("%F %T.%f")
        out[c] = out[c].astype(object).map(plain)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def differences(spark, query, sql, sf_dir):
    got, want = canonical(query(spark, sf_dir).toPandas()), canonical(views(sf_dir).execute(sql).df())
    if list(got.columns) != list(want.columns):
        return f"columns {list(got.columns)} and {list(want.columns)}"
    if len(got) != len(want):
        return f"{len(got)} and {len(want)} rows"
    bad = (got != want).any(axis=1)
    return f"{bad.sum()} rows differ:\n{got[bad].head(3)}\n{want[bad].head(3)}" if bad.any() else ""
