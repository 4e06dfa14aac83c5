"""Comparing query results with DuckDB."""

import glob
import os

import duckdb
import pandas as pd


def views(sf_dir):
    con = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f if os.path.isfile(f) else f + '/*.parquet'}'")
    return con


def normal(df):
    def cell(v):
        if hasattr(v, "__len__") and not isinstance(v, str | bytes):
            return repr(list(v))
        return "null" if pd.isna(v) else repr(round(float(v), 6)) if isinstance(v, int | float) or hasattr(v, "dtype") else str(v)

    out = df[sorted(df.columns)].copy()
    for c in out:
        out[c] = out[c].map(cell)
    return out.sort_values(list(out.columns)).reset_index(drop=True)


def compare(spark, queries, oracles, sf_dir):
    """Names of the queries whose rows differ from their SQL's."""
    con, bad = views(sf_dir), []
    for name, sql in oracles.items():
        a, b = normal(queries[name](spark, sf_dir).toPandas()), normal(con.sql(sql).df())
        if not a.equals(b):
            bad.append(name)
    return bad
