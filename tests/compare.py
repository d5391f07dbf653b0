"""Rows of a Spark query and of DuckDB SQL in a form that can be compared."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    def plain(x):
        if x is None or x is pd.NaT or x is pd.NA or isinstance(x, float) and x != x:
            return None
        return str(x) if isinstance(x, str) else round(float(x), 5)

    columns = sorted(df.columns)
    return columns, sorted((tuple(map(plain, r)) for r in df[columns].itertuples(index=False)), key=repr)
