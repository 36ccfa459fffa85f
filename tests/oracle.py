"""Compare a Spark result with DuckDB on the same Parquet tables, rows in any order."""

import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return con


def normal(df):
    def one(v):
        if v is None or (not hasattr(v, "__len__") and pd.isna(v)):
            return "null"
        if isinstance(v, float) or type(v).__name__.startswith(("Decimal", "float")):
            return repr(round(float(v), 6) + 0.0)
        return str(v.tolist()) if hasattr(v, "tolist") else str(v)

    df = df[sorted(df.columns)]
    return sorted(map(tuple, df.map(one).values.tolist()))


def same(spark_df, con, sql):
    a, b = spark_df.toPandas(), con.sql(sql).df()
    assert sorted(a.columns) == sorted(b.columns)
    assert normal(a) == normal(b)
