"""Compare a Spark query with its DuckDB SQL over the smallest tables."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = df[c].astype(float).round(6) if df[c].dtype.kind in "fiub" else df[c].map(lambda x: None if x is None or x != x else str(x))
    return df.sort_values(list(df.columns), na_position="first").reset_index(drop=True)


def assert_same(spark, query, sql: str) -> None:
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    ours, theirs = plain(query(spark, SF).toPandas()), plain(con.sql(sql).df())
    pd.testing.assert_frame_equal(ours, theirs, check_dtype=False, check_exact=False, atol=1e-6, rtol=0)
