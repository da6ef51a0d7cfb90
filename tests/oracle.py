"""Holds a query against its DuckDB SQL over the same tables."""

from collections import Counter
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connection():
    con = duckdb.connect()
    for t in TABLES:
        at = Path(SF, f"{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{at / '*.parquet' if at.is_dir() else at}'")
    return con


def rows(df, columns):
    return Counter(map(str, df[columns].itertuples(index=False, name=None)))


def same(spark, query, sql):
    got, want = query(spark, SF).toPandas(), connection().execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)
