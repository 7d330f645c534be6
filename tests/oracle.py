"""Spark's rows against those of SQL on the same Parquet files."""

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of(frame: pd.DataFrame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda x: None if x is None or x is pd.NA or x is pd.NaT or isinstance(x, float) and x != x else x if isinstance(x, (int, float, str, bool)) else str(x)
    return sorted(repr(tuple(map(plain, row))) for row in frame.itertuples(index=False, name=None))


def connect(folder: str = SF):
    db = duckdb.connect()
    db.execute("set timezone = 'UTC'")
    for t in TABLES:
        db.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    return db


def compare(spark, query, sql: str, folder: str = SF) -> None:
    got, want = query(spark, folder).toPandas(), connect(folder).sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
