"""Registration of queries: a function of the domain tables, with its SQL for the oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .plans.bridge import Tables, oracle_prefix

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function of the domain tables under its name."""

    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: _plain(f(Tables(spark, sf_dir)))
        if sql:
            ORACLE_SQL[f.__name__] = oracle_prefix() + sql
        return f

    return add


def _plain(df: DataFrame) -> DataFrame:
    """Decimals as doubles and times as text, as engines write those in different ways."""
    kinds = {"decimal": lambda c: F.col(c).cast("double"), "timestamp": lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss"), "date": lambda c: F.date_format(c, "yyyy-MM-dd")}
    return df.select(*[next((f(c).alias(c) for k, f in kinds.items() if t.startswith(k)), F.col(f"`{c}`")) for c, t in df.dtypes])
