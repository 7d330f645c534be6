"""How tables lie: events by day, so that look-backs read the days in reach; order-keyed tables in buckets of the order's number, so
that joins and windows by order need no exchange."""

from __future__ import annotations

import uuid
from types import SimpleNamespace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

#: Column by which each table is bucketed.
ORDER_KEYS = {"po_lines": "po_number", "asn_ibd": "reference_document", "carrier_events": "po_number", "idoc_errors": "po_number", "po_partners": "po_number", "exceptions": "po_number"}


def write_by_day(df: DataFrame, path: str, time: str) -> None:
    """df in a folder for each day of a time column, day=2024-01-30 and so on; rows without a time lie in a folder of their own."""
    df.withColumn("day", F.to_date(time)).repartition("day").write.mode("append").partitionBy("day").parquet(path)


def read_days(spark: SparkSession, path: str, time: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Rows of a table by day whose time lies between two moments (both included, None is open); only folders of these days are read."""
    df = spark.read.parquet(path)
    if since is not None:
        df = df.filter((F.col("day") >= F.to_date(F.lit(since).cast("timestamp"))) & (F.col(time) >= F.lit(since).cast("timestamp")))
    if until is not None:
        df = df.filter((F.col("day") <= F.to_date(F.lit(until).cast("timestamp"))) & (F.col(time) <= F.lit(until).cast("timestamp")))
    return df.drop("day")


#: Bytes of a stored table for each bucket: what a task reads stays the same however large the tables are.
BUCKET_BYTES = 4 << 20


def buckets_for(df: DataFrame, least: int = 8) -> int:
    """How many buckets for tables that grow with df, a stored table: a power of two, so that twice the rows don't mix buckets anew."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return max(least, 1 << (-(-size // BUCKET_BYTES) - 1).bit_length())


def co_located(t, names: list[str], buckets: int = 64, columns: dict[str, list[str]] | None = None) -> SimpleNamespace:
    """The order-keyed tables of a catalogue in buckets of their order's number, for all of which `buckets` is the same; other
    tables of `names` as they are. A task then reads one bucket of each and joins them where they lie. Tables that `columns` names
    are stored with these columns only, their key among them."""
    spark, out = t._spark, {}
    # keys of a join may be more than those of the buckets
    spark.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    for name in names:
        df, key = getattr(t, name), ORDER_KEYS.get(name)
        if key is None:
            out[name] = df
            continue
        if columns and name in columns:
            df = df.select(columns[name])
        table = f"{name}_{uuid.uuid4().hex}"
        df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key).option("path", shared_folder(spark, name)).saveAsTable(table)
        out[name] = spark.table(table)
    return SimpleNamespace(_spark=spark, **out)
