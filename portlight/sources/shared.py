"""The folder that the driver and all executors share, for tables that a query writes and reads again."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new name below spark.checkpoint.dir; where that is unset and all runs in one process (tests), below a folder of our own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        now = context._jsc.sc().getCheckpointDir()
        if now.isEmpty():
            context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="portlight-"))
            now = context._jsc.sc().getCheckpointDir()
        base = now.get()
    return f"{base.rstrip('/')}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read back: what is used several times isn't derived again."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Lets Spark drop the shuffle files of jobs that are done; else they wait for the driver's next full garbage collection. Spark's
    threads hold on to the last job, so a small one runs first."""
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
