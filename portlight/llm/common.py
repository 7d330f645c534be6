"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: spark.checkpoint.dir, or one of our own where that is unset
    and all run in one process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        context.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="portlight-"))
        now = context._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


def fresh_dir(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: cuts the lineage, and a lost executor costs nothing."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes the table that materialise() wrote for df. For tables that only went into others that are written by now."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df doesn't have yet."""
    have = {c.lower() for c in df.columns}
    while wanted.lower() in have:
        wanted = "_" + wanted
    return wanted


def maybe_in(df: DataFrame, column: str, keys: DataFrame, bits: int = 24, wanted: bool = True) -> DataFrame:
    """Rows of df whose column may be among keys (one column), before a join that decides it; or, not wanted, the others,
    which surely aren't.

    A Bloom filter with one hash and 2 ** bits bits, of a fixed size whatever the number of keys, is broadcast in pages of 512 words of
    64 bits: a few hundred rows, 2 MB for 24 bits. As a row for each word it would take the driver's heap many times that. Where most
    bits are set it keeps most rows, and is still right.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(1 << bits))
    bit = lambda h: F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(63).cast("int"))
    every = df.sparkSession.range(0, 1 << max(0, bits - 6), 1, 1).select(F.col("id").alias("word_"), F.lit(0).cast("long").alias("set_"))
    words = keys.toDF("key_").withColumn("h_", place("key_")).select(F.shiftright("h_", 6).alias("word_"), bit(F.col("h_")).alias("set_"))
    words = words.union(every).groupBy("word_").agg(F.bit_or("set_").alias("set_"))
    kept = df.columns
    h, page, bits_ = free_name(df, "h_"), free_name(df, "page_"), free_name(df, "set_")
    pages = words.groupBy(F.shiftright("word_", 9).alias(page)).agg(F.transform(F.sort_array(F.collect_list(F.struct("word_", "set_"))), lambda x: x["set_"]).alias(bits_))
    rows = df.withColumn(h, place(column)).withColumn(page, F.shiftright(h, 15)).join(F.broadcast(pages), page)
    found = F.get(bits_, F.shiftright(h, 6).bitwiseAND(511).cast("int")).bitwiseAND(bit(F.col(h))) != 0
    return rows.filter(found if wanted else ~found).select(kept)


def limit_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Batches to and from Python of so many rows at most, for the session's jobs from here on, those of lazy plans among them: rows with
    whole texts or sets take several kB, and a batch stands in the executor's and in the worker's memory at once, several times."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= rows:
        spark.conf.set(name, rows)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000):
    """limit_batches for jobs that run inside."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    limit_batches(spark, rows)
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextlib.contextmanager
def small_broadcasts(spark: SparkSession, size: int = 1 << 20):
    """Sides of joins are broadcast by jobs inside where they are estimated at so many bytes at most: the estimate is of compressed files,
    and a broadcast side takes the driver's heap many times that. A lower threshold of the session, or none, stays."""
    plain, adaptive = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"
    before = {name: spark.conf.get(name, None) for name in (plain, adaptive)}  # None where unset
    in_bytes = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for name, value in {plain: spark.conf.get(plain), adaptive: before[adaptive]}.items():
        if value is not None and not value.startswith("-") and in_bytes(value) > size:
            spark.conf.set(name, size)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def release(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of plans that nothing refers to any more; else they wait for the driver's next full
    garbage collection. Spark's threads hold on to the last job, so a small one runs first."""
    spark.range(0, 1, 1, 1).write.format("noop").mode("overwrite").save()
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words_of(text: Column) -> Column:
    """Lower-cased runs of letters and digits; null counts as empty."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


# ---- hashing of byte windows and words with numpy (inside tasks) ----

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over the 64 output bits (uint64 in, uint64 out)."""
    x = x ^ (x >> np.uint64(30))
    x = x * _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def byte_values(seed: int) -> np.ndarray:
    """256 pseudo-random 64-bit values, one for each byte."""
    return mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))


_VALUES = byte_values(17)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> np.ndarray:
    out = np.full(n, _BASE, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_POWERS = _powers(1024)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each white-space separated word of data, A-Z lower-cased."""
    b = _LOWER[np.frombuffer(data, dtype=np.uint8)]
    if not len(b):
        return np.zeros(0, dtype=np.uint64)
    inside = ~_SPACE[b]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(starts):
        return np.zeros(0, dtype=np.uint64)
    place = np.arange(len(b), dtype=np.int64)
    place -= np.repeat(np.r_[0, starts], np.diff(np.r_[0, starts, len(b)]))
    longest = int((ends - starts).max())
    powers = _POWERS if longest <= len(_POWERS) else _powers(longest)
    value = np.where(inside, _VALUES[b] * powers[np.where(inside, place, 0)], np.uint64(0))
    return mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64))


def shingle_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the runs of `width` words; of the whole sequence when it is shorter; none when it is empty."""
    if not len(words):
        return words
    k = min(width, len(words))
    n = len(words) - k + 1
    out = np.full(n, np.uint64(k))
    for i in range(k):
        out = mix64(out * _BASE + words[i : i + n])
    return out
