"""File sources and sinks: landed JSON pages, seed CSV, uploads and versions of tables."""

from __future__ import annotations

import contextlib
import json
import re
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Landed pages, each {"value": [...]}, {"d": {"results": [...]}}, {"d": [...]} or a single {"d": {...}}, one document a
    line, as rows."""
    one = f"struct<{_fields(schema)}>"
    pages = spark.read.schema("value string, d string").json(path)
    return pages.select(F.explode(F.coalesce(collection("value", one), collection("d", one))).alias("x")).select("x.*")


def collection(text, element: str) -> Column:
    """The elements of a JSON text: an array, {"results": array} or a single object; null or '' is null."""
    c = F.col(text) if isinstance(text, str) else text
    results = F.get_json_object(c, "$.results")
    return F.when(F.startswith(F.trim(c), F.lit("[")), F.from_json(c, f"array<{element}>")).when(results.isNotNull(), F.from_json(results, f"array<{element}>")).when(F.coalesce(c, F.lit("")) != "", F.array(F.from_json(c, element)))


def _fields(schema: str) -> str:
    from pyspark.sql.types import _parse_datatype_string

    return _parse_datatype_string(schema).simpleString()[len("struct<") : -1]


def read_seed(spark: SparkSession, path: str, schema: str, separator: str = ",") -> DataFrame:
    return spark.read.csv(path, schema=schema, header=True, sep=separator, quote='"', escape='"')


def upload_cells(spark: SparkSession, payload: str, columns: list[str]) -> DataFrame:
    """A JSON array of objects as text rows with row_idx, for validate_upload."""
    one = spark.createDataFrame([(payload,)], "payload string")
    rows = one.select(F.posexplode(F.from_json("payload", "array<map<string,string>>")).alias("row_idx", "m"))
    return rows.select(F.col("row_idx").cast("long").alias("row_idx"), *[F.col("m")[c].alias(c) for c in columns])


def _hadoop(spark: SparkSession, path: str):
    """(file system, path) of Hadoop, which reaches every store that Spark does."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Makes a file with a text in full, or not at all where it is there already: of several writers one is told True.

    The text goes to a name of its own first; then a hard link (local disks) or a rename (other stores) gives it the name, which
    both refuse where the name is taken.
    """
    store, final = _hadoop(spark, path)
    own = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = store.create(own, True)
    out.write(bytearray(text.encode()))
    out.close()
    local = final.toUri().getScheme() in (None, "file") and store.getScheme() == "file"
    try:
        if local:
            paths = [spark._jvm.java.io.File(x.toUri().getPath()).toPath() for x in (final, own)]
            try:
                spark._jvm.java.nio.file.Files.createLink(*paths)
                return True
            except Py4JJavaError as e:
                if e.java_exception.getClass().getSimpleName() != "FileAlreadyExistsException":
                    raise
                return False
        return not store.exists(final) and store.rename(own, final)
    finally:
        store.delete(own, False)


def read_text(spark: SparkSession, path: str) -> str:
    store, at = _hadoop(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def versions(spark: SparkSession, folder: str) -> list[dict]:
    """The log of a table: version, label, path and info of each commit, the oldest first."""
    store, root = _hadoop(spark, f"{folder}/_log")
    names = sorted(x.getPath().getName() for x in store.listStatus(root)) if store.exists(root) else []
    return [json.loads(read_text(spark, f"{folder}/_log/{n}")) for n in names if re.fullmatch(r"\d{9}\.json", n)]


def commit(spark: SparkSession, folder: str, version: int, path: str, label: str = "", info: dict | None = None) -> bool:
    """Makes what is at path the version of the table at folder; False where another writer was first."""
    entry = {"version": version, "label": label, "path": path, "info": info or {}}
    return create_once(spark, f"{folder}/_log/{version:09d}.json", json.dumps(entry))


def write_version(df: DataFrame, folder: str, version: int, label: str = "", info: dict | None = None) -> str:
    """A new version of a table beside the old ones: plain Parquet has no merge in place, and readers keep theirs. It counts
    once it is in the log; where that version is another writer's by then, it is an error."""
    path = f"{folder}/data-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not commit(df.sparkSession, folder, version, path, label, info):
        raise LostRace(f"version {version} of {folder} is another writer's")
    return path


class LostRace(RuntimeError):
    """Another writer has made the version that this one was about to make."""


def latest_version(spark: SparkSession, folder: str) -> tuple[int, str, str] | None:
    """(number, label, path) of the newest version."""
    found = versions(spark, folder)
    return (found[-1]["version"], found[-1]["label"], found[-1]["path"]) if found else None


def read_version(spark: SparkSession, folder: str, version: int | None = None) -> DataFrame:
    """The newest version of a table, or one by its number."""
    found = [x for x in versions(spark, folder) if version in (None, x["version"])]
    if not found:
        raise ValueError(f"{folder} has no version{'' if version is None else f' {version}'}")
    return spark.read.parquet(found[-1]["path"])


@contextlib.contextmanager
def single_flight(spark: SparkSession, folder: str, name: str, seconds: float = 4 * 3600):
    """Holds the lock of a job: of two runs at once the second is an AlreadyRunning error. A lock that is older than `seconds` belongs to
    a run that died, and is taken over by one run."""
    path, now = f"{folder}/_locks/{name}", time.time()
    mine = json.dumps({"owner": uuid.uuid4().hex, "since": now})
    if not create_once(spark, path, mine):
        try:
            held = json.loads(read_text(spark, path))
        except Py4JJavaError:  # given back meanwhile
            held = {"owner": "", "since": now}
        # whoever takes a dead run's lock over says so once, under that owner's name
        if now - held["since"] < seconds or not create_once(spark, f"{path}.after-{held['owner']}", mine):
            raise AlreadyRunning(f"{name} has been running for {now - held['since']:.0f} seconds")
        store, at = _hadoop(spark, path)
        store.delete(at, False)
        if not create_once(spark, path, mine):
            raise AlreadyRunning(f"{name} has just been started")
    try:
        yield
    finally:
        store, at = _hadoop(spark, path)
        if store.exists(at) and read_text(spark, path) == mine:
            store.delete(at, False)


class AlreadyRunning(RuntimeError):
    """A job's lock is held by another run."""


def read_or_empty(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The JSON documents at path, none where the source isn't there."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    there = at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
    return spark.read.schema(schema).json(path) if there else spark.createDataFrame([], schema)


def read_guarded(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(documents, corrupt lines): only declared fields are read, and lines that are no JSON object are set apart."""
    read = F.from_json("value", schema + ", corrupt_ string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "corrupt_"})
    rows = spark.read.text(path).filter("trim(value) <> ''").select("value", read.alias("x"))
    return rows.filter("x.corrupt_ is null").select("x.*").drop("corrupt_"), rows.filter("x.corrupt_ is not null").select(F.col("value").alias("line"))


def parse_count(text) -> Column:
    """A row count from an answer that is a number or JSON (value, d.__count, d.results or @odata.count); else null."""
    c = F.col(text) if isinstance(text, str) else text
    plain = F.regexp_extract(F.trim(c), r"^(\d+)$", 1).try_cast("long")
    return F.coalesce(plain, *[F.get_json_object(c, path).try_cast("long") for path in ("$['@odata.count']", "$.count", "$.value", "$.d.__count", "$.d")])
