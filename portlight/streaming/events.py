"""Structured Streaming: carrier events with ids and links of their own state, late ones kept, batches to an idempotent sink, progress."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from ..operators.merge import flag_for_analysis, merge_into, one_a_key


def read_stream(spark: SparkSession, folder: str, schema, files: int = 10) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def deduplicated(events: DataFrame, time: str = "event_time", key: str = "source_hash", late: str = "1440 minutes") -> DataFrame:
    """Each key once; state lasts as long as the look-back, later events are dropped."""
    return events.filter(f"{time} is not null").withWatermark(time, late).dropDuplicatesWithinWatermark([key])


def with_known_ids(events: DataFrame, time: str = "event_time", key: str = "source_hash", late: str = "1440 minutes", keep_minutes: int = 2880) -> DataFrame:
    """One row for each key of a batch, the smallest by all columns, with the id that the key has had since it came first, and is_new.

    A key's id is state, kept until keep_minutes after its newest event; a key that comes again later is new, but gets the same
    id, which is made of the key. Events without a time or a key are left out.
    """
    columns = [f for f in events.schema if f.name not in ("id", "is_new")]
    out = StructType([*columns]).add("id", "string").add("is_new", "boolean")
    names = [f.name for f in columns]

    def known(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best, newest = None, 0
        for frame in frames:
            newest = max(newest, int(frame[time].max().timestamp() * 1000))
            for row in frame[names].itertuples(index=False, name=None):
                rank = [(not pd.isna(x), "" if pd.isna(x) else str(x)) for x in row]
                if best is None or rank < best[0]:
                    best = (rank, row)
        id_ = state.get[0] if state.exists else k[0][:32]
        is_new = not state.exists
        until = state.get[1] if state.exists else 0
        until = max(until, newest + keep_minutes * 60_000, state.getCurrentWatermarkMs() + 1)
        state.update((id_, until))
        state.setTimeoutTimestamp(until)
        yield pd.DataFrame([[*best[1], id_, is_new]], columns=[*names, "id", "is_new"])

    rows = events.select(names).filter(F.col(time).isNotNull() & F.col(key).isNotNull()).withWatermark(time, late)
    return rows.groupBy(key).applyInPandasWithState(known, out, "id string, until long", "append", GroupStateTimeout.EventTimeTimeout)


def run(events: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, name: str | None = None):
    """Starts the stream over what is there now; sink gets (batch, number) and must bear a batch twice."""
    writer = events.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return (writer.queryName(name) if name else writer).start()


def table_sink(folder: str, keys: list[str], latest: str | None = None) -> Callable[[DataFrame, int], None]:
    """A sink that upserts each batch into the table at folder; a batch that comes twice is written once, by its number."""

    def write(batch: DataFrame, number: int) -> None:
        merge_into(batch.sparkSession, folder, batch, keys, f"batch-{number}", latest)

    return write


def events_sink(folder: str, lines: str, open_orders: DataFrame) -> Callable[[DataFrame, int], None]:
    """A sink of with_known_ids(): events go to the table at folder, with po_linked; open lines of the orders that new events belong to
    are marked for analysis in the table at `lines`. Each of the two is written once for a batch."""
    from ..sources.files import read_version

    def write(batch: DataFrame, number: int) -> None:
        from ..sources.shared import written

        spark = batch.sparkSession
        # written once: what follows reads it several times, and none of them runs the stateful operator anew
        linked = batch.join(open_orders.withColumn("linked_", F.lit(True)), "po_number", "left").withColumn("po_linked", F.coalesce("linked_", F.lit(False))).drop("linked_")
        linked = written(linked, "stream-batch")
        new = linked.filter("is_new and po_linked").select("po_number").distinct()
        merge_into(spark, folder, linked.drop("is_new"), ["source_hash"], f"batch-{number}")
        now = read_version(spark, lines)
        keys = ["po_number", "line_item"]
        marked = flag_for_analysis(now.join(new, "po_number", "left_semi"), new).select(*keys, "ai_processed", "ai_reanalysis_needed")
        merge_into(spark, lines, marked, keys, f"batch-{number}")

    return write


def late_sink(folder: str, late_folder: str, keys: list[str], time: str = "event_time", minutes: int = 1440) -> Callable[[DataFrame, int], None]:
    """A sink that loses no late event: rows whose time lies more than `minutes` before the newest time of the batches before
    go to the table at late_folder, with late_seconds and batch, the others are upserted into the table at folder.

    The newest time is written with each batch in the table's log, so a batch that comes again is split as it was. Rows without a
    time are on time: nothing says that they are late.
    """

    def write(batch: DataFrame, number: int) -> None:
        from ..sources.files import versions

        spark = batch.sparkSession
        log = [x for x in versions(spark, folder) if x["info"].get("batch", -1) < number]
        mark = max((x["info"]["newest"] for x in log if x["info"].get("newest") is not None), default=None)
        micros = F.unix_micros(F.col(time).cast("timestamp"))
        behind = F.lit(None).cast("double") if mark is None else (F.lit(mark) - minutes * 60_000_000 - micros) / 1_000_000
        split = batch.withColumn("late_seconds", F.when(behind > 0, behind)).persist()
        try:
            newest = split.agg(F.max(micros)).first()[0]
            late = split.filter("late_seconds is not null").withColumn("batch", F.lit(number).cast("long"))
            if not late.isEmpty():
                merge_into(spark, late_folder, late, [*keys, "batch"], f"batch-{number}")
            info = {"batch": number, "newest": max((x for x in (mark, newest) if x is not None), default=None)}
            merge_into(spark, folder, split.filter("late_seconds is null").drop("late_seconds"), keys, f"batch-{number}", time, info)
        finally:
            split.unpersist()

    return write


class Progress(StreamingQueryListener):
    """Notes each batch of the streams that run in a session, as rows of a run log."""

    SCHEMA = "run_id string, job_name string, batch long, started_at timestamp, rows long, milliseconds long, status string, message string"

    def __init__(self):
        self.rows: list[tuple] = []

    def onQueryStarted(self, event) -> None:
        self.rows.append((str(event.runId), event.name, None, _moment(event.timestamp), None, None, "RUNNING", "started"))

    def onQueryProgress(self, event) -> None:
        p = event.progress
        self.rows.append((str(p.runId), p.name, p.batchId, _moment(p.timestamp), p.numInputRows, p.batchDuration, "RUNNING", f"batch {p.batchId}: {p.numInputRows} rows"))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.rows.append((str(event.runId), None, None, datetime.now(timezone.utc), None, None, "ERROR" if event.exception else "SUCCESS", (event.exception or "ended").splitlines()[0][:500]))

    def entries(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.rows), self.SCHEMA)

    def runs(self, spark: SparkSession) -> DataFrame:
        """One row a run: batches, rows, milliseconds, the last status."""
        e = self.entries(spark)
        last = F.max_by("status", F.struct(F.col("status") != "RUNNING", "started_at"))
        return e.groupBy("run_id").agg(F.max("job_name").alias("job_name"), F.min("started_at").alias("started_at"), F.count("batch").alias("batches"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("milliseconds"), F.lit(0)).alias("milliseconds"), last.alias("status"))

    def save(self, spark: SparkSession, folder: str, label: str) -> DataFrame:
        """Upserts the runs into the run log at folder."""
        return merge_into(spark, folder, one_a_key(self.runs(spark), ["run_id"]), ["run_id"], label)


def _moment(text: str) -> datetime:
    return datetime.fromisoformat(text)
