"""An event feed with a rolling look-back as a streaming source: `spark.readStream.format("event_feed")`.

The feed is landed by the hour of the event, hour=2024-01-05-13 and so on, lines of JSON. An offset is the hour up to which the feed was
read. A batch from one offset to the next reads the hours between them, and again those that the look-back reaches behind its start,
since events turn up late in hours that were read before. So batches overlap, what follows has to bear an event twice, and a batch
that is replayed from its offsets reads the same hours.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from .paged import _READ, _store

LOOKBACK_MINUTES = 1440
#: Bytes of files that a task reads one after the other; a larger file is a task of its own.
TASK_BYTES = 32 << 20
_HOUR = "%Y-%m-%d-%H"


@dataclass
class FeedFiles(InputPartition):
    paths: list[str]


class EventFeed(DataSource):
    """Options: path, lookbackMinutes. The schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "event_feed"

    def schema(self):
        raise ValueError("say .schema(...): events don't tell their columns' types")

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return FeedReader(self.options, schema)


class FeedReader(DataSourceStreamReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema, self.lookback = options["path"], schema, timedelta(minutes=int(options.get("lookbackMinutes", LOOKBACK_MINUTES)))

    def _hours(self) -> list[str]:
        from pyarrow import fs

        store, root = _store(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        return sorted(m[1] for x in found if (m := re.fullmatch(r"hour=(\d{4}-\d\d-\d\d-\d\d)", x.base_name)))

    def initialOffset(self) -> dict:
        return {"until": "0001-01-01-00"}

    def latestOffset(self) -> dict:
        hours = self._hours()
        return {"until": (datetime.strptime(hours[-1], _HOUR) + timedelta(hours=1)).strftime(_HOUR)} if hours else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[FeedFiles]:
        """A task for each few files of the hours in reach; none where nothing is new."""
        from pyarrow import fs

        if start["until"] == end["until"]:
            return []
        begin = datetime.strptime(start["until"], _HOUR)
        first = (begin - min(self.lookback, begin - datetime.min)).strftime(_HOUR)
        store, root = _store(self.path)
        out, size = [], 0
        for hour in (h for h in self._hours() if first <= h < end["until"]):
            files = store.get_file_info(fs.FileSelector(f"{root}/hour={hour}"))
            for x in sorted(files, key=lambda x: x.path):
                if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")):
                    if not out or size + x.size > TASK_BYTES:
                        out.append(FeedFiles([]))
                        size = 0
                    out[-1].paths.append(x.path)
                    size += x.size
        return out

    def read(self, partition: FeedFiles) -> Iterator[tuple]:
        store, _ = _store(self.path)
        readers = [(f.name, _READ.get(f.dataType.typeName(), lambda x: x)) for f in self.schema]
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rest = b""
                while data := f.read(1 << 20):
                    *lines, rest = (rest + data).split(b"\n")
                    yield from self._parsed(lines, readers)
                yield from self._parsed([rest], readers)

    @staticmethod
    def _parsed(lines: list[bytes], readers) -> Iterator[tuple]:
        for line in lines:
            if line.strip():
                row = json.loads(line)
                yield tuple(None if row.get(name) is None else to(row[name]) for name, to in readers)


def land_hours(events: DataFrame, path: str, time: str = "event_time") -> None:
    """Adds events to the hours of a feed, as lines of JSON; those without a time are left out."""
    hour = F.date_format(time, "yyyy-MM-dd-HH").alias("hour")
    row = F.to_json(F.struct(*[(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + "XXX" * (t == "timestamp")) if t.startswith("timestamp") else F.col(c).cast("string") if t.startswith("decimal") else F.col(c)).alias(c) for c, t in events.dtypes]))
    events.filter(F.col(time).isNotNull()).select(hour, row.alias("text")).repartition("hour").write.mode("append").partitionBy("hour").text(path)


def read_feed(spark: SparkSession, path: str, schema, lookback_minutes: int = LOOKBACK_MINUTES) -> DataFrame:
    spark.dataSource.register(EventFeed)
    return spark.readStream.format("event_feed").schema(schema).options(path=path, lookbackMinutes=lookback_minutes).load()
