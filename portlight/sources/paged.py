"""Paged collections as a Spark data source: `spark.read.format("landed_pages")`, a task for each range of pages.

A collection is a folder of pages, page=000000 and so on, each one JSON document {"value": [...]} or {"d": {"results": [...]}}, as a paged
service sends it. Where the first page tells the number of rows (@odata.count or d.__count), the last page is known and ranges
of pages are read at once; where it doesn't, pages are read in order, by one task, up to the first short one. Either way pages behind the
end, left over from an earlier and longer run, don't count.
"""

from __future__ import annotations

import json
import operator
import re
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import date, datetime
from decimal import Decimal

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from ..operators.merge import assign_ids

PAGE_SIZE, PAGES_A_TASK = 1000, 16

_TESTS = {EqualTo: operator.eq, GreaterThan: operator.gt, GreaterThanOrEqual: operator.ge, LessThan: operator.lt, LessThanOrEqual: operator.le, In: lambda x, values: x in values}
_READ = {
    "string": lambda x: x if isinstance(x, str) else json.dumps(x), "long": int, "integer": int, "double": float, "float": float, "boolean": bool, "decimal": lambda x: Decimal(str(x)),
    "timestamp": datetime.fromisoformat, "timestamp_ntz": lambda x: datetime.fromisoformat(x).replace(tzinfo=None), "date": lambda x: date.fromisoformat(x[:10]),
}


def _store(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if re.match(r"\w+:", path) else f"file://{path}")


def _page(store, root: str, number: int) -> dict | None:
    """The JSON of a page; None where there is no such page."""
    from pyarrow import fs

    found = store.get_file_info(fs.FileSelector(f"{root}/page={number:06d}", allow_not_found=True))
    files = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
    if not files:
        return None
    with store.open_input_stream(files[0]) as f:
        return json.loads(f.read())


def _rows(page: dict) -> list[dict]:
    d = page.get("d", page)
    return d if isinstance(d, list) else d.get("results", d.get("value", []))


def _count(page: dict) -> int | None:
    d = page.get("d") if isinstance(page.get("d"), dict) else {}
    n = page.get("@odata.count", d.get("__count"))
    return None if n is None else int(n)


@dataclass
class PageRange(InputPartition):
    first: int
    last: int | None  # the one behind; None is up to the end


class LandedPages(DataSource):
    """Options: path, pageSize, rowCap (0 is none), pagesPerTask. The schema is the reader's."""

    @classmethod
    def name(cls) -> str:
        return "landed_pages"

    def schema(self):
        raise ValueError("say .schema(...): pages don't tell their columns' types")

    def reader(self, schema: StructType) -> DataSourceReader:
        return PageReader(self.options, schema)


class PageReader(DataSourceReader):
    def __init__(self, options, schema: StructType):
        self.path, self.schema = options["path"], schema
        self.page_size, self.cap, self.per_task = int(options.get("pageSize", PAGE_SIZE)), int(options.get("rowCap", 0)), int(options.get("pagesPerTask", PAGES_A_TASK))
        self.filters: list = []

    def pushFilters(self, filters):
        """Comparisons of whole columns of texts, whole numbers and yes-or-no are done while pages are read; Spark does the others."""
        plain = {f.name for f in self.schema if f.dataType.typeName() in ("string", "long", "integer", "boolean")}
        for f in filters:
            attribute = getattr(f, "attribute", ())
            if len(attribute) == 1 and attribute[0] in plain and (type(f) in _TESTS or isinstance(f, IsNotNull)):
                self.filters.append((attribute[0], _TESTS.get(type(f)), getattr(f, "value", None)))
            else:
                yield f

    def partitions(self) -> list[PageRange]:
        store, root = _store(self.path)
        first = _page(store, root, 0)
        if first is None:
            return [PageRange(0, 0)]
        n = _count(first)
        if n is None:
            return [PageRange(0, None if not self.cap else -(-self.cap // self.page_size))]
        pages = -(-(min(n, self.cap) if self.cap else n) // self.page_size)
        return [PageRange(at, min(pages, at + self.per_task)) for at in range(0, pages, self.per_task)] or [PageRange(0, 0)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        store, root = _store(self.path)
        readers = [(f.name, _READ.get(f.dataType.typeName(), lambda x: x)) for f in self.schema]
        number = partition.first
        while partition.last is None or number < partition.last:
            page = _page(store, root, number)
            if page is None:
                return
            rows = _rows(page)
            left = self.cap - number * self.page_size if self.cap else len(rows)
            for row in rows[:left]:
                out = tuple(None if row.get(name) is None else to(row[name]) for name, to in readers)
                by_name = dict(zip(self.schema.names, out, strict=True))
                if all(by_name[name] is not None and (test is None or test(by_name[name], value)) for name, test, value in self.filters):
                    yield out
            if len(rows) < self.page_size:  # the last page of all
                return
            number += 1


def read_landed(spark: SparkSession, path: str, schema, page_size: int = PAGE_SIZE, row_cap: int = 0, pages_per_task: int = PAGES_A_TASK) -> DataFrame:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(LandedPages)
    return spark.read.format("landed_pages").schema(schema).options(path=path, pageSize=page_size, rowCap=row_cap, pagesPerTask=pages_per_task).load()


def land_pages(rows: DataFrame, path: str, order: list[str], page_size: int = PAGE_SIZE, with_count: bool = True) -> None:
    """Writes rows as pages of page_size below path, in the order of columns that tell all rows apart. A page is gathered by its
    number, and no task holds more than its pages."""
    numbered = assign_ids(rows, order)
    one = F.struct(*[(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS" + "XXX" * (t == "timestamp")) if t.startswith("timestamp") else F.col(c).cast("string") if t.startswith("decimal") else F.col(c)).alias(c) for c, t in rows.dtypes])
    pages = numbered.groupBy(F.format_string("%06d", ((F.col("new_id") - 1) / page_size).cast("long")).alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("new_id", one.alias("row")))), lambda x: x["row"]).alias("value"))
    total = F.lit(rows.count()) if with_count else F.lit(None).cast("long")
    pages.select("page", F.to_json(F.struct(total.alias("@odata.count"), "value")).alias("text")).write.mode("append").partitionBy("page").text(path)
