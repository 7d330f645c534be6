"""Ad-hoc queries: filters, like, linked semi-joins, order and limit over a catalogue of tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ROWS = 25
OPERATORS = {
    "=": lambda c, v: c == v, "!=": lambda c, v: c != v, "<>": lambda c, v: c != v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, ">=": lambda c, v: c >= v, "<=": lambda c, v: c <= v,
    "in": lambda c, v: c.isin(list(v)), "not in": lambda c, v: ~c.isin(list(v)), "is null": lambda c, v: c.isNull(), "is not null": lambda c, v: c.isNotNull(), "like": lambda c, v: c.ilike(v),
}
NAMES = {"eq": "=", "ne": "!=", "neq": "!=", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


@dataclass
class Query:
    """from_: table. where: column to value, list, None or {operator, value}. like: column to text that it contains, whatever
    the case. linked: (table, {own column: other column}, where) that a row must have a match in. order_by: 'column [desc]'."""

    from_: str
    select: list[str] = field(default_factory=list)
    where: dict = field(default_factory=dict)
    like: dict = field(default_factory=dict)
    linked: tuple | None = None
    order_by: str | None = None
    limit: int | None = MAX_ROWS
    offset: int = 0


def _known(df: DataFrame, columns, label: str) -> None:
    if unknown := sorted(set(columns) - set(df.columns)):
        raise ValueError(f"unknown {label} column {', '.join(unknown)}; there are {', '.join(sorted(df.columns))}")


def condition(column: str, value) -> Column | None:
    c = F.col(column)
    if value is None:
        return c.isNull()
    if value == "":
        return None
    if isinstance(value, (list, tuple)):
        return c.isin(list(value))
    if isinstance(value, dict):
        op = str(value.get("operator", "")).strip().lower() if "operator" in value else next(iter(value))
        op = NAMES.get(op, op)
        if op not in OPERATORS:
            raise ValueError(f"unknown operator {op}")
        return OPERATORS[op](c, value.get("value") if "operator" in value else next(iter(value.values())))
    return c == value


def filtered(df: DataFrame, where: dict, like: dict | None = None) -> DataFrame:
    _known(df, where, "where")
    _known(df, like or {}, "like")
    for column, value in where.items():
        if (test := condition(column, value)) is not None:
            df = df.filter(test)
    for column, text in (like or {}).items():
        df = df.filter(F.col(column).ilike(f"%{str(text).strip()}%"))
    return df


def matching(catalogue, q: Query) -> DataFrame:
    """All rows that the filters of a query admit."""
    df = filtered(getattr(catalogue, q.from_), q.where, q.like)
    if q.linked:
        name, keys, where = q.linked
        other = filtered(getattr(catalogue, name), where).select(*[F.col(theirs).alias(f"linked_{ours}") for ours, theirs in keys.items()]).distinct()
        test = None
        for ours in keys:
            one = F.col(ours) == F.col(f"linked_{ours}")
            test = one if test is None else test & one
        df = df.join(other, test, "left_semi")
    return df


def query(catalogue, q: Query) -> DataFrame:
    """The rows of a query, MAX_ROWS at most where it has a limit (result() tells how many there are in all); unknown columns
    in select are left out, in filters they are errors."""
    df = matching(catalogue, q)
    if q.order_by:
        column, _, way = q.order_by.strip().partition(" ")
        _known(df, [column], "order")
        df = df.orderBy(F.desc_nulls_last(column) if way.strip().lower() == "desc" else F.asc_nulls_first(column), *[c for c in df.columns if c != column])
    if q.offset:
        df = df.offset(q.offset)
    if q.limit is not None:
        df = df.limit(max(1, min(q.limit, MAX_ROWS)))
    return df.select(*[c for c in q.select if c in df.columns] or df.columns)


def count(catalogue, q: Query) -> DataFrame:
    return matching(catalogue, q).agg(F.count("*").alias("total"))


def result(catalogue, q: Query) -> DataFrame:
    """One row: how many rows match, how many are returned, whether that is fewer, and the rows as a JSON array."""
    rows = query(catalogue, q)
    packed = rows.agg(F.count("*").alias("returned"), F.to_json(F.array_sort(F.collect_list(F.struct(*rows.columns)))).alias("rows"))  # MAX_ROWS at most
    out = count(catalogue, q).crossJoin(packed)  # one row each
    return out.select(F.lit(q.from_).alias("from"), "total", "returned", (F.col("total") > F.col("returned")).alias("truncated"), "rows")


def catalogue_rows(spark, frames: dict[str, DataFrame]) -> DataFrame:
    """table_name, column_name, kind of a catalogue's tables, for prompts and checks of uploads."""
    return spark.createDataFrame([(name, c, t) for name, df in frames.items() for c, t in df.dtypes], "table_name string, column_name string, kind string")


def upload_meta(frames: dict[str, DataFrame], keys: dict[str, list[str]], read_only: bool = True) -> DataFrame:
    """table_name, column_name, kind, is_key, read_only, filled, rows of each column of a catalogue's tables, for forms that upload
    into them: tables are read-only unless told otherwise. filled counts the rows that have a value; a table is read once."""
    out = None
    for name, df in frames.items():
        counts = df.agg(F.count("*").alias("rows_"), *[F.count(F.col(c)).alias(c) for c in df.columns])
        one = lambda c, kind: F.struct(F.lit(c).alias("column_name"), F.lit(kind).alias("kind"), F.lit(c in keys.get(name, [])).alias("is_key"), F.col(c).alias("filled"))  # noqa: B023, E731
        rows = counts.select(F.lit(name).alias("table_name"), F.col("rows_").alias("rows"), F.explode(F.array(*[one(c, t) for c, t in df.dtypes])).alias("x"))
        rows = rows.select("table_name", "x.column_name", "x.kind", "x.is_key", F.lit(read_only).alias("read_only"), "x.filled", "rows")
        out = rows if out is None else out.unionByName(rows)
    return out
