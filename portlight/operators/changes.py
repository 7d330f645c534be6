"""The difference of two versions of a table as a feed of inserted, updated and deleted rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .merge import widened


def difference(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """keys, op (insert, update, delete), changed (the columns whose values differ, in order) and new's values (null where deleted).

    Each version has one row a key, without null keys. The versions meet in one join, so each is dealt once. A column that one version
    lacks counts as null in it.
    """
    old, new = widened(old, new), widened(new, old)
    columns = [c for c in new.columns if c not in keys]
    side = lambda df, name: df.select(*keys, F.struct(F.lit(True).alias("there_"), *[F.col(c) for c in columns]).alias(name))
    rows = side(old, "was_").join(side(new, "now_"), keys, "full")
    differ = F.array_compact(F.array(*[F.when(~F.col("was_")[c].eqNullSafe(F.col("now_")[c]), F.lit(c)) for c in columns])) if columns else F.array().cast("array<string>")
    op = F.when(F.col("was_").isNull(), "insert").when(F.col("now_").isNull(), "delete").when(F.size(differ) > 0, "update")
    changed = F.when(op == "update", differ).otherwise(F.array().cast("array<string>"))
    return rows.filter(op.isNotNull()).select(*keys, op.alias("op"), changed.alias("changed"), *[F.col("now_")[c].alias(c) for c in columns])


def apply_difference(old: DataFrame, feed: DataFrame, keys: list[str]) -> DataFrame:
    """The version that a feed of difference() leads to: one join, in which the feed's values replace, add or drop rows."""
    come = feed.drop("op", "changed")
    new = [c for c in come.columns if c not in keys]
    old = widened(old, come)
    both = old.join(feed.select(*keys, F.col("op").alias("op_"), *[F.col(c).alias(f"new_{c}") for c in new]), keys, "full")
    kept = both.filter("op_ is null or op_ <> 'delete'")
    return kept.select(*[F.when(F.col("op_").isNotNull(), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in old.columns])


def outcome(feed: DataFrame) -> DataFrame:
    """How many rows of a feed are of each kind."""
    return feed.groupBy("op").agg(F.count("*").alias("n"))
