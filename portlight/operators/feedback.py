"""Feedback and changes that people enter: checked, completed from the tables, and kept as new rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .reports import RATINGS


def exception_error(score="priority_score") -> Column:
    """What is wrong with a new exception, else null."""
    no = lambda c: S.first_text(c).isNull()
    return (
        F.when(no("po_number") | no("line_item"), "PO Number and Line Item required").when(no("exception_type"), "Exception Type required").when(no("priority"), "Priority required (HIGH/MEDIUM/LOW)")
        .when(~S.is_priority("priority"), "Priority must be HIGH, MEDIUM, or LOW").when(no("panel"), "Panel required (ACTION_REQUIRED/STATUS_REPORT)").when(~F.coalesce(F.col(score).between(0, 100), F.lit(True)), "Priority Score must be 0-100")
    )


def resolution_error() -> Column:
    return F.when(F.col("resolved_at").isNotNull() & S.first_text("resolution_note").isNull(), "Resolution note required when resolving exception")


def checked(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good rows, rejected rows with error)."""
    told = rows.withColumn("error", error)
    return told.filter("error is null").drop("error"), told.filter("error is not null")


def take_feedback(sent: DataFrame, exceptions: DataFrame, at: str, longest: int = 1000) -> tuple[DataFrame, DataFrame]:
    """(new feedback rows, rejects) of what was sent (exception_id, rating, comment). A row copies the exception as it is now,
    so that it stays meaningful when the exception changes; whatever was sent for those columns doesn't count."""
    copied = [c for c in ("po_number", "line_item", "exception_type", "recommendation") if c in exceptions.columns]
    snapshot = exceptions.select("exception_id", F.struct(*copied).alias("of_"))
    rows = sent.drop(*copied, "created_at").join(snapshot, "exception_id", "left")
    error = (
        F.when(F.col("exception_id").isNull(), "exception_id is required").when(~F.coalesce(F.col("rating").isin(*RATINGS), F.lit(False)), f"rating must be one of: {', '.join(RATINGS)}")
        .when(F.col("of_").isNull(), F.concat(F.lit("Exception "), F.col("exception_id").cast("string"), F.lit(" not found")))
    )
    good, bad = checked(rows, error)
    comment = S.blank_null(F.substring(F.trim("comment"), 1, longest))
    good = good.select(*[c for c in good.columns if c not in ("of_", "comment")], comment.alias("comment"), *[F.col(f"of_.{c}").alias(c) for c in copied], F.lit(at).cast("timestamp").alias("created_at"))
    return good, bad.drop("of_")


def current(feedback: DataFrame) -> DataFrame:
    """The latest feedback on each exception; the largest id of ties."""
    best = F.max_by(F.struct(*[c for c in feedback.columns if c != "exception_id"]), F.struct("created_at", "id"))
    return feedback.groupBy("exception_id").agg(best.alias("f")).select("exception_id", "f.*")


def stamp_schedule(schedules: DataFrame, ran: DataFrame, at: str) -> DataFrame:
    """Schedules with last_run_at for those that ran (id)."""
    rows = schedules.join(ran.select("id", F.lit(True).alias("ran_")).distinct(), "id", "left")
    return rows.select(*[F.when(F.col("ran_"), F.lit(at).cast("timestamp")).otherwise(F.col(c)).alias(c) if c == "last_run_at" else F.col(c) for c in schedules.columns])


def plan_message(meta: DataFrame) -> Column:
    """What a sync run is about to do: targets (joined by ' → '), total_to_sync, row_limit, page_size, date_scope, master, reconcile."""
    total = F.coalesce(F.concat(F.col("total_to_sync").cast("string"), F.lit(" record(s) across ")), F.lit("records for "))
    full = F.col("row_limit").isNull()
    scope = F.when(full, "full sync").otherwise(F.concat(F.lit("limited sync ("), F.col("row_limit").cast("string"), F.lit(" rows)")))
    detail = F.when(F.col("master"), "master data full refresh").when(S.first_text("date_scope").isNotNull(), F.concat(F.lit("PO date scope: "), "date_scope", F.lit(" (po_lines only)"))).otherwise("PO date scope: default last 30 days")
    pages = F.coalesce(F.concat(F.lit(", ~"), F.ceil(F.col("total_to_sync") / F.col("page_size")).cast("string"), F.lit(" page(s)")), F.lit(""))
    mode = F.when(full, "FULL").otherwise("LIMITED")
    return F.concat(F.lit("Syncing "), total, S.first_text("targets", F.lit("S/4 entities")), F.lit(" in batches of "), F.col("page_size").cast("string"), F.lit(" — "), scope, F.lit(", "), detail, F.lit(", mode: "), mode, pages, F.when(F.col("reconcile"), ", reconcile: on.").otherwise(", reconcile: off."))
