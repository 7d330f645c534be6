"""Keyed merges on versions of a table: upsert plans with change detection, sweeps of what a run hasn't seen, deletes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relational import newest_first, stale

#: Columns of an order line that come from the source and are compared, those whose old value stays when none
#: comes, and those of a document error that are compared. Columns that a table lacks are left out.
COMPARED = [
    "material_id", "plant", "material_group", "po_qty", "po_uom", "net_price", "supplier_id", "doc_type", "currency", "doc_date", "created_on", "created_by", "company_code", "purch_group", "delivery_date", "ship_date",
    "is_intracompany_transfer",
]
KEPT_WHEN_EMPTY = ["po_uom", "currency", "created_by", "ship_date"]
DOCUMENT_COMPARED = ["status", "status_text", "error_msg", "bill_of_lading", "status_group", "status_logdat"]
QUANTITIES = ["open_qty", "received_qty_so_far", "gr_qty"]
#: A plan's quantities and their names in S.open_quantities.
PLANNED = {"open_qty": "open", "received_qty_so_far": "received", "gr_qty": "posted"}
#: Analysis flags of a document error and their values after a change.
DOCUMENT_FLAGS = {"ai_processed": ("boolean", False), "ai_processed_at": ("timestamp", None), "exception_type_hint": ("string", None), "ict_exception_id": ("long", None)}


def compared(*frames: DataFrame) -> list[str]:
    return [c for c in COMPARED if all(c in f.columns for f in frames)]


def comparable(c: str, kind: str):
    """A column as it is compared: '' is null, no value of a yes-or-no column is no."""
    return F.coalesce(F.col(c), F.lit(False)) if kind == "boolean" else S.blank_null(c) if kind == "string" else F.col(c)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """The next version of existing: incoming rows replace or join it by key; columns that incoming lacks keep their values.

    incoming has one row a key.
    """
    new = [c for c in incoming.columns if c not in keys]
    right = incoming.select(*keys, *[F.col(c).alias(f"new_{c}") for c in new], F.lit(True).alias("is_new_"))
    both = existing.join(right, keys, "full")
    out = [c if c in keys else F.when(F.col("is_new_"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in existing.columns]
    return both.select(*out)


def line_plan(existing: DataFrame, incoming: DataFrame, quantities: DataFrame) -> DataFrame:
    """What becomes of each incoming order line: op skip (no delivery date), insert, touch (no change in the source's
    columns) or update, its quantities, and whether it has to be analysed again."""
    keys, columns = ["po_number", "line_item"], compared(existing, incoming)
    old = existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in (*columns, *QUANTITIES, "ai_processed", "ai_processed_at")], F.lit(True).alias("known_"))
    rows = incoming.join(old, keys, "left").join(quantities.select(*keys, "received", "posted"), keys, "left")
    return _decided(rows, columns, dict(existing.dtypes)).select(*keys, *columns, "op", "again", *[F.col(f"q.{q}").alias(c) for c, q in PLANNED.items()])


def _decided(rows: DataFrame, columns: list[str], kinds: dict[str, str]) -> DataFrame:
    """Incoming rows beside old_ columns, known_, received and posted, with kept values filled in, q, op and again."""
    for c in KEPT_WHEN_EMPTY:
        if c in columns:
            rows = rows.withColumn(c, F.coalesce(S.blank_null(c) if kinds[c] == "string" else F.col(c), F.col(f"old_{c}")))
    rows = rows.withColumn("q", S.open_quantities("po_qty", "received", "posted", "open_qty", "old_received_qty_so_far", "old_gr_qty"))
    changed = S.differs([(comparable(c, kinds[c]), comparable(f"old_{c}", kinds[c])) for c in columns])
    moved = (S.quantity("old_open_qty") != F.col("q.open")) | (S.quantity("old_received_qty_so_far") != F.col("q.received")) | (S.quantity("old_gr_qty") != F.col("q.posted"))
    known = F.coalesce("known_", F.lit(False))
    op = F.when(F.col("delivery_date").isNull(), "skip").when(~known, "insert").when(changed, "update").otherwise("touch")
    again = known & F.col("delivery_date").isNotNull() & (changed | moved) & (S.is_true("old_ai_processed") | F.col("old_ai_processed_at").isNotNull())
    return rows.withColumn("op", op).withColumn("again", again)


def apply_line_plan(existing: DataFrame, plan: DataFrame, run_time: str) -> DataFrame:
    """existing after the plan: planned lines are OPEN and stamped with run_time, touched ones keep what the source sends,
    others keep their stamp. The result can be planned and merged again."""
    keys, columns = ["po_number", "line_item"], compared(existing, plan)
    p = plan.filter("op <> 'skip'").select(*keys, *[F.col(c).alias(f"new_{c}") for c in plan.columns if c not in keys])
    existing = _stamped(existing)
    return existing.join(p, keys, "full").select(*_after_plan(existing.columns, columns, run_time, F.col("new_op").isNotNull()))


def _stamped(existing: DataFrame) -> DataFrame:
    return existing if "last_synced_at" in existing.columns else existing.withColumn("last_synced_at", F.lit(None).cast("timestamp"))


def _after_plan(names: list[str], columns: list[str], run_time: str, planned: Column) -> list[Column]:
    """The columns `names` of lines beside their plan's, which begin with new_."""
    inserted = F.col("new_op") == "insert"
    values = {c: F.when(F.col("new_op").isin("insert", "update"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in columns}
    values |= {c: F.when(planned, F.col(f"new_{c}")).otherwise(F.col(c)) for c in QUANTITIES}
    values |= {
        "po_status": F.when(planned, "OPEN").otherwise(F.col("po_status")), "ai_processed": F.when(inserted | F.col("new_again"), False).otherwise(F.col("ai_processed")),
        "ai_reanalysis_needed": F.when(F.col("new_again"), True).otherwise(F.col("ai_reanalysis_needed")), "last_synced_at": F.when(planned, F.lit(run_time).cast("timestamp")).otherwise(F.col("last_synced_at")),
    }
    return [values[c].alias(c) if c in values else F.col(c) for c in names]


def merge_lines(existing: DataFrame, incoming: DataFrame, quantities: DataFrame, run_time: str) -> DataFrame:
    """What apply_line_plan makes of line_plan, for versions of one row a key: planned where incoming and existing lines meet, so that
    each is dealt once. Status and stamp need none of the compared columns: those aren't dealt where nothing else is asked for."""
    keys, columns, kinds = ["po_number", "line_item"], compared(existing, incoming), dict(existing.dtypes)
    existing = _stamped(existing)
    rest = [c for c in existing.columns if c not in keys]
    come = incoming.select(*keys, *columns, "open_qty").join(quantities.select(*keys, "received", "posted"), keys, "left").withColumn("come_", F.lit(True))
    both = come.join(existing.select(*keys, *[F.col(c).alias(f"old_{c}") for c in rest], F.lit(True).alias("known_")), keys, "full")
    planned = F.col("come_").isNotNull() & F.col("delivery_date").isNotNull()  # op is not skip
    rows = _decided(both, columns, kinds).withColumn("planned_", planned).filter(F.col("known_").isNotNull() | F.col("planned_"))
    new = {c: F.col(c) for c in (*columns, "op", "again")} | {c: F.col(f"q.{q}") for c, q in PLANNED.items()}
    rows = rows.select(*keys, "planned_", *[F.when(F.col("planned_"), v).alias(f"new_{c}") for c, v in new.items()], *[F.col(f"old_{c}").alias(c) for c in rest])
    return rows.select(*_after_plan(existing.columns, columns, run_time, F.col("planned_")))


def document_plan(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Incoming document errors with op insert, unchanged (analysis flags stay) or update (flags are reset)."""
    keys = ["docnum", "po_number", "line_item"]
    rows = incoming.withColumn("status_group", S.document_group("status"))
    old = existing.withColumn("status_group", S.document_group("status"))
    same = [c for c in DOCUMENT_COMPARED if c in rows.columns and c in old.columns]
    flags = [c for c in DOCUMENT_FLAGS if c in old.columns]
    rows = rows.drop(*flags).join(old.select(*keys, *[F.col(c).alias(f"old_{c}") for c in (*same, *flags)], F.lit(True).alias("known_")), keys, "left")
    op = F.when(F.col("known_").isNull(), "insert").when(S.differs([(c, f"old_{c}") for c in same]), "update").otherwise("unchanged")
    rows = rows.withColumn("op", op)
    kept = [F.when(F.col("op") == "unchanged", F.col(f"old_{c}")).otherwise(F.lit(DOCUMENT_FLAGS[c][1]).cast(DOCUMENT_FLAGS[c][0])).alias(c) for c in flags]
    return rows.select(*[c for c in incoming.columns if c not in ("status_group", *flags)], "status_group", *kept, "op")


def source_hash(columns: list[str]):
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]), 256)


def event_upsert(existing: DataFrame, incoming: DataFrame, open_orders: DataFrame) -> DataFrame:
    """Incoming events, the first of each source_hash, with the id that the hash already has, and whether they are new and
    belong to an open order."""
    first = newest_first(incoming, ["source_hash"], [F.asc("id")]).drop("rank_")
    known = existing.groupBy("source_hash").agg(F.min("id").alias("known_id"))
    rows = first.join(known, "source_hash", "left").join(open_orders.select("po_number", F.lit(True).alias("linked_")), "po_number", "left")
    return rows.select(F.coalesce("known_id", "id").alias("id"), "po_number", "source_hash", F.col("known_id").isNull().alias("is_new"), F.coalesce("linked_", F.lit(False)).alias("po_linked"))


def flag_for_analysis(lines: DataFrame, orders: DataFrame) -> DataFrame:
    """Open, already analysed lines of the orders are marked for analysis."""
    rows = lines.join(orders.select("po_number", F.lit(True).alias("hit_")).distinct(), "po_number", "left")
    due = F.coalesce("hit_", F.lit(False)) & (F.col("po_status") == "OPEN") & (F.col("ai_processed") | F.col("ai_processed_at").isNotNull())
    return rows.withColumn("ai_reanalysis_needed", F.when(due, True).otherwise(F.col("ai_reanalysis_needed"))).withColumn("ai_processed", F.when(due, False).otherwise(F.col("ai_processed"))).select(lines.columns)


def refresh_quantities(lines: DataFrame, quantities: DataFrame) -> DataFrame:
    """Open lines whose delivered quantities have changed, with the new ones."""
    rows = lines.filter("po_status = 'OPEN'").join(quantities, ["po_number", "line_item"]).withColumn("q", S.open_quantities("po_qty", "received", "posted", "open_qty", "received_qty_so_far", "gr_qty"))
    moved = (S.quantity("open_qty") != F.col("q.open")) | (S.quantity("received_qty_so_far") != F.col("q.received")) | (S.quantity("gr_qty") != F.col("q.posted"))
    again = F.col("ai_processed") | F.col("ai_processed_at").isNotNull()
    return rows.filter(moved).select("po_number", "line_item", F.col("q.open").alias("open_qty"), F.col("q.received").alias("received_qty_so_far"), F.col("q.posted").alias("gr_qty"), again.alias("again"))


def close_stale_lines(lines: DataFrame, exceptions: DataFrame, run_time: str) -> tuple[DataFrame, DataFrame]:
    """(lines, exceptions): open lines that the run hasn't seen are closed, and their exceptions go."""
    old = (F.col("po_status") == "OPEN") & stale("last_synced_at", run_time)
    closed = lines.filter(old).select("po_number", "line_item")
    return lines.withColumn("po_status", F.when(old, "CLOSED").otherwise(F.col("po_status"))), exceptions.join(closed, ["po_number", "line_item"], "left_anti")


def deactivate_stale(rows: DataFrame, run_time: str) -> DataFrame:
    return rows.withColumn("is_active", F.col("is_active") & ~stale("last_synced_at", run_time))


def delete_stale_in_scope(rows: DataFrame, column: str, scope: DataFrame, run_time: str) -> DataFrame:
    """rows without those that the run hasn't seen and whose order is in scope."""
    marked = rows.join(scope.select(F.col(scope.columns[0]).alias(column), F.lit(True).alias("scoped_")).distinct(), column, "left")
    return marked.filter(~(F.coalesce("scoped_", F.lit(False)) & stale("last_synced_at", run_time))).select(rows.columns)


def delete_rows(rows: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows without the keys, keys that no row has)."""
    on = keys.columns
    return rows.join(keys, on, "left_anti"), keys.join(rows, on, "left_anti")


def validate_upload(cells: DataFrame, kinds: dict[str, str], keys: list[str], existing: DataFrame, update: bool = False, alternate: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) of uploaded text rows (row_idx and columns by kind: string, long, double, boolean, timestamp).

    Each value is read by its kind; keys are required; columns that are no kind's are errors where they hold a value; of rows
    that are valid so far a key's second is an error. A key that exists is an error too, and so is a value of the column `alternate`
    that an existing row has, unless update is set: then both are updates, the second under the existing row's key, and rows tell by
    is_update.
    """
    typed = {c: (F.lit(None), F.when(S.blank_null(F.trim(c)).isNotNull(), F.lit(f"{c}: unknown column"))) for c in cells.columns if c != "row_idx" and c not in kinds}
    for c, kind in kinds.items():
        text = S.blank_null(F.trim(c))
        if kind == "long":
            value = S.leading_number(text).cast("long")
        elif kind == "double":
            value = S.leading_number(text)
        elif kind == "boolean":
            low = F.lower(text)
            value = F.when(low.isin("true", "1", "x", "yes", "y"), True).when(low.isin("false", "0", "no", "n"), False)
        elif kind == "timestamp":
            value = S.timestamp(text)
        else:
            value = text
        bad = F.when(text.isNotNull() & value.isNull(), F.lit(f"{c}: not a {kind}")).when(F.lit(c in keys) & text.isNull(), F.lit(f"{c}: required"))
        typed[c] = (value, bad)
    rows = cells.select("row_idx", *[v.alias(c) for c, (v, _) in typed.items() if c in kinds], F.array_compact(F.array(*[e for _, e in typed.values()])).alias("errors_"))
    bad = rows.filter(F.size("errors_") > 0).select("row_idx", F.explode("errors_").alias("error"))
    good = newest_first(rows.filter(F.size("errors_") == 0), keys, [F.asc("row_idx")], 1 << 30)
    twice = good.filter("rank_ > 1").select("row_idx", F.lit("key repeats in the upload").alias("error"))
    single = good.filter("rank_ = 1").drop("rank_", "errors_")
    if alternate or update:
        return _placed(single, bad.unionByName(twice), keys, existing, update, alternate)
    there = single.join(existing.select(*keys), keys, "left_semi").select("row_idx", F.lit("key exists").alias("error"))
    return single.join(existing.select(*keys), keys, "left_anti"), bad.unionByName(twice).unionByName(there)


def _placed(rows: DataFrame, errors: DataFrame, keys: list[str], existing: DataFrame, update: bool, alternate: str | None) -> tuple[DataFrame, DataFrame]:
    """(rows, errors) by what exists under a row's key, or under its alternate value."""
    columns = rows.columns
    rows = rows.join(existing.select(*keys, F.lit(True).alias("there_")).distinct(), keys, "left")
    if alternate:
        other = existing.filter(F.col(alternate).isNotNull()).groupBy(F.col(alternate).alias("alternate_")).agg(F.min(F.struct(*keys)).alias("other_"))
        rows = rows.join(other, F.col(alternate) == F.col("alternate_"), "left").drop("alternate_")
    else:
        rows = rows.withColumn("other_", F.lit(None).cast("struct<" + ",".join(f"{k}:string" for k in keys) + ">"))
    there, other = F.col("there_").isNotNull(), F.col("other_").isNotNull()
    if update:
        values = {k: F.when(other, F.col("other_")[k].cast(rows.schema[k].dataType)).otherwise(F.col(k)).alias(k) for k in keys}
        return rows.select(*[values.get(c, F.col(c)) for c in columns], (there | other).alias("is_update")), errors
    why = F.when(there, F.lit("key exists")).when(other, F.lit(f"{alternate} exists"))
    return rows.filter(~there & ~other).select(columns), errors.unionByName(rows.filter(there | other).select("row_idx", why.alias("error")))


def upload_outcome(n_rows: DataFrame, good: DataFrame, bad: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """One row: uploaded, inserted, updated, failed rows and a label: success, partial or failed."""
    failed = bad.select("row_idx").distinct().agg(F.count("*").alias("failed"))
    there = good.join(existing.select(*keys, F.lit(True).alias("there_")).distinct(), keys, "left").agg(F.count("*").alias("written"), F.count("there_").alias("updated"))
    one = n_rows.agg(F.count("*").alias("uploaded")).crossJoin(there).crossJoin(failed)  # one row each
    label = F.when(F.col("failed") == 0, "success").when(F.col("written") == 0, "failed").otherwise("partial")
    return one.select("uploaded", (F.col("written") - F.col("updated")).alias("inserted"), "updated", "failed", label.alias("outcome"))


def use_alternate_key(cells: DataFrame, existing: DataFrame, key: str, alternate: str) -> DataFrame:
    """Uploaded rows without key take that of the existing row with the same alternate key."""
    known = existing.filter(F.col(alternate).isNotNull()).groupBy(F.col(alternate).alias("alternate_")).agg(F.min(key).cast("string").alias("known_"))
    rows = cells.join(known, F.trim(alternate) == F.col("alternate_"), "left")
    return rows.withColumn(key, F.coalesce(S.blank_null(F.trim(key)), F.col("known_"))).select(cells.columns)


def one_a_key(rows: DataFrame, keys: list[str], latest: str | None = None) -> DataFrame:
    """One row for each key: of repeated ones that with the latest value of a column, else the smallest by all columns."""
    rest = [c for c in rows.columns if c not in keys]
    row = F.struct(*rest)
    best = F.min(row) if latest is None else F.max_by(row, F.struct(F.col(latest), F.hash(*rest)))
    return rows.groupBy(*keys).agg(best.alias("r_")).select(*keys, "r_.*").select(rows.columns)


def widened(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """existing with the columns that incoming brings for the first time."""
    return existing.withColumns({c: F.lit(None).cast(t) for c, t in incoming.dtypes if c not in existing.columns})


def merge_into(spark, folder: str, incoming: DataFrame, keys: list[str], label: str, latest: str | None = None, info=None, attempts: int = 20) -> DataFrame:
    """Upserts incoming into the table at folder and returns its newest version, which lies beside the old ones.

    A label that any version has was merged before, so a repeated run or batch writes nothing. Of rows with one key in incoming one
    counts (one_a_key). Columns that are new with incoming are null in other rows. Where another writer commits first, the merge is
    made anew on that writer's version: no commit is lost. info (a dict, or a function of the last version's info) goes to the log.
    """
    from ..sources.files import LostRace, read_version, versions, write_version

    rows = one_a_key(incoming, keys, latest)
    for _ in range(attempts):
        log = versions(spark, folder)
        if any(x["label"] == label for x in log):
            return read_version(spark, folder)
        newest = log[-1] if log else {"version": 0, "info": {}}
        out = upsert(widened(spark.read.parquet(newest["path"]), rows), rows, keys) if log else rows
        try:
            return spark.read.parquet(write_version(out, folder, newest["version"] + 1, label, info(newest["info"]) if callable(info) else info))
        except LostRace:
            continue
    raise LostRace(f"{attempts} other writers were first at {folder}")


def log_upsert(logs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Run logs (run_id, status) after incoming ones; a RUNNING that comes late never replaces a finished run."""
    ended = logs.filter(S.run_status("status").isin("SUCCESS", "FAILURE", "ERROR")).select("run_id")
    late = incoming.filter("status = 'RUNNING'").join(ended, "run_id", "left_semi").select("run_id")
    return upsert(logs, incoming.join(late, "run_id", "left_anti"), ["run_id"])


def assign_ids(rows: DataFrame, order: list[str], after: int = 0, splits: int = 63) -> DataFrame:
    """Adds new_id, numbering rows from after + 1 in the order of the columns (distinct, not null).

    Rows are dealt to ranges between a few of their own keys, chosen by hash; each range numbers its rows, and the sizes of
    the ranges before it are added. So no task orders all rows, and the numbers don't depend on the choice.
    """
    key = F.struct(*order)
    picked = rows.select(*order).orderBy(F.xxhash64(*order), *order).limit(splits).collect()
    bounds = F.array(*[F.struct(*[F.lit(x).cast(rows.schema[c].dataType).alias(c) for c, x in zip(order, r, strict=True)]) for r in picked]) if picked else None
    ranged = rows.withColumn("range_", F.size(F.filter(bounds, lambda b: b <= key)) if picked else F.lit(0))
    sizes = ranged.groupBy("range_").agg(F.count("*").alias("n"))
    before = sizes.select("range_", F.coalesce(F.sum("n").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))  # splits + 1 rows
    numbered = ranged.withColumn("place_", F.row_number().over(Window.partitionBy("range_").orderBy(*order)))
    return numbered.join(F.broadcast(before), "range_").withColumn("new_id", F.lit(after) + F.col("before_") + F.col("place_")).drop("range_", "before_", "place_")
