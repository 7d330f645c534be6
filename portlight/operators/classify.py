"""Eligibility decision tree and classification records."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .merge import DOCUMENT_FLAGS, assign_ids, upsert
from .relational import ACTIVE, asn_summary, dedupe_carrier_events, eligible_orders, latest_carrier_event, newest_first, top_errors

#: Notes of the decision tree and the outcomes (panel, priority, score, type).
NOT_ELIGIBLE, AWAITING = "Partner not eligible for AI review", "Awaiting shipment signals"
GAPS = ["No ASN on file", "No EDI856 IDoc records on file", "No carrier tracking on file"]
ACTION = ("ACTION_REQUIRED", "HIGH", 1, "AWAITING_SHIPMENT_SIGNALS")
REPORT = ("STATUS_REPORT", "LOW", 9, "PENDING_ELIGIBILITY")


def enriched_lines(lines: DataFrame, t, functions: list[str], suppliers: list[str], buckets: int | None = None) -> DataFrame:
    """Lines with their delivery summary, supplier, material, plant, latest carrier event, number of document errors that
    concern the line, partner eligibility and latest exception. Each many-side is reduced before it is joined.

    Names come first, as they take the place of keys. Then everything is dealt by order, and lines once only: what belongs to
    a line is joined before what belongs to its order, so that one sort serves all. Tables that lie in buckets of the order
    (layout.co_located) stay where they are where `buckets` tells how many.
    """
    dealt = lambda df, key: df.repartition(buckets, key) if buckets else df.repartition(key)
    # keys of a join may be more than those by which its sides are dealt
    lines.sparkSession.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    rows = lines.join(t.suppliers.select(F.col("supplier").alias("supplier_id"), supplier_name().alias("supplier_name")), "supplier_id", "left")
    rows = rows.join(t.materials.select(F.col("material").alias("material_id"), "material_description"), "material_id", "left")
    rows = dealt(rows, "po_number")
    rows = rows.join(asn_summary(dealt(t.asn_ibd, "reference_document")), ["po_number", "line_item"], "left")
    # an error without a line concerns every line of its order
    errors = dealt(t.idoc_errors.select("po_number", F.coalesce(S.line_item("line_item"), F.lit("")).alias("error_line")), "po_number").groupBy("po_number", "error_line").agg(F.count("*").alias("n"))
    of_order = errors.filter("error_line = ''").select("po_number", F.col("n").alias("n_order"))
    of_line = errors.filter("error_line <> ''").select("po_number", F.col("error_line").alias("line_item"), F.col("n").alias("n_line"))
    last = newest_first(dealt(t.exceptions.select("po_number", "line_item", "exception_id"), "po_number"), ["po_number", "line_item"], [F.desc("exception_id")]).drop("rank_")
    rows = rows.join(of_line, ["po_number", "line_item"], "left").join(last, ["po_number", "line_item"], "left").join(of_order, "po_number", "left")
    rows = rows.withColumn("n_errors", F.coalesce("n_order", F.lit(0)) + F.coalesce("n_line", F.lit(0))).drop("n_order", "n_line")
    latest = latest_carrier_event(t.carrier_events).select("po_number", S.first_text("event_type", "status").alias("carrier_status"))
    rows = rows.join(latest, "po_number", "left")
    rows = rows.join(eligible_orders(t.po_partners, functions, suppliers).withColumn("eligible", F.lit(True)), "po_number", "left").withColumn("eligible", F.coalesce("eligible", F.lit(False)))
    return rows.join(t.plants.select(F.col("plant_code").alias("plant"), "plant_name"), "plant", "left")


def supplier_name() -> Column:
    both = F.concat_ws(" ", S.blank_null(F.trim("name")), S.blank_null(F.trim("name_2")))
    return F.coalesce(S.blank_null(both), F.concat(F.lit("Supplier "), "supplier"), F.lit("NO_DATA_FOUND"))


def supplier_address() -> Column:
    """Street, city, region and postal code, as far as there are any."""
    return F.coalesce(S.blank_null(F.concat_ws(", ", *[S.blank_null(F.trim(c)) for c in ("street", "city", "region", "postal_code")])), F.lit("NO_DATA_FOUND"))


def with_notes(rows: DataFrame, as_of: str, window_days: int = 7) -> DataFrame:
    """Adds notes, what keeps a line from review: a delivery beyond the window; else an ineligible partner; else no signal."""
    days = F.datediff(F.to_date("delivery_date"), F.lit(as_of).cast("date"))
    signal = F.col("delivery").isNotNull() | (F.col("n_errors") > 0) | F.col("carrier_status").isNotNull()
    beyond = F.array(F.concat(F.lit("Delivery in "), days.cast("string"), F.lit(" days — outside review window")))
    none = F.array().cast("array<string>")
    notes = (
        F.when(days > max(1, int(window_days)), beyond).when(~F.col("eligible"), F.array(F.lit(NOT_ELIGIBLE)))
        .when(~signal, F.array(*[F.lit(x) for x in (AWAITING, *GAPS)])).otherwise(none)
    )
    return rows.withColumn("notes", notes)


def with_outcome(rows: DataFrame) -> DataFrame:
    """Adds the rule's outcome; all null for lines that are ready for review."""
    waiting, blocked = F.array_contains("notes", AWAITING), F.size("notes") > 0
    pick = lambda i: F.when(blocked, F.when(waiting, F.lit(ACTION[i])).otherwise(F.lit(REPORT[i])))
    bullets = F.transform("notes", lambda n: F.concat(F.when(n.isin(GAPS), "  - ").otherwise("- "), n))
    return (
        rows.withColumn("panel", pick(0)).withColumn("priority", pick(1)).withColumn("priority_score", pick(2)).withColumn("exception_type", pick(3))
        .withColumn("recommendation", F.when(blocked, F.array_join(bullets, "\n"))).withColumn("evidence", F.when(blocked, F.array_join("notes", ". ")))
    )


def queue(lines: DataFrame, limit: int, again: bool = False, orders: DataFrame | None = None) -> DataFrame:
    """The next lines to classify: active and not processed, the longest waiting first, never processed ones before all. With
    orders (po_number) all active lines of theirs instead."""
    active = lines.filter(F.col("po_status").isin(*ACTIVE))
    if orders is not None:
        return active.join(orders.select("po_number").distinct(), "po_number", "left_semi").orderBy(F.asc_nulls_first("ai_processed_at"), "po_number", "line_item").limit(limit)
    rows = active.filter(~F.col("ai_processed") & (F.coalesce("ai_reanalysis_needed", F.lit(False)) == again))
    return rows.orderBy(F.asc_nulls_first("ai_processed_at"), "po_number", "line_item").limit(limit)


def ready_first(rows: DataFrame) -> DataFrame:
    """Lines that are ready for review before those that a rule decides."""
    return rows.orderBy(F.size("notes") > 0, F.asc_nulls_first("ai_processed_at"), "po_number", "line_item")


#: What makes a rule's result the same as the last one.
SAME = ["recommendation", "panel", "exception_type", "priority", "priority_score"]


def unchanged(rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """Adds unchanged: whether a rule's outcome is that of the line's latest exception and nobody asked for a new look."""
    have = [c for c in SAME if c in exceptions.columns]
    # lines without an exception are many and match nothing: they are dealt by themselves, not to one task as a null key
    apart = F.when(F.col("exception_id").isNull(), F.xxhash64("po_number", "line_item")).otherwise(F.lit(0)).cast("long")
    last = exceptions.select("exception_id", F.lit(0).cast("long").alias("apart_"), *[F.col(c).alias(f"old_{c}") for c in have])
    joined = rows.withColumn("apart_", apart).join(last, ["exception_id", "apart_"], "left")
    same = F.col("exception_id").isNotNull() & F.col("panel").isNotNull() & ~F.coalesce("ai_reanalysis_needed", F.lit(False))
    for c in have:
        a, b = (S.priority(c), S.priority(f"old_{c}")) if c == "priority" else (F.col(c), F.col(f"old_{c}"))
        same = same & a.eqNullSafe(b)
    return joined.withColumn("unchanged", F.coalesce(same, F.lit(False))).select(*rows.columns, "unchanged")


#: What records() reads of classified lines.
RECORDED = ["exception_id", "po_number", "line_item", "supplier_name", "panel", "priority", "priority_score", "exception_type", "po_qty", "gr_qty", "ibd_qty", "recommendation", "evidence"]


def records(rows: DataFrame, max_id: int) -> DataFrame:
    """Exception records of classified lines. A line with an exception keeps its id; the others are numbered after max_id by
    order and line. is_new tells them apart. rows are read several times: what takes long to derive is better written before (RECORDED)."""
    done = rows.filter("panel is not null")
    made = lambda df, key, new: df.select(
        F.col(key).cast("long").alias("exception_id"), "po_number", "line_item", "supplier_name", "panel", "priority", "priority_score", "exception_type",
        (F.coalesce("po_qty", F.lit(0)) - F.coalesce("gr_qty", F.lit(0))).alias("open_qty"), F.coalesce("ibd_qty", F.lit(0)).alias("ibd_qty"), "recommendation", "evidence", F.lit(1.0).alias("confidence"), F.lit(new).alias("is_new"),
    )
    numbered = assign_ids(done.filter("exception_id is null"), ["po_number", "line_item"], max_id)
    return made(done.filter("exception_id is not null"), "exception_id", False).unionByName(made(numbered, "new_id", True))


def max_exception_id(exceptions: DataFrame) -> int:
    return exceptions.agg(F.coalesce(F.max("exception_id"), F.lit(0))).first()[0]


def persist(exceptions: DataFrame, lines: DataFrame, errors: DataFrame, made: DataFrame, run_time: str, by_model: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(exceptions, lines, document errors) after the records `made`: exceptions are replaced or added by id, lines stamped,
    and marked as processed where a model decided. Then all errors of the documents that concern a line point to its
    exception, those of other lines in one document too; of several exceptions of a document the largest id counts."""
    keys = ["po_number", "line_item"]
    new = [c for c in made.columns if c in exceptions.columns]
    kept = upsert(exceptions, made.select(new), ["exception_id"])
    mark = made.select(*keys, F.lit(True).alias("made_")).distinct()
    rows = lines.join(mark, keys, "left")
    values = {"ai_processed": F.lit(by_model), "ai_processed_at": F.lit(run_time).cast("timestamp"), "ai_reanalysis_needed": F.lit(False)}
    lines = rows.select(*[F.when(F.col("made_"), values[c]).otherwise(F.col(c)).alias(c) if c in values else F.col(c) for c in lines.columns])
    if by_model:
        ours = made.select("po_number", F.col("line_item").alias("line_"), "exception_id", "exception_type")
        near = errors.select("docnum", "po_number", S.line_item("line_item").alias("error_line")).join(ours, "po_number").filter("error_line is null or error_line = line_")
        best = near.groupBy("docnum").agg(F.max(F.struct("exception_id", "exception_type")).alias("best_"))
        linked = errors.join(best, "docnum", "left")
        flags = {"ai_processed": F.lit(True), "ai_processed_at": F.lit(run_time).cast("timestamp"), "exception_type_hint": F.col("best_.exception_type"), "ict_exception_id": F.col("best_.exception_id")}
        before = {c: F.col(c) if c in errors.columns else F.lit(v).cast(t) for c, (t, v) in DOCUMENT_FLAGS.items()}
        errors = linked.select(*[c for c in errors.columns if c not in flags], *[F.when(F.col("best_").isNotNull(), flags[c]).otherwise(before[c]).alias(c) for c in flags])
    return kept, lines, errors


def outcome_counts(rows: DataFrame) -> DataFrame:
    """One row of a run over lines with unchanged and exception_id: total, processed, created, updated, skipped, waiting."""
    ruled, skip = F.col("panel").isNotNull(), F.col("unchanged")
    return rows.agg(
        F.count("*").alias("total"), F.count_if(ruled & ~skip).alias("processed"), F.count_if(ruled & ~skip & F.col("exception_id").isNull()).alias("created"), F.count_if(ruled & ~skip & F.col("exception_id").isNotNull()).alias("updated"),
        F.count_if(skip).alias("skipped"), F.count_if(~ruled).alias("for_review"),
    )


def classify(rows: DataFrame, classifier: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Lines that no rule decides go, a batch at a time, through a classifier that the caller brings."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield classifier(frame)

    return rows.filter(F.size("notes") == 0).mapInPandas(run, schema)


def context(rows: DataFrame) -> Column:
    """The facts of a line as text for a prompt."""
    line = lambda label, c: F.concat(F.lit(label + ": "), F.coalesce(c, F.lit("n/a")))
    return F.concat_ws(
        "\n", line("Order", F.concat("po_number", F.lit("/"), "line_item")), line("Supplier", F.col("supplier_name")), line("Material", F.col("material_description")), line("Plant", F.col("plant_name")),
        line("Delivery", F.date_format("delivery_date", "yyyy-MM-dd")), line("Carrier", F.col("carrier_status")), line("Delivery document", F.col("delivery")), line("Document errors", F.col("n_errors").cast("string")),
    )


def facts(rows: DataFrame, as_of: str) -> Column:
    """What the classification rules look at, as text: delivery, carrier, document errors, days left, and the signal that
    follows. rows: overall_status, ibd_qty, carrier_status, delivery_by_date, n_blocking, delivery_date."""
    status, carrier = S.blank_null("overall_status"), F.coalesce(F.trim("carrier_status"), F.lit(""))
    tracked, blocked = F.col("carrier_status").isNotNull(), F.col("n_blocking") > 0
    days = F.datediff(F.to_date("delivery_date"), F.lit(as_of).cast("date"))
    yes = lambda c: F.when(c, "yes").otherwise("no")
    lines = [
        F.lit("Classification context (use to match exception rule triggers):"),
        F.concat(F.lit("- ASN on file: "), yes(status.isNotNull()), F.lit(" | Status: "), S.movement_label("overall_status")),
        F.concat(
            F.lit("- CHR tracking: "), yes(tracked), F.when(carrier != "", F.concat(F.lit(' | Latest event: "'), carrier, F.lit('"'))).otherwise(""),
            F.coalesce(F.concat(F.lit(" | Est delivery: "), F.date_format("delivery_by_date", "yyyy-MM-dd")), F.lit("")),
        ),
        F.concat(F.lit("- IDoc errors (blocking): "), yes(blocked)),
        F.concat(F.lit("- Days to PO delivery date: "), F.coalesce(days.cast("string"), F.lit("N/A"))),
    ]
    moving = F.lower(carrier).rlike(r"in\s*transit|picked\s*up|load\s*picked|departed|en\s*route")
    signal = (
        F.when(blocked, "- Note: IDoc errors take priority — resolve before classifying as healthy/in-transit.")
        .when(status.isNotNull() & tracked & moving, "- Shipment signal: ASN on file and carrier event indicates in-transit or picked-up.")
        .when(status.isNotNull() & ~tracked & (F.col("ibd_qty") > 0), "- Shipment signal: ASN/IBD on file but no CHR carrier event.")
        .when(~tracked & (days < 0), "- Shipment signal: past PO delivery date with no CHR tracking.")
    )
    return F.concat_ws("\n", *lines, signal)


def error_section(errors: DataFrame, shown: int = 3, longest: int = 250) -> DataFrame:
    """po_number, section: the newest document errors of each order as text for a prompt."""
    best = top_errors(errors, shown)
    message = F.substring(F.trim(F.regexp_replace(S.first_text("error_msg", F.lit("No message")), r"\s+", " ")), 1, longest)
    line = F.concat(F.lit("  - IDoc "), "docnum", F.lit(" [status "), S.first_text("status", F.lit("?")), F.lit(" | "), S.document_group("status"), F.lit("] "), F.coalesce(F.date_format("status_logdat", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), F.lit("unknown date")), F.lit(": "), message)
    rows = best.groupBy("po_number").agg(F.array_sort(F.collect_list(F.struct("rank_", line.alias("line")))).alias("lines"), F.first("n_errors").alias("n"))
    head = F.when(F.col("n") > shown, F.concat(F.lit(f"EDI856 IDoc Errors ({shown} most recent of "), F.col("n").cast("string"), F.lit("):"))).otherwise(F.concat(F.lit("EDI856 IDoc Errors ("), F.col("n").cast("string"), F.lit("):")))
    return rows.select("po_number", F.concat_ws("\n", head, F.transform("lines", lambda x: x["line"])).alias("section"))


def carrier_section(events: DataFrame) -> DataFrame:
    """po_number, section: the carrier events of each order, one of each kind and the newest first, as text for a prompt."""
    or_none = lambda c: S.first_text(F.col(c).cast("string"), F.lit("N/A"))
    # fixed values: the parts of a line
    line = F.concat(
        F.lit("- "), F.coalesce(S.first_text("status", "event_type"), F.lit("N/A")), F.lit(" | Event: "), F.coalesce(F.date_format("event_time", "yyyy-MM-dd HH:mm 'UTC'"), F.lit("N/A")), F.lit(" | Qty: "), or_none("actual_quantity"),
        F.lit(" | SKU: "), or_none("sku_number") if "sku_number" in events.columns else F.lit("N/A"), F.lit(" | Tracking #: "), or_none("navisphere_tracking_number" if "navisphere_tracking_number" in events.columns else "tracking_number"), F.lit(" | Load #: "), or_none("load_number"),
    )
    time = F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")), F.lit(0))
    rows = dedupe_carrier_events(events).groupBy("po_number").agg(F.array_sort(F.collect_list(F.struct((-time).alias("age"), "id", line.alias("line")))).alias("lines"))
    return rows.select("po_number", F.concat_ws("\n", F.lit("CHR (carrier) events (deduped, newest first):"), F.transform("lines", lambda x: x["line"])).alias("section"))


def rules_in_order(rules: DataFrame) -> DataFrame:
    """Exception rules by their score as a number, those without one last."""
    return rules.orderBy(F.asc_nulls_last(F.col("score").try_cast("int")), "exception_type")
