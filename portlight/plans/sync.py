"""Sync chains: source documents are mapped, merged into their table and, after a full run, swept of what it hasn't seen.

Every chain takes the table as it is and the source documents and returns the next version of the table; a second run over
the same documents changes nothing but stamps. `reconcile` is for full runs only: a partial one hasn't seen all rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import merge, relational
from ..sources import documents


def stamped(rows: DataFrame, run_time: str) -> DataFrame:
    return rows.withColumn("last_synced_at", F.lit(run_time).cast("timestamp"))


def _master(existing: DataFrame, mapped: DataFrame, key: str, run_time: str, reconcile: bool) -> DataFrame:
    incoming = stamped(merge.one_a_key(mapped, [key]), run_time)
    out = merge.upsert(merge.widened(existing, incoming), incoming, [key])
    return merge.deactivate_stale(out, run_time) if reconcile else out


def plants(existing: DataFrame, source: DataFrame, run_time: str, reconcile: bool = True) -> DataFrame:
    return _master(existing, documents.map_plants(source), "plant_code", run_time, reconcile)


def materials(existing: DataFrame, source: DataFrame, run_time: str, reconcile: bool = True) -> DataFrame:
    return _master(existing, documents.map_materials(source), "material", run_time, reconcile)


def suppliers(existing: DataFrame, source: DataFrame, partners: DataFrame, run_time: str, reconcile: bool = True) -> DataFrame:
    return _master(existing, documents.map_suppliers(source, partners), "supplier", run_time, reconcile)


def changed_since(source: DataFrame, since: str | None, column: str = "LastChangeDateTime") -> DataFrame:
    """Documents that changed after `since`, for a partial run without a sweep; None is all."""
    return source if since is None else source.filter(F.col(column) > F.lit(since).cast("timestamp"))


def order_lines(lines: DataFrame, exceptions: DataFrame, source: DataFrame, asn: DataFrame, run_time: str, reconcile: bool = True, since: str | None = None, until: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(lines, exceptions, plan) after a run over order items."""
    incoming = merge.one_a_key(documents.map_order_items(source, since, until), ["po_number", "line_item"])
    quantities = relational.asn_quantities(asn)
    plan = merge.line_plan(lines, incoming, quantities)
    out = merge.merge_lines(lines, incoming, quantities, run_time)
    if reconcile:
        out, exceptions = merge.close_stale_lines(out, exceptions, run_time)
    return out, exceptions, plan


def open_orders(lines: DataFrame) -> DataFrame:
    """Distinct numbers of orders with an open line: the scope of all runs below."""
    return lines.filter("po_status = 'OPEN' and po_number <> ''").select("po_number").distinct()


def _scoped(existing: DataFrame, mapped: DataFrame, keys: list[str], order: str, lines: DataFrame, run_time: str, reconcile: bool) -> DataFrame:
    scope = open_orders(lines)
    mine = mapped.join(scope.toDF(order), order, "left_semi")
    incoming = stamped(merge.one_a_key(mine, keys), run_time)
    out = merge.upsert(merge.widened(existing, incoming), incoming, keys)
    return merge.delete_stale_in_scope(out, order, scope, run_time) if reconcile else out


def partners(existing: DataFrame, source: DataFrame, lines: DataFrame, run_time: str, reconcile: bool = True) -> DataFrame:
    return _scoped(existing, documents.map_partners(source), ["po_number", "partner_function", "partner_counter"], "po_number", lines, run_time, reconcile)


def deliveries(existing: DataFrame, items: DataFrame, headers: DataFrame, lines: DataFrame, run_time: str, reconcile: bool = True) -> tuple[DataFrame, DataFrame]:
    """(deliveries, order lines with their quantities brought up to date)."""
    out = _scoped(existing, documents.map_deliveries(items, headers), ["delivery", "item"], "reference_document", lines, run_time, reconcile)
    moved = merge.refresh_quantities(lines, relational.asn_quantities(out))
    new = moved.select("po_number", "line_item", *[F.col(c).alias(f"new_{c}") for c in merge.QUANTITIES], F.col("again").alias("again_"), F.lit(True).alias("moved_"))
    rows = lines.join(new, ["po_number", "line_item"], "left")
    values = {c: F.when(F.col("moved_"), F.col(f"new_{c}")).otherwise(F.col(c)) for c in merge.QUANTITIES}
    values |= {"ai_processed": F.when(F.col("again_"), False).otherwise(F.col("ai_processed")), "ai_reanalysis_needed": F.when(F.col("again_"), True).otherwise(F.col("ai_reanalysis_needed"))}
    return out, rows.select(*[values[c].alias(c) if c in values else F.col(c) for c in lines.columns])


def document_errors(existing: DataFrame, source: DataFrame, lines: DataFrame, run_time: str, reconcile: bool = True) -> DataFrame:
    scope = open_orders(lines)
    keys = ["docnum", "po_number", "line_item"]
    incoming = merge.one_a_key(documents.map_document_errors(source).join(scope, "po_number", "left_semi"), keys)
    existing = merge.widened(existing, incoming)
    existing = existing.withColumns({c: F.lit(v).cast(t) for c, (t, v) in merge.DOCUMENT_FLAGS.items() if c not in existing.columns})
    plan = stamped(merge.document_plan(existing, incoming).drop("op"), run_time)
    out = merge.upsert(merge.widened(existing, plan), plan, keys)
    return merge.delete_stale_in_scope(out, "po_number", scope, run_time) if reconcile else out


def carrier_events(existing: DataFrame, source: DataFrame, lines: DataFrame, as_of: str, minutes: int, customer: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(events, order lines with new events marked for analysis, truncations) after a run over carrier events (EVENT_SCHEMA)."""
    scope = open_orders(lines)
    whole = documents.event_rows(source).filter(documents.in_lookback("event_time", as_of, minutes, "customer", customer))
    linked = whole.join(scope.withColumn("po_linked", F.lit(True)), "po_number", "left").withColumn("po_linked", F.coalesce("po_linked", F.lit(False)))
    rows = documents.clamped(linked.drop("customer"))
    first = rows.groupBy("source_hash").agg(F.min(F.struct(*[c for c in rows.columns if c != "source_hash"])).alias("r")).select("source_hash", "r.*")
    incoming = first.withColumn("id", F.substring("source_hash", 1, 32))  # the same event has the same id in every run
    known = existing.groupBy("source_hash").agg(F.min("id").alias("known_id"))
    incoming = incoming.join(known, "source_hash", "left").withColumn("id", F.coalesce("known_id", "id")).drop("known_id")
    new = incoming.filter("po_linked").join(existing.select("source_hash"), "source_hash", "left_anti").select("po_number").distinct()
    out = merge.upsert(merge.widened(existing, incoming), incoming, ["source_hash"])
    from ..operators.reports import truncation_profile

    return out, merge.flag_for_analysis(lines, new), truncation_profile(whole, documents.LIMITS)
