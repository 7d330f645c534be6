"""Joins, top-1 and filter operators on the domain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S

ALL = "ALL"
ACTIVE = ("OPEN", "GR_POSTED")


def conjunction(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def equals_unless_all(filters: dict[str, str | None]) -> Column:
    """Equality on each column; None, '' and ALL ask nothing."""
    return conjunction([F.col(c) == v for c, v in filters.items() if v not in (None, "", ALL)])


def date_range(column: str, since: str | None, until: str | None) -> Column:
    """Whole UTC days; a side that is None or no date asks nothing; sides in the wrong order change places."""
    good = [x if x and len(x) == 10 and x.replace("-", "").isdigit() else None for x in (since, until)]
    if all(good) and good[0] > good[1]:
        good.reverse()
    conditions = []
    if good[0]:
        conditions.append(F.col(column) >= F.lit(f"{good[0]} 00:00:00").cast("timestamp"))
    if good[1]:
        conditions.append(F.col(column) <= F.lit(f"{good[1]} 23:59:59.999").cast("timestamp"))
    return conjunction(conditions)


def contains_any(columns: list[str], term: str | None) -> Column:
    """Whether the term is in any of the columns, whatever the case. An empty term asks nothing."""
    term = (term or "").strip().lower()
    if not term:
        return F.lit(True)
    out = F.lit(False)
    for c in columns:
        out = out | F.coalesce(F.contains(F.lower(c), F.lit(term)), F.lit(False))
    return out


def stale(column: str, run_time: str) -> Column:
    return F.col(column).isNull() | (F.col(column) < F.lit(run_time).cast("timestamp"))


def newest_first(df: DataFrame, keys: list[str], order: list[Column], n: int = 1) -> DataFrame:
    """The first n rows of each key in the given order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank_", rank).filter(F.col("rank_") <= n)


def carrier_text() -> Column:
    return F.trim(S.first_text("status", "event_type"))


def dedupe_carrier_events(events: DataFrame) -> DataFrame:
    """Of events of one order with the same tracking, order and load number and status the newest; null time is oldest."""
    keyed = events.withColumn("status_key", F.upper(F.coalesce(carrier_text(), F.lit(""))))
    for c in ("tracking_number", "order_number", "load_number"):
        keyed = keyed.withColumn(f"{c}_key", F.coalesce(c, F.lit("")))
    order = [F.desc(F.coalesce("event_time", F.timestamp_seconds(F.lit(0)))), F.asc("id")]
    best = newest_first(keyed, ["po_number", "tracking_number_key", "order_number_key", "load_number_key", "status_key"], order)
    return best.select(events.columns)


def latest_carrier_event(events: DataFrame) -> DataFrame:
    """The newest event of each order, no time last, the smallest id of ties: by aggregation, without sorting."""
    others = [c for c in events.columns if c not in ("po_number", "id", "event_time")]
    time = F.coalesce(F.unix_micros(F.col("event_time").cast("timestamp")), F.lit(-(1 << 63)))
    best = F.min(F.struct((-1 - time).alias("age"), "id", "event_time", *others)).alias("e")
    return events.groupBy("po_number").agg(best).select(*["po_number" if c == "po_number" else f"e.{c}" for c in events.columns])


def in_transit_event(events: DataFrame) -> DataFrame:
    """The newest event of each order whose status says that it is under way."""
    return latest_carrier_event(events.filter(F.coalesce(carrier_text().rlike(S.IN_TRANSIT), F.lit(False))))


def delivered_line_keys(asn: DataFrame) -> DataFrame:
    """po_number, line_key of lines with a delivery."""
    rows = asn.filter("reference_document <> '' and reference_item <> '' and delivery <> ''")
    return rows.select(F.trim("reference_document").alias("po_number"), S.line_item("reference_item").alias("line_key")).distinct()


def creation_report(lines: DataFrame, asn: DataFrame, events: DataFrame, suppliers: DataFrame, plants: DataFrame) -> DataFrame:
    """Active lines without a delivery whose order is in transit, with the event's arrival time and reference."""
    rows = lines.filter(F.col("po_status").isin(*ACTIVE)).withColumn("line_key", S.line_item("line_item"))
    rows = rows.join(delivered_line_keys(asn), ["po_number", "line_key"], "left_anti")
    there = lambda *cs: [c for c in cs if c in events.columns]
    moving = in_transit_event(events).select(
        "po_number", F.coalesce(*there("delivery_by_date", "delivery_available_by_date", "event_time")).alias("eta"),
        F.coalesce(S.first_text(*there("customer_reference_number", "customer_order_reference", "order_number", "navisphere_tracking_number", "tracking_number")), F.lit("")).alias("reference"),
        carrier_text().alias("carrier_status"),
    )
    rows = rows.join(moving, "po_number")
    rows = rows.join(suppliers.select(F.col("supplier").alias("supplier_id"), F.col("name").alias("supplier_name")), "supplier_id", "left")
    rows = rows.join(plants.select(F.col("plant_code").alias("plant"), "plant_name"), "plant", "left")
    return rows.select("po_number", "line_item", "material_id", "supplier_id", F.coalesce("supplier_name", F.lit("")).alias("supplier_name"), "plant", F.coalesce("plant_name", F.lit("")).alias("plant_name"), "po_qty", "delivery_date", "eta", "reference", "carrier_status")


#: Columns that an upload row must have, in the order they are asked.
REQUIRED = ["po_number", "line_item", "delivery_date", "delivery_quantity", "supplier_id", "reference"]


def template_rows(selection: DataFrame, report: DataFrame) -> DataFrame:
    """The upload template's rows for selected (po_number, line_item); missing names the first empty required field, or says
    that the report has no such line."""
    wanted = selection.withColumn("line_key", S.line_item("line_item")).filter("po_number <> '' and line_key is not null").select(F.trim("po_number").alias("po_number"), "line_key").distinct()
    found = report.withColumn("line_key", S.line_item("line_item"))
    rows = wanted.join(found, ["po_number", "line_key"], "left").select(
        "po_number", F.col("line_key").alias("line_item"), S.excel_day("eta").cast("long").alias("delivery_date"), F.col("po_qty").cast("double").alias("delivery_quantity"), "supplier_id", "reference",
        F.col("carrier_status").isNotNull().alias("found_"),
    )
    missing = F.lit(None).cast("string")
    for c in reversed(REQUIRED):
        missing = F.when(F.coalesce(F.col(c).cast("string"), F.lit("")) == "", c).otherwise(missing)
    return rows.withColumn("missing", F.when(~F.col("found_"), "line").otherwise(missing)).drop("found_")


def eligible_orders(partners: DataFrame, functions: list[str], suppliers: list[str]) -> DataFrame:
    """po_number of orders with a partner row of one of the functions and, in the same row, one of the suppliers. An empty
    list admits all."""
    test = F.lit(True)
    if functions:
        test = test & F.upper(F.trim("partner_function")).isin([x.strip().upper() for x in functions])
    if suppliers:
        test = test & F.trim("supplier").isin([x.strip() for x in suppliers])
    return partners.filter(test).select("po_number").distinct()


def asn_quantities(asn: DataFrame) -> DataFrame:
    """Received and posted (movement 'C') quantities by referenced line."""
    rows = asn.filter("reference_document <> '' and reference_item <> ''").withColumn("q", S.quantity("actual_delivery_qty"))
    posted = F.coalesce(F.sum(F.when(F.upper("goods_movement_status") == "C", F.col("q"))), F.lit(0))
    return rows.groupBy(F.col("reference_document").alias("po_number"), S.line_item("reference_item").alias("line_item")).agg(F.sum("q").alias("received"), posted.alias("posted"), F.count("*").alias("n_items"))


def asn_summary(asn: DataFrame) -> DataFrame:
    """Summed quantity by line, with the other columns of its first item by (delivery, item)."""
    rows = asn.filter("reference_document <> '' and reference_item <> ''")
    first = F.min(F.struct("delivery", "item", "goods_movement_status", "bill_of_lading")).alias("f")
    out = rows.groupBy(F.col("reference_document").alias("po_number"), S.line_item("reference_item").alias("line_item")).agg(F.sum(S.quantity("actual_delivery_qty")).alias("ibd_qty"), first)
    return out.select("po_number", "line_item", "ibd_qty", "f.delivery", "f.goods_movement_status", "f.bill_of_lading")


def top_errors(errors: DataFrame, n: int = 3) -> DataFrame:
    """The n newest errors of each order, with rank_ and n_errors, their number in all: one shuffle. An error without the time of its
    status counts from when its document was made, idoc_credat, where there is such a column."""
    w = Window.partitionBy("po_number")
    made = [F.col("idoc_credat").cast(errors.schema["status_logdat"].dataType)] if "idoc_credat" in errors.columns else []
    rows = errors.withColumn("rank_", F.row_number().over(w.orderBy(F.desc_nulls_last(F.coalesce("status_logdat", *made)), F.asc("docnum")))).withColumn("n_errors", F.count("*").over(w))
    return rows.filter(F.col("rank_") <= n)


def top_document_errors(errors: DataFrame, n: int = 3) -> DataFrame:
    return top_errors(errors, n).select("po_number", F.col("rank_").cast("long").alias("rank"), "docnum", "error_msg", "n_errors")


def partner_lookup(suppliers: DataFrame, partners: DataFrame) -> DataFrame:
    """suppliers (supplier) with business partners (partner, city), whose numbers may lack or have leading zeros; an exactly
    equal number goes first, then the largest."""
    bare = lambda c: F.regexp_replace(F.trim(c), "^0+", "")
    rows = suppliers.withColumn("bare", bare("supplier")).join(partners.withColumn("bare", bare("partner")), "bare", "left")
    best = F.max(F.struct((F.col("partner") == F.col("supplier")).alias("exact"), "partner", "city")).alias("best")
    return rows.groupBy("supplier").agg(best).select("supplier", F.col("best.partner").alias("partner"), F.col("best.city").alias("city"))


def parse_selection(payload: DataFrame, column: str = "payload") -> DataFrame:
    """po_number, line_item of a JSON array of {po_number, line_item}; incomplete ones are left out, repeated ones count once."""
    rows = payload.select(F.explode(F.from_json(column, "array<struct<po_number:string,line_item:string>>")).alias("x"))
    return rows.select(F.trim("x.po_number").alias("po_number"), S.line_item("x.line_item").alias("line_item")).filter("po_number <> '' and line_item is not null").distinct()


#: The columns of an upload workbook, in order.
WORKBOOK = ["Purchasing Document", "Item", "Supplier", "Delivery Date", "Reference", "Bill of Lading", "Delivery Quantity", "Plant", "Storage Location", "Means-of-Trans. Type", "Means of Transport"]


def workbook_rows(template: DataFrame, lines: DataFrame) -> DataFrame:
    """The rows of an upload workbook in its eleven columns, for complete template rows."""
    rows = template.filter("missing is null").join(lines.select("po_number", "line_item", "plant"), ["po_number", "line_item"], "left")
    none = F.lit("")
    values = [F.col("po_number"), F.col("line_item"), F.col("supplier_id"), F.col("delivery_date"), F.col("reference"), none, F.col("delivery_quantity"), F.col("plant"), F.lit(None).cast("string"), none, none]
    return rows.select(*[c.alias(name) for c, name in zip(values, WORKBOOK, strict=True)])  # names with a dot need backticks


def expand(rows: DataFrame, other: DataFrame, keys: dict[str, str], name: str) -> DataFrame:
    """rows with `name`, an array of the rows of other with equal keys (own column to the other's); empty where there are none."""
    packed = other.groupBy(*[F.col(theirs).alias(f"key_{ours}") for ours, theirs in keys.items()]).agg(F.array_sort(F.collect_list(F.struct(*other.columns))).alias(name))
    test = conjunction([F.col(ours) == F.col(f"key_{ours}") for ours in keys])
    joined = rows.join(packed, test, "left").drop(*[f"key_{ours}" for ours in keys])
    return joined.withColumn(name, F.coalesce(name, F.array().cast(joined.schema[name].dataType)))
