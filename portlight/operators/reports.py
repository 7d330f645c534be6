"""Report aggregations: one pass over a table where possible, several groupings as grouping sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from .relational import ACTIVE, contains_any, date_range, equals_unless_all

BUCKETS = ("overdue", "next7", "next14", "next30", "beyond30", "noDate")
RATINGS = ("HELPFUL", "NOT_HELPFUL")


def percent(part, whole, digits: int):
    """100 * part / whole rounded half up in decimals, 0 without whole."""
    value = part.cast("decimal(20,0)") * 100 / F.nullif(whole.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return F.coalesce(F.round(value.cast("decimal(30,8)"), digits).cast("double"), F.lit(0.0))


def active_orders(lines: DataFrame) -> DataFrame:
    status = F.col("po_status")
    rows = lines.filter(status.isin(*ACTIVE))
    return rows.groupBy("po_number").agg(F.count("*").alias("total_lines"), F.count_if(status == "OPEN").alias("open_lines"), F.count_if(status == "CLOSED").alias("closed_lines"), F.lit("OPEN").alias("status"))


def exception_summary(exceptions: DataFrame, lines: DataFrame) -> DataFrame:
    p = S.priority("priority")
    left = exceptions.agg(
        F.count("*").alias("total"), *[F.count_if(p == x).alias(x.lower()) for x in ("HIGH", "MEDIUM", "LOW")],
        F.count_if(F.col("panel") == "ACTION_REQUIRED").alias("action_required"), F.count_if(F.col("panel") == "STATUS_REPORT").alias("status_report"),
    )
    right = lines.agg(F.count_if(F.col("po_status") == "OPEN").alias("open_lines"), F.count_if(F.col("ai_processed")).alias("processed_lines"))
    return left.crossJoin(right)  # one row each


def supply_chain_metrics(lines: DataFrame) -> DataFrame:
    days = S.lead_days("created_at", "delivery_date")
    out = lines.agg(F.countDistinct("po_number").alias("orders"), F.count_if(F.col("po_status") == "CLOSED").alias("closed"), F.sum(days).alias("days"), F.count(days).alias("n"), F.count_if(F.col("po_status") == "OPEN").alias("open_lines"))
    mean = F.coalesce(F.round((F.col("days").cast("decimal(20,0)") / F.nullif(F.col("n"), F.lit(0)).cast("decimal(20,0)")).cast("decimal(30,8)"), 1).cast("double"), F.lit(0.0))
    return out.select("orders", percent(F.col("closed"), F.col("orders"), 2).alias("closed_percent"), mean.alias("lead_days"), "open_lines")


def usage(logs: DataFrame, since: str, until: str) -> DataFrame:
    """Calls and tokens in all, by provider, by model and by day: one scan and one shuffle."""
    rows = logs.filter(date_range("started_at", since, until)).filter("coalesce(total_tokens, 0) > 0 or coalesce(ai_calls, 0) > 0")
    known = lambda c: F.coalesce(S.blank_null(c), F.lit("Unknown"))
    rows = rows.select(known("provider").alias("provider"), known("model_id").alias("model"), F.date_format("started_at", "yyyy-MM-dd").alias("day"), "ai_calls", "total_tokens")
    sums = [F.count("*").alias("runs"), F.sum(F.coalesce("ai_calls", F.lit(0))).alias("calls"), F.sum(F.coalesce("total_tokens", F.lit(0))).alias("tokens"), F.grouping_id().alias("g")]
    out = rows.groupingSets([[], ["provider"], ["model"], ["day"]], "provider", "model", "day").agg(*sums)
    kind = F.when(F.col("g") == 7, "total").when(F.col("g") == 3, "provider").when(F.col("g") == 5, "model").otherwise("day")
    return out.select(kind.alias("kind"), F.coalesce("provider", "model", "day", F.lit("all")).alias("label"), "runs", "calls", "tokens")


def feedback_totals(rows: DataFrame) -> DataFrame:
    n = F.count("*")
    return rows.agg(
        n.alias("total"), F.countDistinct("exception_id").alias("exceptions"), *[F.count_if(F.col("rating") == r).alias(r.lower()) for r in RATINGS],
        percent(F.count_if(F.col("rating") == "HELPFUL"), n, 1).alias("helpful_percent"), F.count_if(F.coalesce(F.trim("comment"), F.lit("")) != "").alias("with_comment"),
    )


def feedback_by_type(rows: DataFrame) -> DataFrame:
    label = F.coalesce(S.blank_null("exception_type"), F.lit("Unknown"))
    return rows.groupBy(label.alias("label")).agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == r).alias(r.lower()) for r in RATINGS])


def domain(spark: SparkSession, column: str, values) -> DataFrame:
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def counts_over(rows: DataFrame, column: str, values) -> DataFrame:
    """Rows for each of a few fixed values, also those that don't occur."""
    found = rows.groupBy(column).agg(F.count("*").alias("n"))
    return F.broadcast(domain(rows.sparkSession, column, values)).join(found, column, "left").select(column, F.coalesce("n", F.lit(0)).alias("n"))


def feedback_daily(rows: DataFrame) -> DataFrame:
    return rows.groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("total"), *[F.count_if(F.col("rating") == r).alias(r.lower()) for r in RATINGS])


def delivery_timeline(lines: DataFrame, as_of: str) -> DataFrame:
    rows = lines.filter(F.col("po_status").isin(*ACTIVE)).select(S.delivery_bucket("delivery_date", as_of).alias("bucket"))
    return counts_over(rows, "bucket", BUCKETS)


def plant_counts(lines: DataFrame, plants: DataFrame) -> DataFrame:
    counted = lines.filter(F.col("po_status").isin(*ACTIVE)).groupBy("plant").agg(F.count("*").alias("n"))
    named = counted.join(plants.select(F.col("plant_code").alias("plant"), "plant_name"), "plant", "left")
    return named.select(F.coalesce(S.blank_null("plant"), F.lit("—")).alias("plant"), F.coalesce("plant_name", F.lit("")).alias("plant_name"), "n")


def on_active_lines(exceptions: DataFrame, lines: DataFrame) -> DataFrame:
    return exceptions.join(lines.filter(F.col("po_status").isin(*ACTIVE)).select("po_number", "line_item"), ["po_number", "line_item"], "left_semi")


def root_causes(exceptions: DataFrame) -> DataFrame:
    return exceptions.groupBy(F.coalesce(S.blank_null("exception_type"), F.lit("UNKNOWN")).alias("cause")).agg(F.count("*").alias("n"))


def _filtered(lines: DataFrame, exceptions: DataFrame, plant, search, since, until, priority, kind=None) -> tuple[DataFrame, DataFrame]:
    """(active lines, exceptions on them) under the filters; a priority is compared as it stands."""
    kept = lines.filter(F.col("po_status").isin(*ACTIVE)).filter(equals_unless_all({"plant": plant})).filter(date_range("delivery_date", since, until))
    kept = kept.filter(contains_any(["po_number", "material_id", "supplier_id"], search))
    left = exceptions.filter(equals_unless_all({"plant": plant, "priority": priority, "exception_type": kind})).filter(date_range("delivery_date", since, until))
    return kept, left.join(kept.select("po_number", "line_item"), ["po_number", "line_item"], "left_semi")


def _line_counts(kept: DataFrame) -> DataFrame:
    return kept.agg(F.count("*").alias("active_lines"), F.count_if(~F.col("ai_processed")).alias("pending_lines"), F.countDistinct("plant").alias("plants"))


def _exception_counts(left: DataFrame) -> DataFrame:
    p = S.priority("priority")
    return left.agg(F.count("*").alias("exceptions"), *[F.count_if(F.col("panel") == x).alias(x.lower()) for x in ("ACTION_REQUIRED",)], F.count_if(p == "HIGH").alias("high"), F.count_if(p == "MEDIUM").alias("medium"), F.count_if(p == "LOW").alias("low"))


def _side_by_side(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.crossJoin(part)  # one row each
    return out


def dashboard(lines: DataFrame, exceptions: DataFrame, errors: DataFrame, report: DataFrame, plant: str | None = None, search: str | None = None, since: str | None = None, until: str | None = None, priority: str | None = None) -> DataFrame:
    """One row of counts under the filters. The inbound count takes plant and search only, document errors follow the
    orders that are left."""
    kept, left = _filtered(lines, exceptions, plant, search, since, until, priority)
    found = report.filter(equals_unless_all({"plant": plant})).filter(contains_any(["po_number", "line_item", "material_id", "supplier_id", "supplier_name", "reference", "carrier_status", "plant_name", "plant"], search))
    of_orders = errors.join(kept.select("po_number"), "po_number", "left_semi").agg(F.count("*").alias("document_errors"))
    return _side_by_side([_line_counts(kept), _exception_counts(left), of_orders, found.agg(F.count("*").alias("inbound_to_create"))])


def dashboard_summary(t, as_of: str, plant: str | None = None, since: str | None = None, until: str | None = None, priority: str | None = None, kind: str | None = None) -> DataFrame:
    """One row for an assistant: counts of all tables, delivery buckets of active lines. Filters apply unevenly: lines of any
    status are all counted, deliveries only by plant, exceptions once alone and once on active lines, and carrier events
    only where a plant is asked for by its orders."""
    kept, left = _filtered(t.po_lines, t.exceptions, plant, None, since, until, priority, kind)
    n = lambda df, c: df.agg(F.count("*").alias(c))
    everywhere = plant in (None, "", "ALL")
    asn = t.asn_ibd if everywhere else t.asn_ibd.filter(F.col("plant") == plant)
    events = t.carrier_events if everywhere else t.carrier_events.join(kept.select("po_number"), "po_number", "left_semi")
    records = t.exceptions.filter(equals_unless_all({"plant": plant, "priority": priority, "exception_type": kind})).filter(date_range("delivery_date", since, until))
    bucket = S.delivery_bucket("delivery_date", as_of)
    buckets = kept.agg(*[F.count_if(bucket == b).alias(b.lower()) for b in BUCKETS])
    status = left.agg(F.count_if(F.col("panel") == "STATUS_REPORT").alias("status_report"))
    errors = n(t.idoc_errors.join(kept.select("po_number"), "po_number", "left_semi"), "document_errors")
    return _side_by_side([n(t.po_lines, "all_lines"), _line_counts(kept), n(asn, "deliveries"), n(events, "carrier_events"), errors, n(records, "exception_records"), _exception_counts(left), status, buckets])


def dashboard_lists(t, plant: str | None = None, since: str | None = None, until: str | None = None, priority: str | None = None, kind: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(plants, types) beside dashboard_summary's row: plants with active lines and how many each has, and the types of the exceptions
    on these lines, the most frequent first."""
    kept, left = _filtered(t.po_lines, t.exceptions, plant, None, since, until, priority, kind)
    return by_count(plant_counts(kept, t.plants), "n", "plant"), by_count(root_causes(left), "n", "cause")


def by_count(rows: DataFrame, count: str, label: str) -> DataFrame:
    """The largest counts first, ties by label."""
    return rows.orderBy(F.desc(count), label)


def by_usage(rows: DataFrame) -> DataFrame:
    """Usage rows: the total, then providers and models by tokens, then days in order."""
    place = F.when(F.col("kind") == "total", 0).when(F.col("kind") == "provider", 1).when(F.col("kind") == "model", 2).otherwise(3)
    return rows.orderBy(place, F.when(F.col("kind") != "day", -F.col("tokens")), "label")


def by_arrival(report: DataFrame) -> DataFrame:
    """Lines of the creation report by arrival, those without one last."""
    return report.orderBy(F.asc_nulls_last("eta"), "po_number", "line_item")


def truncation_profile(rows: DataFrame, limits: dict[str, int]) -> DataFrame:
    """For each column how many values its limit cuts, and the longest value."""
    long = rows.select(*limits).unpivot([], list(limits), "field", "value")
    limit = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv])
    return long.filter(F.length("value") > limit[F.col("field")]).groupBy("field").agg(F.count("*").alias("n"), F.max(F.length("value")).cast("long").alias("longest"))


def rollup_counters(rows: DataFrame, counters: list[str]) -> DataFrame:
    """Sums of counters by entity, and of all."""
    return rows.rollup("entity").agg(*[F.sum(c).alias(c) for c in counters]).select(F.coalesce("entity", F.lit("all")).alias("entity"), *counters)


def page_estimate(total, page: int):
    """Pages that so many rows take."""
    return F.ceil(F.col(total) / F.lit(page)) if isinstance(total, str) else F.ceil(total / F.lit(page))
