"""Queries of runs: versions of tables, their differences, classification by rules, tables by day and by order."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from .operators import changes, classify, merge, offline
from .plans import layout
from .plans.bridge import AS_OF_EVENTS, AS_OF_ORDERS
from .registry import query
from .sources import files
from .sources.shared import shared_folder, written


@query("""select coalesce(a.po_number, b.po_number) as po_number, coalesce(a.line_item, b.line_item) as line_item, cast(coalesce(b.qty, a.po_qty) as double) as po_qty, b.remark
from (select * from po_lines where order_key % 4 <> 0) a full join (select po_number, line_item, max(po_qty + 1) as qty, 'late' as remark from po_lines where order_key % 3 = 0 group by 1, 2) b on a.po_number = b.po_number and a.line_item = b.line_item""")
def versions_merged(t):
    """Two runs into a table; both are repeated afterwards under their labels, and the second has rows twice and a column more."""
    spark, folder = t._spark, shared_folder(t._spark, "versions")
    keys = ["po_number", "line_item"]
    first = t.po_lines.filter("order_key % 4 <> 0").select(*keys, "po_qty")
    second = t.po_lines.filter("order_key % 3 = 0").select(*keys, (F.col("po_qty") + 1).cast("decimal(13,3)").alias("po_qty"), F.lit("late").alias("remark"))
    second = second.unionByName(second.withColumn("po_qty", F.lit(0).cast("decimal(13,3)")))
    for label, rows in (("one", first), ("two", second), ("one", first), ("two", second)):
        merge.merge_into(spark, folder, rows, keys, label, latest="po_qty")
    return files.read_version(spark, folder)


def _two_versions(t):
    keys = ["po_number", "line_item"]
    lines = written(t.po_lines.select(*keys, "po_qty", "plant", "po_uom", "delivery_date", "order_key"), "two-versions")
    old = lines.filter("order_key % 7 <> 0").select(*keys, "po_qty", "plant", "po_uom", "delivery_date")
    moved = F.col("order_key") % 10 == 0
    new = lines.filter("order_key % 5 <> 0 or order_key % 10 = 0").select(
        *keys, F.when(moved, F.col("po_qty") + 1).otherwise(F.col("po_qty")).cast("decimal(13,3)").alias("po_qty"), "plant", F.when(moved, F.when(F.col("po_uom") != "", F.col("po_uom"))).otherwise(F.col("po_uom")).alias("po_uom"), "delivery_date",
    )
    return old, new, keys


FED = "select *, order_key % 7 <> 0 as was, order_key % 5 <> 0 or order_key % 10 = 0 as is_, order_key % 10 = 0 as moved from po_lines"


@query(f"""select po_number, line_item, case when not was then 'insert' when not is_ then 'delete' else 'update' end as op, case when was and is_ then case when po_uom = '' then 'po_qty,po_uom' else 'po_qty' end else '' end as changed,
cast(case when not is_ then null when moved then po_qty + 1 else po_qty end as double) as po_qty from ({FED}) where was <> is_ or (was and is_ and moved)""")
def versions_difference(t):
    old, new, keys = _two_versions(t)
    return changes.difference(old, new, keys).select(*keys, "op", F.array_join("changed", ",").alias("changed"), "po_qty")


@query(f"select po_number, line_item, cast(case when moved then po_qty + 1 else po_qty end as double) as po_qty, plant, case when moved then nullif(po_uom, '') else po_uom end as po_uom, strftime(delivery_date, '%Y-%m-%d %H:%M:%S') as delivery_date from ({FED}) where is_")
def versions_difference_applied(t):
    old, new, keys = _two_versions(t)
    return changes.apply_difference(old, changes.difference(old, new, keys), keys)


#: Rules as a table has them; scores are texts, and rules come in no order.
RULES = [
    ("ON_TRACK", "low", None, "STATUS_REPORT", "true", "[po_number]/[line_item] is on track."),
    ("IN_TRANSIT", "LOW", "8", "STATUS_REPORT", "lower(carrier_status) rlike 'in\\\\s*transit|picked'", "**[material_description]** is on its way to [plant_name] ([carrier_status])."),
    ("IDOC_FAILURE", "High", "1", "ACTION_REQUIRED", "n_errors > 0", "Correct [n_errors] document errors with **[supplier_name]**."),
    ("QTY_MISMATCH", " medium", "5", "ACTION_REQUIRED", "ibd_qty <> po_qty", "[supplier_name] announced [ibd_qty] of [po_qty]; ask [nobody]."),
    ("NO_TRACKING", "HIGH", "2", "ACTION_REQUIRED", f"carrier_status is null and delivery_date < timestamp '{AS_OF_ORDERS}' and delivery is null", "No tracking and no delivery document [delivery]."),
]


def _rules(t):
    return t._spark.createDataFrame(RULES, "exception_type string, priority string, score string, panel string, trigger string, pattern string")


def _by_rules():
    from .queries import ENRICHED

    return "," + ENRICHED + f""", ruled as (select *, case when n_errors > 0 then 1 when carrier_status is null and delivery_date < timestamp '{AS_OF_ORDERS}' and delivery is null then 2 when ibd_qty <> po_qty then 3 when regexp_matches(lower(carrier_status), 'in\\s*transit|picked') then 4 else 5 end as r from star)
select po_number, line_item, ['IDOC_FAILURE', 'NO_TRACKING', 'QTY_MISMATCH', 'IN_TRANSIT', 'ON_TRACK'][r] as exception_type, ['HIGH', 'HIGH', 'MEDIUM', 'LOW', 'LOW'][r] as priority, cast(coalesce([1, 2, 5, 8, null][r], 0) as integer) as priority_score,
case r when 1 then 'Correct ' || n_errors || ' document errors with **' || supplier_name || '**.' when 2 then 'No tracking and no delivery document NO_DATA_FOUND.' when 3 then supplier_name || ' announced ' || cast(ibd_qty as varchar) || ' of ' || cast(po_qty as varchar) || '; ask [nobody].'
when 4 then '**' || coalesce(material_description, 'NO_DATA_FOUND') || '** is on its way to ' || coalesce(plant_name, 'NO_DATA_FOUND') || ' (' || carrier_status || ').' else po_number || '/' || line_item || ' is on track.' end as recommendation from ruled"""


STAR_TABLES = ["po_lines", "asn_ibd", "carrier_events", "idoc_errors", "po_partners", "exceptions", "suppliers", "materials", "plants"]
#: What the enriched lines take from tables of many columns.
STAR_COLUMNS = {
    "po_lines": ["po_number", "line_item", "supplier_id", "material_id", "plant"], "exceptions": ["po_number", "line_item", "exception_id"], "idoc_errors": ["po_number", "line_item"],
    "asn_ibd": ["delivery", "item", "reference_document", "reference_item", "actual_delivery_qty", "goods_movement_status", "bill_of_lading"],
}


def register_offline() -> None:
    """Queries whose SQL builds on that of the enriched lines."""
    from .queries import ENRICHED, FUNCTIONS, NOTED, RUN_TIME, SUPPLIERS, _star

    @query("," + ENRICHED + "select po_number, line_item, cast(ibd_qty as double) as ibd_qty, delivery, supplier_name, carrier_status, n_errors, eligible, coalesce(exception_id, 0) as exception_id from star")
    def star_co_located(t):
        """The enriched lines from tables in buckets of their orders."""
        buckets = layout.buckets_for(t.lineitem)
        b = layout.co_located(t, STAR_TABLES, buckets, STAR_COLUMNS)
        rows = classify.enriched_lines(b.po_lines, b, FUNCTIONS, SUPPLIERS, buckets)
        return rows.select("po_number", "line_item", "ibd_qty", "delivery", "supplier_name", "carrier_status", "n_errors", "eligible", F.coalesce("exception_id", F.lit(0)).alias("exception_id"))

    @query(_by_rules())
    def classification_by_rules(t):
        return offline.first_match(_star(t), _rules(t)).select("po_number", "line_item", "exception_type", "priority", F.coalesce("priority_score", F.lit(0)).alias("priority_score"), "recommendation")

    @query("," + ENRICHED + NOTED + """select 'run-7' as run_id, 'SUCCESS' as status, count(*) as total, count(*) filter (where len(notes) > 0) as processed, count(*) filter (where len(notes) > 0 and exception_id is null) as created,
count(*) filter (where len(notes) > 0 and exception_id is not null) as updated, 0 as skipped, count(*) filter (where len(notes) = 0) as for_review from noted""")
    def classification_run(t):
        """One call that classifies, persists and logs; it is repeated under its id, which changes nothing."""
        spark = t._spark
        tables = {k: shared_folder(spark, k) for k in ("exceptions", "lines", "runs")}
        files.write_version(t.po_lines, tables["lines"], 1)
        t._made["po_lines"] = files.read_version(spark, tables["lines"])  # exceptions are derived from lines
        files.write_version(t.exceptions, tables["exceptions"], 1)
        for _ in range(2):
            out = offline.run(t, tables, "run-7", FUNCTIONS, SUPPLIERS, AS_OF_ORDERS, RUN_TIME)
        return out.drop("message")


@query(f"select id from carrier_events where event_time >= timestamp '{AS_OF_EVENTS}' - interval 1440 minute and event_time <= timestamp '{AS_OF_EVENTS}'")
def event_lookback_by_day(t):
    """A look-back over events by day, which reads the folders of two days."""
    path = shared_folder(t._spark, "events-by-day")
    layout.write_by_day(t.carrier_events.select("id", F.col("event_time").cast("timestamp").alias("event_time")), path, "event_time")
    since = (datetime.fromisoformat(AS_OF_EVENTS) - timedelta(minutes=1440)).isoformat(sep=" ")
    return layout.read_days(t._spark, path, "event_time", since, AS_OF_EVENTS).select("id")
