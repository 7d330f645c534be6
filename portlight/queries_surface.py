"""Queries of the read surface, requests as text, and of paged collections."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from .operators import surface
from .registry import query
from .sources import paged
from .sources.shared import shared_folder

NESTED = (
    "po_lines?$filter=(po_status eq 'OPEN' or po_status in ('GR_POSTED','CLOSED') and po_qty gt 40.5) and not (contains(material_id,'07') or plant eq '03') and delivery_date ge 1995-06-17T00:00:00Z"
    " and created_at lt datetime'1998-01-01T00:00:00' and (ai_processed_at eq null or year(ai_processed_at) ne 1997) and not is_intracompany_transfer and (indexof(po_number,'45') eq 0 and substring(line_item,2) le '040')"
    "&$select=po_number,line_item,plant,po_qty&$expand=supplier($select=name)&$orderby=plant desc,po_number"
)


@query("""select l.po_number, l.line_item, l.plant, cast(l.po_qty as double) as po_qty, s.name as supplier_name from po_lines l left join suppliers s on s.supplier = l.supplier_id
where (po_status = 'OPEN' or po_status in ('GR_POSTED', 'CLOSED') and po_qty > 40.5) and not (contains(material_id, '07') or plant = '03') and delivery_date >= timestamp '1995-06-17' and created_at < timestamp '1998-01-01'
and (ai_processed_at is null or year(ai_processed_at) <> 1997) and not is_intracompany_transfer and starts_with(po_number, '45') and line_item[3:] <= '040'""")
def surface_nested_filter(t):
    return surface.request(t, NESTED)[0].select("po_number", "line_item", "plant", "po_qty", F.col("supplier.name").alias("supplier_name"))


@query("select count(*) as total from po_lines l left join suppliers s on s.supplier = l.supplier_id left join plants p on p.plant_code = l.plant where (s.name_2 <> '' and lower(p.region) = 'asia' and (created_by is distinct from 'U3') and currency <> 'O''Hara') or length(trim(po_uom)) = 0")
def surface_count_by_association(t):
    return surface.request(t, "po_lines?$filter=(supplier/name_2 ne '' and tolower(plant_ref/region) eq 'asia' and (created_by ne 'U3') and currency ne 'O''Hara') or length(trim(po_uom)) eq 0&$count=true&$top=1")[1]


@query("""select * from (select row_number() over (order by delivery_date desc nulls last, po_qty nulls first, po_number, line_item) - 20 as place, po_number, line_item, cast(po_qty as double) as po_qty from po_lines where po_status <> 'CLOSED') where place between 1 and 30""")
def surface_page_in_order(t):
    """A page of thirty rows, with their places in it."""
    page = surface.request(t, "po_lines?$filter=po_status ne 'CLOSED'&$orderby=delivery_date desc,po_qty,po_number,line_item&$top=30&$skip=20&$select=po_number,line_item,po_qty,delivery_date")[0]
    order = [F.desc_nulls_last("delivery_date"), F.asc_nulls_first("po_qty"), "po_number", "line_item"]
    return page.withColumn("place", F.row_number().over(Window.orderBy(*order)).cast("long")).drop("delivery_date")


@query("""select po_number, line_item, coalesce(n, 0) as n, coalesce(deliveries, '') as deliveries from po_lines l left join (select reference_document, reference_item, count(*) as n, string_agg(delivery || '/' || item, ' ' order by rn) as deliveries from (
select *, row_number() over (partition by reference_document, reference_item order by actual_delivery_qty desc nulls last, delivery, item) as rn from asn_ibd where goods_movement_status <> 'A') where rn <= 2 group by 1, 2) a on a.reference_document = l.po_number and a.reference_item = l.line_item where plant = '07'""")
def surface_expanded_deliveries(t):
    rows = surface.request(t, "po_lines?$filter=plant eq '07'&$select=po_number,line_item&$expand=asns($filter=goods_movement_status ne 'A';$orderby=actual_delivery_qty desc,delivery,item;$top=2;$select=delivery,item)")[0]
    return rows.select("po_number", "line_item", F.size("asns").cast("long").alias("n"), F.array_join(F.transform("asns", lambda x: F.concat(x["delivery"], F.lit("/"), x["item"])), " ").alias("deliveries"))


@query("select event_key, id, po_number, event_type, tracking_number, cast(actual_quantity as double) as actual_quantity, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, strftime(delivery_by_date, '%Y-%m-%d %H:%M:%S') as delivery_by_date from carrier_events")
def pages_read_back(t):
    """Carrier events, landed as pages and read by ranges of pages."""
    columns = ["event_key", "id", "po_number", "event_type", "tracking_number", "actual_quantity", "event_time", "delivery_by_date"]
    rows = t.carrier_events.select(columns)
    path = shared_folder(t._spark, "pages")
    paged.land_pages(rows, path, ["event_key"], 500)
    return paged.read_landed(t._spark, path, rows.schema, 500)


@query("select id, po_number from (select *, row_number() over (order by event_key) as n from carrier_events) where n <= 1234 and event_type = 'Delivered' and event_key > 77")
def pages_capped_and_filtered(t):
    """The first rows of a collection up to a cap, its filters applied while pages are read."""
    rows = t.carrier_events.select("event_key", "id", "po_number", "event_type")
    path = shared_folder(t._spark, "pages")
    paged.land_pages(rows, path, ["event_key"], 500, with_count=False)
    return paged.read_landed(t._spark, path, rows.schema, 500, row_cap=1234).filter("event_type = 'Delivered' and event_key > 77").select("id", "po_number")
