"""Queries of the mappers and sync chains: source documents are made from the domain tables, mapped and merged back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .operators import relational
from .plans import sync
from .plans.bridge import AS_OF_EVENTS
from .registry import query
from .sources import documents

RUN = "2024-03-01 00:00:00"


def _parsed(rows, schema: str, fields: dict):
    """Documents of the schema, by way of JSON as a source sends it. inline keeps filters on them from being pushed below, where each
    would make and parse a text of its own."""
    text = F.to_json(F.struct(*[v.alias(c) for c, v in fields.items()]))
    return rows.select(F.inline(F.array(F.from_json(text, schema))))


def _event_documents(t):
    """A document for each carrier event, with two items that differ in their description alone, and one event in nine without items."""
    item = lambda text, po: F.struct(po.alias("poNumber"), F.lit("S1").alias("skuNumber"), F.lit(text).alias("description"), F.col("actual_quantity").cast("string").alias("actualQuantity"), F.lit("x").alias("actualWeight"), F.lit("LB").alias("actualWeightUnitOfMeasure"))
    both = F.array(item("part", F.col("po_number")), item("p" * 300, F.lit("")))
    place = F.struct(F.lit("dock").alias("name"), F.struct(F.lit("Kim").alias("name"), F.lit("555").alias("phoneNumber"), F.lit("").alias("email")).alias("locationContact"))
    event = F.struct(
        F.col("event_type").alias("eventType"), F.col("load_number").alias("loadNumber"), F.date_format("delivery_by_date", "yyyy-MM-dd").alias("deliveryByDate"),
        F.array(F.struct(F.col("order_number").alias("orderNumber"), F.repeat(F.col("tracking_number"), 20).alias("navisphereTrackingNumber"))).alias("orderDetails"), F.array(F.struct(place.alias("location"))).alias("stops"),
        F.when(F.col("event_key") % 9 != 0, both).otherwise(F.slice(both, 1, 0)).alias("items"),
    )
    fields = {"customer": F.when(F.col("event_key") % 4 == 0, "other").otherwise("c1"), "eventTime": F.date_format("event_time", "yyyy-MM-dd'T'HH:mm:ss'Z'"), "customerReferenceNumber": F.col("id"), "event": event}
    return _parsed(t.carrier_events, documents.EVENT_SCHEMA, fields)


ITEMS = """parts as (select *, strftime(event_time, '%Y-%m-%dT%H:%M:%S') || '.000Z' as iso, case d when 1 then 'part' else repeat('p', 300) end as txt, case d when 1 then po_number end as po from carrier_events, (values (1), (2)) v(d) where event_key % 9 <> 0),
hashed as (select *, sha256(order_number || '|' || iso || '|' || event_type || '|' || load_number || '|' || coalesce(po, '') || '|S1|' || txt) as source_hash from parts)"""
OPEN = "(select distinct po_number from po_lines where po_status = 'OPEN')"


@query(f""", {ITEMS} select id as customer_reference_number, strftime(event_time, '%Y-%m-%d %H:%M:%S') as event_time, event_type, event_type as status, po as po_number, coalesce(po in {OPEN}, false) as po_linked, order_number, load_number, repeat(tracking_number, 20)[1:30] as navisphere_tracking_number,
strftime(delivery_by_date, '%Y-%m-%d') || ' 00:00:00' as delivery_by_date, 'dock' as location_name, 'Kim' as location_contact_name, '555' as location_contact_phone, cast(null as varchar) as location_contact_email, txt[1:255] as description, 'S1' as sku_number, cast(actual_quantity as double) as actual_quantity, cast(null as double) as actual_weight, 'LB' as actual_weight_uom, source_hash from hashed""")
def carrier_documents_flattened(t):
    rows = documents.flatten_events(_event_documents(t), sync.open_orders(t.po_lines))
    return rows.select(
        "customer_reference_number", "event_time", "event_type", "status", "po_number", "po_linked", "order_number", "load_number", "navisphere_tracking_number", "delivery_by_date", "location_name", "location_contact_name", "location_contact_phone",
        "location_contact_email", "description", "sku_number", "actual_quantity", "actual_weight", "actual_weight_uom", "source_hash",
    )


KEPT_EVENTS = f"(select distinct source_hash, po, order_number, event_type, txt from hashed where event_time >= timestamp '{AS_OF_EVENTS}' - interval 1440 minute and event_key % 4 <> 0)"


def _events_run(t):
    whole = documents.event_rows(_event_documents(t))
    before = whole.filter("sku_number = 'S1' and description = 'part' and event_type = 'Delayed'").groupBy("source_hash").agg(F.min("po_number").alias("po_number")).withColumn("id", F.concat(F.lit("old-"), F.substring("source_hash", 1, 8)))
    return sync.carrier_events(before, _event_documents(t), t.po_lines, AS_OF_EVENTS, 1440, "c1")


@query(f""", {ITEMS}, old as (select distinct source_hash, po from hashed where txt = 'part' and event_type = 'Delayed'), new as {KEPT_EVENTS}
select coalesce(o.source_hash, n.source_hash) as source_hash, coalesce('old-' || o.source_hash[1:8], n.source_hash[1:32]) as id, coalesce(n.po, o.po) as po_number, n.event_type, n.txt[1:255] as description, case when n.source_hash is not null then coalesce(n.po in {OPEN}, false) end as po_linked from old o full join new n on n.source_hash = o.source_hash""")
def carrier_events_synced(t):
    return _events_run(t)[0].select("source_hash", "id", "po_number", "event_type", "description", "po_linked")


@query(f""", {ITEMS}, new as {KEPT_EVENTS}, hit as (select distinct po from new where po in {OPEN} and not (txt = 'part' and event_type = 'Delayed'))
select po_number, line_item, case when due then false else ai_processed end as ai_processed, case when due then true else ai_reanalysis_needed end as ai_reanalysis_needed from (select *, po_status = 'OPEN' and (ai_processed or ai_processed_at is not null) and po_number in (select po from hit) as due from po_lines)""")
def carrier_events_reanalysis(t):
    return _events_run(t)[1].select("po_number", "line_item", "ai_processed", "ai_reanalysis_needed")


@query(f""", {ITEMS}, kept as (select * from hashed where event_time >= timestamp '{AS_OF_EVENTS}' - interval 1440 minute and event_key % 4 <> 0)
select 'description' as field, count(*) as n, cast(300 as bigint) as longest from kept where txt <> 'part' having count(*) > 0 union all select 'navisphere_tracking_number', count(*), cast(max(length(tracking_number) * 20) as bigint) from kept where length(tracking_number) * 20 > 30 having count(*) > 0""")
def carrier_events_truncated(t):
    return _events_run(t)[2]


def _plant_documents(t):
    return _parsed(t.plants.filter("plant_code <> '05'").withColumn("plant_name", F.when(F.col("plant_code") == "07", "New name").otherwise(F.col("plant_name"))), documents.PLANT_SCHEMA, {"Plant": F.when(F.col("plant_code") == "09", "").otherwise(F.col("plant_code")), "PlantName": F.col("plant_name"), "StreetName": F.lit(""), "StreetAddressName": F.lit("Main 1"), "Region": F.col("region")})


@query(f"""select plant_code, case when plant_code = '07' then 'New name' else plant_name end as plant_name, case when plant_code not in ('05', '09') then 'Main 1' end as street_and_house_number, plant_code not in ('05', '09') as is_active,
case when plant_code not in ('05', '09') then '{RUN}' else strftime(last_synced_at, '%Y-%m-%d %H:%M:%S') end as last_synced_at from plants""")
def plants_synced(t):
    return sync.plants(t.plants, _plant_documents(t), RUN).select("plant_code", "plant_name", "street_and_house_number", "is_active", "last_synced_at")


@query("select count(*) - 1 as documents, count(*) - 2 as mapped, cast(1 as bigint) as skipped from plants")
def mapper_skips(t):
    source = _plant_documents(t)
    return documents.skipped(source, documents.map_plants(source))


def _product_documents(t, rows):
    text = lambda language, c: F.struct(F.lit(language).alias("Language"), c.alias("ProductDescription"))
    several = F.when(F.col("n") % 3 == 0, F.array(text("DE", F.lit("deutsch")), text("EN", F.col("material_description")))).when(F.col("n") % 3 == 1, F.array(text("FR", F.lit("fr")), text("en-US", F.lit("us")))).otherwise(F.array(text("DE", F.lit("de"))))
    return _parsed(rows, documents.PRODUCT_SCHEMA, {"Product": F.col("material"), "ProductType": F.col("material_type"), "CreationDate": F.lit("20240102"), "ProductGroup": F.lit(""), "BaseUnit": F.lit("EA"), "to_Description": several})


@query(f"""select material, case n % 3 when 0 then case n % 2 when 0 then material_description else material_description end when 1 then case n % 2 when 0 then 'us' else material_description end else case n % 2 when 0 then 'de' else material_description end end as material_description,
case n % 2 when 0 then 'EA' end as base_unit_of_measure, case n % 2 when 0 then '2024-01-02 00:00:00' end as created_on, n % 2 = 0 as is_active from (select *, cast(material as bigint) as n from materials)""")
def materials_synced(t):
    rows = t.materials.withColumn("n", F.col("material").cast("long"))
    before = t.materials.withColumns({"is_active": F.lit(True), "last_synced_at": F.lit("2023-01-01").cast("timestamp")})
    out = sync.materials(before, _product_documents(t, rows.filter("n % 2 = 0")), RUN)
    return out.select("material", "material_description", "base_unit_of_measure", "created_on", "is_active")


@query("select material from materials where cast(material as bigint) % 5 = 0")
def materials_changed_since(t):
    rows = t.materials.withColumn("LastChangeDateTime", F.when(F.col("material").cast("long") % 5 == 0, F.lit("2024-02-01").cast("timestamp")).otherwise(F.lit("2024-01-01").cast("timestamp")))
    return sync.changed_since(rows, "2024-01-15").select("material")


@query(f"""select supplier, case n % 3 when 0 then 'Org ' || n when 1 then 'Name ' || n else 'Full' end as name, case n % 3 when 0 then 'DE' when 1 then 'US' end as country_region_key, case n % 3 when 0 then 'Berlin' end as city, case n % 3 when 0 then 'a' || n || '@x.org' end as clerk_internet_address,
'C1' as company_code, case n % 3 when 2 then 20240201 else 20240102 end as created_on, true as is_active, '{RUN}' as last_synced_at from (select *, cast(supplier as bigint) as n from suppliers)""")
def suppliers_synced(t):
    rows = t.suppliers.withColumn("n", F.col("supplier").cast("long"))
    n = F.col("n").cast("string")
    mine = _parsed(rows, documents.SUPPLIER_SCHEMA, {
        "Supplier": F.col("supplier"), "SupplierName": F.when(F.col("n") % 3 == 1, F.concat(F.lit(" Name "), n, F.lit(" "))).otherwise(""), "SupplierFullName": F.lit(" Full "), "CreationDate": F.lit("2024-02-01"),
        "to_SupplierCompany": F.array(F.struct(F.lit("C1").alias("CompanyCode")), F.struct(F.lit("C2").alias("CompanyCode"))),
    })
    mail = lambda c: F.array(F.struct(c.alias("EmailAddress")))
    place = lambda use, country, city, c: F.struct(F.lit(use).alias("StandardUsage"), F.lit(country).alias("Country"), F.lit(city).alias("CityName"), mail(c).alias("to_EmailAddress"))
    addresses = F.when(F.col("n") % 3 == 0, F.array(place("", "FR", "Paris", F.lit("p")), place("X", "DE", "Berlin", F.concat(F.lit("a"), n, F.lit("@x.org")))))
    partner = {"OrganizationBPName1": F.when(F.col("n") % 3 == 0, F.concat(F.lit("Org "), n)), "Country": F.lit("US"), "CreationDate": F.lit("2024-01-02"), "to_BusinessPartnerAddress": addresses}
    some = rows.filter("n % 3 <> 2")
    partners = _parsed(some, documents.BUSINESS_PARTNER_SCHEMA, {"BusinessPartner": n} | partner)  # without the suppliers' leading zeros
    before = t.suppliers.filter("cast(supplier as bigint) % 2 = 0").withColumns({"is_active": F.lit(False), "last_synced_at": F.lit(None).cast("timestamp")})
    out = sync.suppliers(before, mine, partners, RUN)
    return out.select("supplier", "name", "country_region_key", "city", "clerk_internet_address", "company_code", "created_on", "is_active", "last_synced_at")


def _order_items(t):
    """Source items of order lines: two schedule lines each, some delivered, deleted or without supplier."""
    rows = t.po_lines
    k = F.col("order_key")
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    line = lambda date, n: F.struct(date.alias("ScheduleLineDeliveryDate"), F.lit(n).alias("OpenPurchaseOrderQuantity"))
    lines = F.array(line(F.lit(None).cast("string"), "99"), line(day(F.date_add("delivery_date", 5)), "2"), line(day("delivery_date"), "1"))
    head = F.struct(F.when(k % 4 == 0, " ").otherwise(F.col("supplier_id")).alias("Supplier"), F.lit("P1").alias("SupplyingPlant"), day("doc_date").alias("PurchaseOrderDate"), day("created_at").alias("CreationDate"), F.col("doc_type").alias("PurchaseOrderType"), F.lit("EUR").alias("DocumentCurrency"))
    return _parsed(rows, documents.ITEM_SCHEMA, {
        "PurchaseOrder": F.col("po_number"), "PurchaseOrderItem": (F.col("line_number") * 10).cast("string"), "Material": F.col("material_id"), "Plant": F.col("plant"), "OrderQuantity": F.col("po_qty").cast("string"), "NetPriceAmount": F.col("net_price").cast("string"),
        "DocumentCurrency": F.lit(""), "to_PurchaseOrder": head, "to_ScheduleLine": lines, "IsCompletelyDelivered": k % 6 == 1, "PurchasingDocumentDeletionCode": F.when(k % 6 == 2, "L").otherwise(""), "AccountAssignmentCategory": F.lit(""),
    })


SENT = "order_key % 6 not in (1, 2)"


@query(f"""select po_number, line_item, case when order_key % 4 = 0 then 'P1' else supplier_id end as supplier_id, cast(po_qty as double) as po_qty, 'EUR' as currency, strftime(delivery_date, '%Y-%m-%d') || ' 00:00:00' as delivery_date, cast(1 as double) as open_qty, is_intracompany_transfer, doc_type from po_lines where {SENT}""")
def order_items_mapped(t):
    return documents.map_order_items(_order_items(t)).select("po_number", "line_item", "supplier_id", "po_qty", "currency", "delivery_date", "open_qty", "is_intracompany_transfer", "doc_type")


def _lines_run(t):
    return sync.order_lines(t.po_lines, t.exceptions, _order_items(t), t.asn_ibd, RUN)


@query(f"""select po_number, line_item, case when {SENT} then 'OPEN' when po_status = 'OPEN' then 'CLOSED' else po_status end as po_status, case when {SENT} then '{RUN}' end as last_synced_at, case when {SENT} then 'EUR' else currency end as currency from po_lines""")
def order_lines_synced(t):
    return _lines_run(t)[0].select("po_number", "line_item", "po_status", "last_synced_at", "currency")


@query(f"select exception_id from exceptions e where not exists (select 1 from po_lines l where l.po_number = e.po_number and l.line_item = e.line_item and po_status = 'OPEN' and not ({SENT}))")
def order_lines_synced_exceptions(t):
    return _lines_run(t)[1].select("exception_id")


@query(f"""select po_number, partner_function, partner_counter, supplier, case when k % 2 = 0 and o then '{RUN}' end as last_synced_at from (select *, cast(po_number as bigint) as k, po_number in {OPEN} as o from po_partners) where not (o and k % 2 = 1)""")
def partners_synced(t):
    source = _parsed(t.po_partners.filter("cast(po_number as bigint) % 2 = 0"), documents.PARTNER_SCHEMA, {"PurchaseOrder": F.col("po_number"), "PartnerFunction": F.col("partner_function"), "PartnerCounter": F.col("partner_counter"), "Supplier": F.col("supplier"), "DefaultPartner": F.lit("X")})
    before = t.po_partners.withColumn("last_synced_at", F.lit(None).cast("timestamp"))
    return sync.partners(before, source, t.po_lines, RUN).select("po_number", "partner_function", "partner_counter", "supplier", "last_synced_at")


def _delivery_run(t):
    rows = t.asn_ibd.filter("cast(delivery as bigint) % 3 <> 0")
    items = _parsed(rows, documents.DELIVERY_ITEM_SCHEMA, {
        "DeliveryDocument": F.col("delivery"), "DeliveryDocumentItem": F.concat(F.lit(" "), "item"), "OriginalDeliveryQuantity": F.lit(None).cast("string"), "DeliveryQuantity": F.lit("3"), "ActualDeliveryQuantity": (F.col("actual_delivery_qty") + 1).cast("string"),
        "ReferenceSDDocument": F.lit(""), "PurchaseOrder": F.col("reference_document"), "PurchaseOrderItem": F.col("reference_item").cast("int").cast("string"), "GoodsMovementStatus": F.col("goods_movement_status"),
    })
    heads = _parsed(rows.select("delivery").distinct(), documents.DELIVERY_HEADER_SCHEMA, {"DeliveryDocument": F.col("delivery"), "OverallSDProcessStatus": F.lit(""), "OverallGoodsMovementStatus": F.lit("B"), "CreationDate": F.lit("20240102"), "CreationTime": F.lit("PT3H4M5S"), "ExternalDeliveryID": F.lit("x1")})
    return sync.deliveries(t.asn_ibd.withColumn("last_synced_at", F.lit(None).cast("timestamp")), items, heads, t.po_lines, RUN)


DELIVERED = f"""run as (select *, reference_document in {OPEN} as o, cast(delivery as bigint) % 3 <> 0 as sent from asn_ibd), after_run as (select delivery, item, reference_document, reference_item, goods_movement_status, case when o and sent then actual_delivery_qty + 1 else actual_delivery_qty end as actual_delivery_qty, o and sent as touched from run where not (o and not sent))"""


@query(f", {DELIVERED} select delivery, item, reference_document, reference_item, cast(actual_delivery_qty as double) as actual_delivery_qty, case when touched then 'B' end as overall_status, case when touched then '2024-01-02 03:04:05' end as created_on, case when touched then 'x1' end as external_delivery_id, case when touched then 3.0 end as delivery_quantity from after_run")
def deliveries_synced(t):
    return _delivery_run(t)[0].select("delivery", "item", "reference_document", "reference_item", "actual_delivery_qty", "overall_status", "created_on", "external_delivery_id", F.col("delivery_quantity").cast("double").alias("delivery_quantity"))


@query(f""", {DELIVERED}, q as (select reference_document as d, reference_item as i, sum(actual_delivery_qty) as received, coalesce(sum(case when goods_movement_status = 'C' then actual_delivery_qty end), 0) as posted from after_run group by 1, 2)
select po_number, line_item, cast(case when q.d is null or po_status <> 'OPEN' then received_qty_so_far else received end as double) as received_qty_so_far, case when q.d is null or po_status <> 'OPEN' then ai_reanalysis_needed else ai_reanalysis_needed or ((ai_processed or ai_processed_at is not null) and (received <> received_qty_so_far or posted <> gr_qty or greatest(0, po_qty - posted) <> open_qty)) end as ai_reanalysis_needed
from po_lines l left join q on q.d = l.po_number and q.i = l.line_item""")
def deliveries_synced_lines(t):
    return _delivery_run(t)[1].select("po_number", "line_item", "received_qty_so_far", "ai_reanalysis_needed")


@query(f"""select docnum, po_number, line_item, case when sent and o and event_key % 4 = 0 then '53' else status end as status, case when sent and o then case when event_key % 4 = 0 then 'POSTED' when status = '53' then 'POSTED' when status = '56' then 'PENDING' when status = '60' then 'RETRYING' else 'ERROR' end end as status_group,
case when sent and o and event_key % 4 = 0 and status <> '53' then false when sent and o then event_key % 2 = 0 else event_key % 2 = 0 end as ai_processed, case when sent and o then '{RUN}' end as last_synced_at from (select *, event_key % 3 <> 0 and line_item <> '' as sent, po_number in {OPEN} as o from idoc_errors) where not (o and not sent)""")
def document_errors_synced(t):
    at = F.col("status_logdat")
    rows = t.idoc_errors.filter("event_key % 3 <> 0")
    source = _parsed(rows, documents.ERROR_SCHEMA, {
        "DOCNUM": F.col("docnum"), "PO": F.col("po_number"), "PO_Item": F.col("line_item"), "STATUS": F.when(F.col("event_key") % 4 == 0, "53").otherwise(F.col("status")), "ERROR_MSG": F.col("error_msg"), "CREDAT": F.lit("20200101"), "LOGDAT": F.date_format(at, "yyyyMMdd"), "LOGTIM": F.date_format(at, "HHmmss"),
    })
    before = t.idoc_errors.withColumns({"ai_processed": F.col("event_key") % 2 == 0, "status_logdat": F.date_trunc("second", "status_logdat"), "last_synced_at": F.lit(None).cast("timestamp")})
    return sync.document_errors(before, source, t.po_lines, RUN).select("docnum", "po_number", "line_item", "status", "status_group", "ai_processed", "last_synced_at")


@query("""select po_number as "Purchasing Document", line_item as "Item", supplier_id as "Supplier", qty as "Delivery Quantity", '' as "Bill of Lading", plant as "Plant", cast(null as varchar) as "Storage Location", '' as "Means-of-Trans. Type", '' as "Means of Transport", reference as "Reference", cast(45000 as bigint) as "Delivery Date"
from (select po_number, line_item, supplier_id, cast(po_qty as double) as qty, plant, 'R' || order_key as reference from po_lines where order_key % 2 = 0)""")
def template_workbook(t):
    rows = t.po_lines.select("po_number", "line_item", "supplier_id", F.col("po_qty").cast("double").alias("delivery_quantity"), F.lit(45000).cast("long").alias("delivery_date"), F.concat(F.lit("R"), F.col("order_key").cast("string")).alias("reference"), F.when(F.col("order_key") % 2 == 1, "line").alias("missing"))
    return relational.workbook_rows(rows, t.po_lines)


CATALOGUE = {"plants": ["plant_code", "plant_name", "region", "is_active", "last_synced_at"], "suppliers": ["supplier", "name", "name_2", "country_region_key", "clerk_internet_address"], "materials": ["material", "material_type", "material_group", "material_description"]}


@query(" union all ".join(f"select '{t}' as table_name, '{c}' as column_name, {str(c == columns[0]).lower()} as is_key, true as read_only, count({c}) as filled, count(*) as rows from {t}" for t, columns in CATALOGUE.items() for c in columns))
def schema_catalogue(t):
    """Each column with its key mark and how many rows have a value."""
    from .operators.adhoc import upload_meta

    return upload_meta({name: getattr(t, name) for name in CATALOGUE}, {name: columns[:1] for name, columns in CATALOGUE.items()}).drop("kind")


@query("select 'plants' as source, count(*) as n from plants union all select 'po_lines', count(*) from po_lines union all select 'carrier_events', count(*) from carrier_events")
def source_counts(t):
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), "n")
    return one("plants", t.plants).unionByName(one("po_lines", t.po_lines)).unionByName(one("carrier_events", t.carrier_events))
