"""Nested source documents to rows: order items, deliveries, document errors, partners, master data, carrier events.

Each mapper returns rows in the columns of its table; documents without their keys are left out, and skipped() counts them.
Empty texts count as missing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: The parts of a carrier event that are read; a declared schema keeps all else out.
LOCATION = "struct<name:string, locationContact:struct<name:string, phoneNumber:string, email:string>>"
EVENT_SCHEMA = f"""customer string, eventTime string, customerReferenceNumber string, billToReferenceNumber string, event struct<eventType:string, loadNumber:string, deliveryAvailableByDate:string, deliveryByDate:string,
orderDetails:array<struct<orderNumber:string, navisphereTrackingNumber:string, navisphereTrackingLink:string, customerOrderReferenceNumber:string>>, location:{LOCATION}, stops:array<struct<location:{LOCATION}>>, locations:array<{LOCATION}>,
items:array<struct<poNumber:string, skuNumber:string, description:string, freightClass:string, insuranceValue:string, actualQuantity:string, actualWeight:string, actualWeightUnitOfMeasure:string, actualPallets:string, actualVolume:string,
actualVolumeUnitOfMeasure:string>>>"""
#: Longest texts of event columns.
LIMITS = {
    "po_number": 50, "event_type": 50, "status": 50, "customer_reference_number": 50, "bill_to_reference_number": 200, "navisphere_tracking_number": 30, "navisphere_tracking_link": 500, "order_number": 20,
    "customer_order_reference": 50, "load_number": 20, "location_name": 100, "location_contact_name": 100, "location_contact_phone": 30, "location_contact_email": 100, "description": 255, "sku_number": 30, "freight_class": 10,
    "actual_weight_uom": 20, "actual_volume_uom": 20,
}

ITEM_SCHEMA = """PurchaseOrder string, PurchaseOrderItem string, Material string, Plant string, MaterialGroup string, OrderQuantity string, PurchaseOrderQuantityUnit string, NetPriceAmount string, DocumentCurrency string, ZZ1_ShipDate_PDI string,
to_PurchaseOrder struct<Supplier:string, SupplyingPlant:string, CreationDate:string, PurchaseOrderDate:string, PurchaseOrderType:string, DocumentCurrency:string, CreatedByUser:string, CompanyCode:string, PurchasingGroup:string>,
to_ScheduleLine array<struct<ScheduleLineDeliveryDate:string, OpenPurchaseOrderQuantity:string>>, IsCompletelyDelivered boolean, PurchasingDocumentDeletionCode string, AccountAssignmentCategory string"""
PRODUCT_SCHEMA = "Product string, CreationDate string, ProductType string, ProductGroup string, BaseUnit string, to_Description array<struct<Language:string, ProductDescription:string>>"
PLANT_SCHEMA = "Plant string, PlantName string, StreetName string, StreetAddressName string, PostalCode string, CityName string, Country string, Region string, PurchasingOrganization string, SalesOrganization string"
SUPPLIER_SCHEMA = "Supplier string, SupplierName string, SupplierFullName string, CreationDate string, to_SupplierCompany array<struct<CompanyCode:string, PaymentMethodsList:string, PaymentTerms:string>>"
BUSINESS_PARTNER_SCHEMA = """BusinessPartner string, OrganizationBPName1 string, OrganizationBPName2 string, BusinessPartnerFullName string, FirstName string, Country string, CreationDate string,
to_BusinessPartnerAddress array<struct<StandardUsage:string, Country:string, CityName:string, PostalCode:string, Region:string, StreetName:string, to_EmailAddress:array<struct<EmailAddress:string>>>>"""
PARTNER_SCHEMA = "PurchaseOrder string, PartnerFunction string, PartnerCounter string, Supplier string, Plant string, PurchasingOrganization string, CreatedByUser string, CreationDate string, DefaultPartner string"
DELIVERY_ITEM_SCHEMA = """DeliveryDocument string, DeliveryDocumentItem string, Material string, Plant string, OriginalDeliveryQuantity string, DeliveryQuantity string, ActualDeliveryQuantity string, ReferenceSDDocument string,
PurchaseOrder string, ReferenceSDDocumentItem string, PurchaseOrderItem string, GoodsMovementStatus string"""
DELIVERY_HEADER_SCHEMA = """DeliveryDocument string, OverallSDProcessStatus string, OverallGoodsMovementStatus string, BillOfLading string, DeliveryDate string, CreationDate string, CreationTime string, Supplier string,
DeliveryDocumentBySupplier string, ExternalDeliveryID string"""
ERROR_SCHEMA = "DOCNUM string, PO string, PO_Item string, STATUS string, STATUS_TXT string, ERROR_MSG string, BOLNR string, CREDAT string, CRETIM string, LOGDAT string, LOGTIM string"


def in_lookback(time: str, as_of: str, minutes: int, customer: str, wanted: str) -> Column:
    """Events of a customer, or of none, since so many minutes before as_of. There is no upper bound; no time, no event."""
    since = F.lit(as_of).cast("timestamp") - F.make_dt_interval(mins=F.lit(minutes))
    return (F.col(time) >= since) & (F.coalesce(F.col(customer), F.lit("")).isin("", wanted))


def iso_time(c: Column) -> Column:
    """A time as yyyy-mm-ddThh:mm:ss.mmmZ."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def event_rows(events: DataFrame) -> DataFrame:
    """One row for each item of an event (EVENT_SCHEMA), with whole texts; events without items have none.

    source_hash is taken of the raw values of order, time, type, load, order number, article and description, so it stays
    the same whatever the limits of columns are.
    """
    rows = events.select("*", F.explode("event.items").alias("item"))
    detail = F.get("event.orderDetails", F.lit(0))
    place = F.coalesce("event.location", F.get("event.stops", F.lit(0))["location"], F.get("event.locations", F.lit(0)))
    item = lambda c: F.col(f"item.{c}")
    number = lambda c: S.decimal_or_null(item(c))
    kind, time, po = S.blank_null("event.eventType"), S.timestamp("eventTime"), S.blank_null(item("poNumber"))
    text = lambda c: F.coalesce(c, F.lit(""))
    raw = [detail["orderNumber"], iso_time(time), kind, F.col("event.loadNumber"), po, item("skuNumber"), item("description")]
    contact = place["locationContact"]
    return rows.select(
        "customer", time.alias("event_time"), kind.alias("event_type"), kind.alias("status"), S.blank_null("customerReferenceNumber").alias("customer_reference_number"), S.blank_null("billToReferenceNumber").alias("bill_to_reference_number"),
        S.blank_null(detail["navisphereTrackingNumber"]).alias("navisphere_tracking_number"), S.blank_null(detail["navisphereTrackingLink"]).alias("navisphere_tracking_link"), detail["orderNumber"].alias("order_number"),
        S.blank_null(detail["customerOrderReferenceNumber"]).alias("customer_order_reference"), F.col("event.loadNumber").alias("load_number"), S.timestamp("event.deliveryAvailableByDate").alias("delivery_available_by_date"),
        S.timestamp("event.deliveryByDate").alias("delivery_by_date"), S.blank_null(place["name"]).alias("location_name"), S.blank_null(contact["name"]).alias("location_contact_name"), S.blank_null(contact["phoneNumber"]).alias("location_contact_phone"),
        S.blank_null(contact["email"]).alias("location_contact_email"), po.alias("po_number"), S.blank_null(item("description")).alias("description"), item("skuNumber").alias("sku_number"), item("freightClass").alias("freight_class"),
        number("insuranceValue").alias("insurance_value"), number("actualQuantity").alias("actual_quantity"), number("actualWeight").alias("actual_weight"), S.blank_null(item("actualWeightUnitOfMeasure")).alias("actual_weight_uom"),
        number("actualPallets").alias("actual_pallets"), number("actualVolume").alias("actual_volume"), S.blank_null(item("actualVolumeUnitOfMeasure")).alias("actual_volume_uom"),
        F.sha2(F.concat_ws("|", *map(text, raw)), 256).alias("source_hash"),
    )


def clamped(rows: DataFrame, limits: dict[str, int] = LIMITS) -> DataFrame:
    """Texts cut to their columns' limits."""
    return rows.withColumns({c: S.clamp(c, n) for c, n in limits.items() if c in rows.columns})


def flatten_events(events: DataFrame, open_orders: DataFrame | None = None) -> DataFrame:
    """event_rows with po_linked (whether the order, as sent, is one of open_orders) and texts cut to LIMITS."""
    rows = event_rows(events)
    if open_orders is not None:
        rows = rows.join(open_orders.select(F.col("po_number"), F.lit(True).alias("po_linked")).distinct(), "po_number", "left").withColumn("po_linked", F.coalesce("po_linked", F.lit(False)))
    return clamped(rows)


def map_order_items(items: DataFrame, since: str | None = None, until: str | None = None, intracompany: tuple[str, ...] = ("UB",)) -> DataFrame:
    """Open order items (ITEM_SCHEMA) as order lines: not delivered in full, not deleted, no account assignment. The delivery
    date is that of the earliest schedule line, else the order's date, else the day it was made."""
    test = ~F.coalesce("IsCompletelyDelivered", F.lit(False)) & (F.coalesce("PurchasingDocumentDeletionCode", F.lit("")) == "") & (F.coalesce("AccountAssignmentCategory", F.lit("")) == "")
    rows = items.filter(test & (F.coalesce("PurchaseOrder", F.lit("")) != ""))
    head = lambda c: F.col(f"to_PurchaseOrder.{c}")
    ordered, created = S.timestamp(head("PurchaseOrderDate")), S.timestamp(head("CreationDate"))
    if since:
        rows = rows.filter(F.coalesce(ordered, created) >= F.lit(since).cast("timestamp"))
    if until:
        rows = rows.filter(F.coalesce(ordered, created) <= F.lit(until).cast("timestamp"))
    dated = F.filter(F.transform("to_ScheduleLine", lambda x, i: F.struct(S.timestamp(x["ScheduleLineDeliveryDate"]).alias("at"), i.alias("i"), x["OpenPurchaseOrderQuantity"].alias("open"))), lambda x: x["at"].isNotNull())
    first = F.array_min(dated)
    return rows.select(
        F.trim("PurchaseOrder").alias("po_number"), S.line_item("PurchaseOrderItem").alias("line_item"), S.blank_null("Material").alias("material_id"), S.blank_null("Plant").alias("plant"), S.blank_null("MaterialGroup").alias("material_group"),
        S.first_text(F.trim(head("Supplier")), F.trim(head("SupplyingPlant"))).alias("supplier_id"), S.quantity("OrderQuantity").alias("po_qty"), S.blank_null("PurchaseOrderQuantityUnit").alias("po_uom"), S.quantity("NetPriceAmount", 2).alias("net_price"),
        S.blank_null(head("PurchaseOrderType")).alias("doc_type"), S.first_text("DocumentCurrency", head("DocumentCurrency")).alias("currency"), ordered.alias("doc_date"), created.alias("created_on"), S.blank_null(head("CreatedByUser")).alias("created_by"),
        S.blank_null(head("CompanyCode")).alias("company_code"), S.blank_null(head("PurchasingGroup")).alias("purch_group"), F.coalesce(first["at"], ordered, created).alias("delivery_date"), S.timestamp("ZZ1_ShipDate_PDI").alias("ship_date"),
        first["open"].try_cast("decimal(13,3)").alias("open_qty"), F.coalesce(head("PurchaseOrderType").isin(*intracompany), F.lit(False)).alias("is_intracompany_transfer"),
    )


def preferred(array, exact: Callable, prefix: Callable | None = None) -> Column:
    """The first element that `exact` admits, else the first that `prefix` admits, else the first."""
    found = [F.get(F.filter(array, exact), F.lit(0))] + ([F.get(F.filter(array, prefix), F.lit(0))] if prefix else []) + [F.get(array, F.lit(0))]
    return F.coalesce(*found)


def map_materials(products: DataFrame, language: str = "EN") -> DataFrame:
    """Products (PRODUCT_SCHEMA) with their description: in the language, else one that begins with it, else the first."""
    spoken = lambda x: F.upper(F.coalesce(x["Language"], F.lit("")))
    text = preferred("to_Description", lambda x: spoken(x) == language, lambda x: F.startswith(spoken(x), F.lit(language)))
    rows = products.filter(F.coalesce("Product", F.lit("")) != "")
    more = {"created_on": S.timestamp("CreationDate"), "material_group": S.blank_null("ProductGroup"), "base_unit_of_measure": S.blank_null("BaseUnit")} if "ProductGroup" in products.columns else {}
    return rows.select(F.col("Product").alias("material"), S.blank_null("ProductType").alias("material_type"), text["ProductDescription"].alias("material_description"), *[v.alias(c) for c, v in more.items()], F.lit(True).alias("is_active"))


def map_plants(plants: DataFrame) -> DataFrame:
    """Plants (PLANT_SCHEMA)."""
    names = {"plant_name": "PlantName", "post_code": "PostalCode", "city": "CityName", "country_region_key": "Country", "region": "Region", "purchasing_org": "PurchasingOrganization", "sales_org_icb": "SalesOrganization"}
    rows = plants.filter(F.coalesce("Plant", F.lit("")) != "")
    return rows.select(F.col("Plant").alias("plant_code"), *[S.blank_null(v).alias(c) for c, v in names.items()], S.first_text("StreetName", "StreetAddressName").alias("street_and_house_number"), F.lit(True).alias("is_active"))


def bare_key(c) -> Column:
    """A business key without blanks and leading zeros: what all ways to write it have in common."""
    return F.regexp_replace(F.trim(S.col(c)), "^0+", "")


def map_suppliers(suppliers: DataFrame, partners: DataFrame) -> DataFrame:
    """Suppliers (SUPPLIER_SCHEMA) with their business partners (BUSINESS_PARTNER_SCHEMA), whose numbers may differ in leading
    zeros; of several the equally written one, else the largest. The address is the standard one, else the first."""
    rows = suppliers.filter(F.coalesce("Supplier", F.lit("")) != "").withColumn("key_", bare_key("Supplier"))
    others = partners.filter(F.coalesce("BusinessPartner", F.lit("")) != "").select(bare_key("BusinessPartner").alias("key_"), F.struct(*partners.columns).alias("b"))
    best = F.max_by("b", F.struct((F.col("b.BusinessPartner") == F.col("Supplier")).alias("exact"), F.col("b.BusinessPartner"))).alias("b")
    rows = rows.join(others, "key_", "left").groupBy("Supplier", "SupplierName", "SupplierFullName", "CreationDate", "to_SupplierCompany").agg(best)
    address, company = preferred("b.to_BusinessPartnerAddress", lambda a: a["StandardUsage"] == "X"), F.get("to_SupplierCompany", F.lit(0))
    return rows.select(
        F.col("Supplier").alias("supplier"), S.first_text("b.OrganizationBPName1", F.trim("SupplierName"), "b.BusinessPartnerFullName", "b.FirstName", F.trim("SupplierFullName")).alias("name"), S.blank_null("b.OrganizationBPName2").alias("name_2"),
        S.first_text(address["Country"], "b.Country").alias("country_region_key"), S.blank_null(address["CityName"]).alias("city"), S.blank_null(address["PostalCode"]).alias("postal_code"), S.blank_null(address["Region"]).alias("region"),
        S.blank_null(address["StreetName"]).alias("street"), S.blank_null(company["CompanyCode"]).alias("company_code"), S.blank_null(company["PaymentMethodsList"]).alias("payment_methods"), S.blank_null(company["PaymentTerms"]).alias("terms_of_payment"),
        S.blank_null(F.get(address["to_EmailAddress"], F.lit(0))["EmailAddress"]).alias("clerk_internet_address"), S.date_number(S.timestamp(S.first_text("b.CreationDate", "CreationDate"))).alias("created_on"), F.lit(True).alias("is_active"),
    )


def map_partners(rows: DataFrame) -> DataFrame:
    """Partners of orders (PARTNER_SCHEMA)."""
    good = rows.filter((F.coalesce("PurchaseOrder", F.lit("")) != "") & (F.coalesce("PartnerFunction", F.lit("")) != ""))
    return good.select(
        F.col("PurchaseOrder").alias("po_number"), F.col("PartnerFunction").alias("partner_function"), F.coalesce("PartnerCounter", F.lit("1")).alias("partner_counter"), S.blank_null("Supplier").alias("supplier"), S.blank_null("Plant").alias("plant"),
        S.blank_null("PurchasingOrganization").alias("purchasing_org"), S.blank_null("CreatedByUser").alias("created_by"), S.timestamp("CreationDate").alias("created_on"), S.is_true("DefaultPartner").alias("default_partner"),
    )


def map_deliveries(items: DataFrame, headers: DataFrame) -> DataFrame:
    """Delivery items (DELIVERY_ITEM_SCHEMA) with their headers (DELIVERY_HEADER_SCHEMA); the referenced order is the
    document's, else the purchase order's. Items without a reference are left out."""
    rows = items.filter("DeliveryDocument <> '' and DeliveryDocumentItem <> ''").withColumns({"order_": S.first_text("ReferenceSDDocument", "PurchaseOrder"), "line_": S.first_text("ReferenceSDDocumentItem", "PurchaseOrderItem")})
    heads = headers.withColumnsRenamed({"Supplier": "head_supplier"})
    rows = rows.filter("order_ is not null and line_ is not null").join(heads, "DeliveryDocument", "left")
    return rows.select(
        F.col("DeliveryDocument").alias("delivery"), F.trim("DeliveryDocumentItem").alias("item"), S.blank_null("Material").alias("material"), S.blank_null("Plant").alias("plant"), F.col("order_").alias("reference_document"), S.line_item("line_").alias("reference_item"),
        S.decimal_or_null(F.coalesce("OriginalDeliveryQuantity", "DeliveryQuantity")).alias("delivery_quantity"), S.decimal_or_null("ActualDeliveryQuantity").alias("actual_delivery_qty"), S.blank_null("GoodsMovementStatus").alias("goods_movement_status"),
        S.first_text("OverallSDProcessStatus", "OverallGoodsMovementStatus").alias("overall_status"), S.blank_null("BillOfLading").alias("bill_of_lading"), S.timestamp("DeliveryDate").alias("delivery_date"),
        S.date_and_time("CreationDate", "CreationTime").alias("created_on"), S.clock_time("CreationTime").alias("time"), S.blank_null("head_supplier").alias("supplier"), S.first_text("DeliveryDocumentBySupplier", "ExternalDeliveryID").alias("external_delivery_id"),
    )


def map_document_errors(rows: DataFrame) -> DataFrame:
    """Errors of electronic documents (ERROR_SCHEMA); those without number, order or line are left out."""
    good = rows.filter((F.coalesce("DOCNUM", F.lit("")) != "") & (F.coalesce("PO", F.lit("")) != "") & S.line_item("PO_Item").isNotNull())
    return good.select(
        F.col("DOCNUM").alias("docnum"), F.col("PO").alias("po_number"), S.line_item("PO_Item").alias("line_item"), F.col("STATUS").alias("status"), S.blank_null("STATUS_TXT").alias("status_text"), S.blank_null("ERROR_MSG").alias("error_msg"),
        S.blank_null("BOLNR").alias("bill_of_lading"), S.date_and_time("CREDAT", "CRETIM").alias("idoc_credat"), S.date_and_time(S.first_text("LOGDAT", "CREDAT"), S.first_text("LOGTIM", "CRETIM")).alias("status_logdat"),
        F.coalesce(S.clock_time("LOGTIM"), S.clock_time("CRETIM")).alias("status_logtim"), S.document_group("STATUS").alias("status_group"),
    )


def skipped(documents: DataFrame, mapped: DataFrame) -> DataFrame:
    """One row: documents, mapped, skipped."""
    one = lambda df, c: df.agg(F.count("*").alias(c))
    return one(documents, "documents").crossJoin(one(mapped, "mapped")).withColumn("skipped", F.col("documents") - F.col("mapped"))  # one row each
