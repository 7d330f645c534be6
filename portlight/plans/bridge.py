"""Domain tables (purchase-order lines, deliveries, events ...) derived from the star-schema test tables.

The derivations are plain SQL that Spark and the SQL oracle both read; {name} stands for a source table or an earlier one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SOURCES = ("region", "nation", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Reference dates that queries take as a parameter, so results don't depend on the day.
AS_OF_ORDERS, AS_OF_EVENTS = "1998-06-01", "2024-01-30"

TABLES = {
    "plants": """select lpad(cast(n_nationkey as string), 2, '0') as plant_code, n_name as plant_name, r_name as region, true as is_active,
        case when n_nationkey % 3 = 0 then null else cast('2024-01-01 00:00:00' as timestamp) end as last_synced_at
        from {nation} join {region} on n_regionkey = r_regionkey""",
    "suppliers": """select lpad(cast(s_suppkey as string), 10, '0') as supplier, s_name as name, case when s_suppkey % 3 = 0 then '' else concat('Branch ', cast(s_suppkey % 7 as string)) end as name_2,
        lpad(cast(s_nationkey as string), 2, '0') as country_region_key,
        case when s_suppkey % 4 = 0 then null else concat('clerk', cast(s_suppkey as string), '@example.com') end as clerk_internet_address from {supplier}""",
    "materials": """select lpad(cast(p_partkey as string), 18, '0') as material, p_type as material_type, p_brand as material_group, p_name as material_description from {part}""",
    "po_lines": """select cast(4500000000 + l_orderkey as string) as po_number, lpad(cast(l_linenumber * 10 as string), 5, '0') as line_item,
        lpad(cast(l_partkey as string), 18, '0') as material_id, lpad(cast(l_suppkey as string), 10, '0') as supplier_id, lpad(cast(s_nationkey as string), 2, '0') as plant,
        cast(qty as decimal(13,3)) as po_qty, cast(qty as decimal(13,3)) as open_qty, cast(0 as decimal(13,3)) as received_qty_so_far, cast(0 as decimal(13,3)) as gr_qty,
        cast(price as decimal(12,2)) as net_price, 'USD' as currency, ship as delivery_date, o_orderdate as created_at,
        concat('G', cast(l_partkey % 20 as string)) as material_group, case when l_partkey % 5 = 0 then '' else 'EA' end as po_uom, case when l_orderkey % 9 = 0 then 'UB' else 'NB' end as doc_type, o_orderdate as doc_date,
        case when l_suppkey % 4 = 0 then null else concat('U', cast(l_suppkey % 10 as string)) end as created_by, '1000' as company_code, concat('P', cast(l_suppkey % 3 as string)) as purch_group, ship - interval 2 day as ship_date, l_orderkey % 9 = 0 as is_intracompany_transfer,
        case o_orderstatus when 'O' then 'OPEN' when 'P' then 'GR_POSTED' else 'CLOSED' end as po_status, l_orderkey % 3 = 0 as ai_processed,
        case when l_orderkey % 3 = 0 or l_orderkey % 7 = 0 then o_orderdate + interval 1 day end as ai_processed_at, l_orderkey % 6 = 0 as ai_reanalysis_needed, l_orderkey as order_key, l_linenumber as line_number
        from (select l_orderkey, l_linenumber, min(l_partkey) as l_partkey, min(l_suppkey) as l_suppkey, sum(cast(l_quantity as decimal(13,3))) as qty, min(cast(l_extendedprice as decimal(12,2))) as price,
          min(l_shipdate) as ship from {lineitem} group by l_orderkey, l_linenumber) x
        join {orders} on l_orderkey = o_orderkey join {supplier} on l_suppkey = s_suppkey""",
    "asn_ibd": """select cast(180000000 + l_orderkey as string) as delivery, lpad(cast(10 * row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) as string), 6, '0') as item,
        cast(4500000000 + l_orderkey as string) as reference_document, lpad(cast(l_linenumber * 10 as string), 5, '0') as reference_item, cast(l_quantity as decimal(13,3)) as actual_delivery_qty,
        case l_returnflag when 'R' then 'C' when 'A' then 'B' else 'A' end as goods_movement_status, concat('BOL', cast(l_suppkey as string)) as bill_of_lading, l_shipdate as delivery_date, lpad(cast(l_suppkey % 25 as string), 2, '0') as plant
        from {lineitem} where l_linestatus = 'F' and l_orderkey % 4 <> 0""",
    "po_partners": """select cast(4500000000 + o_orderkey as string) as po_number, case o_custkey % 3 when 0 then 'FS' when 1 then 'LF' else 'fs ' end as partner_function, '001' as partner_counter,
        case when o_orderkey % 2 = 0 then '1000122' else '2000000' end as supplier from {orders}""",
    "carrier_events": """select cast(event_id as string) as id, cast(4500000000 + event_id % greatest(1, n_orders / 20) as string) as po_number, ts as event_time,
        case event_type when 'click' then 'In Transit' when 'view' then 'Delivered' when 'purchase' then 'LOAD PICKED UP' when 'signup' then 'Booked' else 'Delayed' end as event_type,
        case when event_id % 5 = 0 then '' else case event_type when 'click' then 'In Transit' when 'view' then 'Delivered' when 'purchase' then 'LOAD PICKED UP' when 'signup' then 'Booked' else 'Delayed' end end as status,
        concat('T', cast(user_id % 3 as string)) as tracking_number, concat('L', cast(user_id % 2 as string)) as load_number, cast(user_id % 5 as string) as order_number,
        case when event_id % 3 = 0 then '' else concat('R', cast(event_id % 100 as string)) end as customer_reference_number, cast(value as decimal(13,3)) as actual_quantity,
        case when event_id % 11 = 0 then null else ts + interval 2 day end as delivery_by_date, case when event_id % 2 = 0 then ts + interval 1 day end as delivery_available_by_date,
        case when event_id % 6 = 0 then concat('CO', cast(event_id % 50 as string)) end as customer_order_reference, event_id as event_key
        from {events} cross join (select cast(count(*) as bigint) as total, cast(floor(count(*)) as bigint) as n_orders from {orders}) o""",
    "idoc_errors": """select lpad(cast(event_id as string), 16, '0') as docnum, cast(4500000000 + event_id % 750 as string) as po_number,
        case when event_id % 5 = 0 then '' else lpad(cast((event_id % 7 + 1) * 10 as string), 5, '0') end as line_item,
        case event_id % 5 when 0 then '51' when 1 then '53' when 2 then '56' when 3 then '60' else '68' end as status, concat('E', cast(user_id % 9 as string)) as error_msg, ts as status_logdat, event_id as event_key
        from {events} where event_type = 'error'""",
    "exceptions": """select cast(order_key * 10 + line_number as bigint) as exception_id, po_number, line_item, supplier_id, plant, po_qty, delivery_date,
        case order_key % 5 when 0 then 'LATE_DELIVERY' when 1 then 'QTY_MISMATCH' when 2 then 'NO_ASN' when 3 then '' else null end as exception_type,
        case order_key % 4 when 0 then 'High' when 1 then ' medium' when 2 then 'LOW' else 'n/a' end as priority, case when line_number % 2 = 0 then 'ACTION_REQUIRED' else 'STATUS_REPORT' end as panel, order_key
        from {po_lines} where order_key % 2 = 1""",
    "execution_logs": """select event_id as run_id, ts as started_at, case when event_id % 9 = 0 then null else ts + interval 75 second end as completed_at, case user_id % 4 when 0 then 'alpha' when 1 then 'beta' when 2 then '' else null end as provider,
        concat('m', cast(user_id % 6 as string)) as model_id, cast(user_id % 3 as bigint) as ai_calls, case event_type when 'error' then 'failed' when 'view' then 'COMPLETED' when 'click' then 'in_progress' else 'success' end as status,
        case when event_id % 13 = 0 then null else cast(floor(value * 100) as bigint) end as total_tokens, event_id as event_key from {events}""",
    "feedback": """select event_id as id, event_id % 500 as exception_id, case when event_type in ('purchase', 'signup') then 'HELPFUL' when event_type = 'error' then 'NOT_HELPFUL' else 'OTHER' end as rating,
        case event_id % 4 when 0 then 'LATE_DELIVERY' when 1 then 'NO_ASN' when 2 then '' else null end as exception_type, case when event_id % 2 = 0 then props else ' ' end as comment, ts as created_at from {events}""",
}

#: Tables whose derivation groups a source by a key and more, and then joins it by the key.
DEALT = {"po_lines": ("lineitem", "l_orderkey")}


class Tables:
    """Domain tables by attribute, built lazily: only what a query reads is in its plan."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self._spark, self._dir, self._made = spark, sf_dir, {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in TABLES:
                text = TABLES[name]
                used = {x: getattr(self, x) for x in (*SOURCES, *TABLES) if "{" + x + "}" in text}
                if name in DEALT:  # once, for all that the derivation groups and joins by that key
                    source, key = DEALT[name]
                    used[source] = used[source].repartition(key)
                self._made[name] = self._spark.sql(text.replace("n_orders / 20", "(n_orders div 20)"), **used)
            else:
                self._made[name] = self._spark.read.parquet(f"{self._dir}/{name}.parquet")
        return self._made[name]


def oracle_prefix() -> str:
    """The same tables as common table expressions of the SQL oracle."""
    parts = []
    for name, text in TABLES.items():
        for x in (*SOURCES, *TABLES):
            text = text.replace("{" + x + "}", x)
        parts.append(f"{name} as ({text.replace('n_orders / 20', 'n_orders // 20')})")
    return "with " + ",\n".join(parts) + "\n"
