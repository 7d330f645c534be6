"""Queries that run the scalar functions over every row of a table, on texts made from its keys, with the values that must
come out of them in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import feedback, relational, reports
from .registry import query


def _keyed(t):
    return t.carrier_events.select(F.col("event_key").alias("k"), "event_time")


def _cases(column, *texts):
    """One of the texts, by the remainder of the key."""
    out = None
    for i, text in enumerate(texts):
        test = F.pmod(F.col("k"), F.lit(len(texts))) == i
        out = F.when(test, text) if out is None else out.when(test, text)
    return out.alias(column)


@query("""select event_key as k, case event_key % 4 when 0 then lpad(cast(event_key % 7000 as varchar), 5, '0') when 1 then '0012345678'[3:] when 2 then 'A-' || event_key when 3 then null end as line,
case event_key % 3 when 0 then 'HIGH' when 1 then 'NONE' end as priority, event_key % 3 = 0 as valid, 'a|' || event_key || '|' as key, 'a/' || event_key as parts, case event_key % 2 when 0 then repeat('x', 9) || '…' else 'short' end as cut,
'{"a":' || event_key || '}' as inside, case event_key % 5 when 0 then 'no name' when 1 then 'longer than 100' when 2 then 'letters, digits and spaces only' end as name_error,
case event_key % 5 when 0 then 'A (Active / ASN received)' when 1 then 'B (In process / in transit)' when 2 then 'C (Completed)' when 3 then 'Z' else 'No ASN' end as movement, case event_key % 3 when 0 then repeat('*', 16) end as secret,
case event_key % 3 when 0 then '2024-01-02T03:04:05' when 1 then '2024-01-02T03:04:05Z' end as iso, event_key % 6 < 4 as yes from carrier_events""")
def text_scalars(t):
    k = F.col("k").cast("string")
    none = F.lit(None).cast("string")
    rows = _keyed(t).select(
        "k", _cases("line_", F.concat(F.lit(" 000"), (F.col("k") % 7000).cast("string"), F.lit(" ")), F.lit("0012345678"), F.concat(F.lit("A-"), k), F.lit("  ")), _cases("priority_", F.lit(" high "), F.lit("none"), none),
        F.concat(F.lit(" a ,, "), k, F.lit(",")).alias("list_"), _cases("long_", F.repeat(F.lit("x"), 12), F.lit("short")), F.concat(F.lit('```json\n{"a":'), k, F.lit("}\n```")).alias("fenced_"),
        _cases("name_", F.lit("  "), F.repeat(F.lit("n"), 101), F.lit("a_b"), F.lit("Nightly 5"), F.lit("x")), _cases("code_", F.lit(" a"), F.lit("B"), F.lit("c "), F.lit("Z"), F.lit("")), _cases("secret_", F.lit("s"), none, F.lit("")),
        _cases("time_", F.lit("2024-01-02T03:04:05"), F.lit("2024-01-02 03:04:05"), F.lit("")), _cases("yes_", F.lit("TRUE"), F.lit("1"), F.lit(" x "), F.lit("Yes"), F.lit("y"), none),
    )
    return rows.select(
        "k", S.line_item("line_").alias("line"), S.priority("priority_").alias("priority"), S.is_priority("priority_").alias("valid"), S.composite_key(F.lit(" a "), F.col("k"), none).alias("key"), F.array_join(S.split_list("list_"), "/").alias("parts"),
        S.ellipsis("long_", 10).alias("cut"), S.without_fences("fenced_").alias("inside"), S.name_error("name_").alias("name_error"), S.movement_label("code_").alias("movement"), S.masked_secret("secret_").alias("secret"), S.iso_text("time_").alias("iso"), S.is_true("yes_").alias("yes"),
    )


@query("""select event_key as k, case event_key % 4 when 0 then event_key + 0.5 when 1 then 0 when 2 then 7 else 0 end as quantity, case event_key % 4 when 0 then event_key + 0.5 when 2 then 7 end as nullable, case event_key % 4 when 0 then cast(event_key as double) when 1 then -3.25 when 2 then 12 end as leading,
case event_key % 4 when 0 then 0.85 when 1 then 0.9 when 2 then 1 end as confidence, case event_key % 6 when 0 then event_key + 1 when 1 then 12 when 2 then 5 when 3 then 9 else 7 end as positive, case event_key % 2 when 0 then 50 else event_key + 3 end as tokens, ceil((event_key + 1) / 50) as pages,
cast(event_key % 3 = 2 as integer) as parsed_none, coalesce(case event_key % 3 when 0 then event_key when 1 then 17 end, -1) as parsed from carrier_events""")
def number_scalars(t):
    from .sources.files import parse_count

    k, none = F.col("k").cast("string"), F.lit(None).cast("string")
    rows = _keyed(t).select(
        "k", _cases("q_", F.concat(k, F.lit(".5")), F.lit("abc"), F.lit("7"), F.lit("")), _cases("n_", F.concat(k, F.lit(" pcs")), F.lit(" -3.25x"), F.lit("+12"), F.lit("x1")), _cases("c_", F.lit("85"), F.lit("0.9"), F.lit("1"), F.lit("")),
        _cases("p_", (F.col("k") + 1).cast("string"), F.lit('{"a":"x","b":0,"c":12.7}'), F.lit("5 days"), F.lit("9.9"), F.lit("-4"), none), _cases("total_", F.lit(50).cast("long"), F.lit(None).cast("long")), _cases("count_", F.concat(F.lit(" "), k), F.lit('{"d":{"__count":"17"}}'), F.lit("none")),
    )
    counted = parse_count("count_")
    return rows.select(
        "k", S.quantity("q_").cast("double").alias("quantity"), S.decimal_or_null("q_").cast("double").alias("nullable"), S.leading_number("n_").alias("leading"), S.confidence("c_").cast("double").alias("confidence"), S.positive_number("p_", 7).alias("positive"),
        S.token_total("total_", F.col("k"), F.lit(3).cast("long")).alias("tokens"), reports.page_estimate(F.col("k") + 1, 50).cast("double").alias("pages"), counted.isNull().cast("int").alias("parsed_none"), F.coalesce(counted, F.lit(-1).cast("long")).alias("parsed"),
    )


FORMS = [
    ("epoch", lambda d: F.concat(F.lit("/Date("), (F.unix_seconds(d) * 1000).cast("string"), F.lit(")/"))), ("millis", lambda d: (F.unix_seconds(d) * 1000).cast("string")), ("iso_z", lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'")),
    ("iso", lambda d: F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss")), ("day_month", lambda d: F.date_format(d, "d MMM yyyy HH:mm:ss")), ("month_day", lambda d: F.date_format(d, "MMM d, yyyy HH:mm:ss")), ("dotted", lambda d: F.date_format(d, "d.M.yyyy HH:mm:ss")),
    ("compact", lambda d: F.date_format(d, "yyyyMMdd")), ("plain", lambda d: F.date_format(d, "yyyy-MM-dd")), ("slashed", lambda d: F.date_format(d, "yyyy/M/d")), ("dashed", lambda d: F.date_format(d, "d-MMM-yyyy")), ("words", lambda d: F.date_format(d, "MMMM d, yyyy")),
]
TIMED = ("epoch", "millis", "iso_z", "iso", "day_month", "month_day", "dotted")


@query("select event_key as k, " + ", ".join(f"strftime({'m' if f in TIMED else 'd'}, '%Y-%m-%d %H:%M:%S') as {f}" for f, _ in FORMS) + """, strftime(d, '%Y-%m-%d') || ' 05:06:07' as combined, '05:06:07' as clock, cast(strftime(d, '%Y%m%d') as integer) as number, strftime(last_day(cast(m as date)) + interval 2 day, '%Y-%m-%d') || ' 00:00:00' as overflow
from (select event_key, date_trunc('second', event_time) as m, date_trunc('day', event_time) as d from carrier_events)""")
def time_scalars(t):
    rows = _keyed(t).select("k", F.date_trunc("second", "event_time").alias("m")).withColumns({f"{name}_": form(F.col("m")) for name, form in FORMS})
    last = F.last_day("m")
    beyond = F.concat((F.dayofmonth(last) + 2).cast("string"), F.date_format("m", ".M.yyyy"))
    rows = rows.withColumns({"beyond_": beyond, "clock_": _cases("c", F.lit("PT5H6M7S"), F.lit("050607"), F.lit("5:06:07"))})
    return rows.select("k", *[S.timestamp(f"{name}_").alias(name) for name, _ in FORMS], S.date_and_time("compact_", "clock_").alias("combined"), S.clock_time("clock_").alias("clock"), S.date_number("m").alias("number"), S.timestamp("beyond_").alias("overflow"))


@query("""select event_key as k, case event_key % 9 when 0 then 'cron needs five fields' when 2 then 'interval needs a number and a unit' when 3 then 'interval must be at least 1' when 4 then 'unit must be minutes, hours, days or weeks' when 6 then 'time is too short' when 7 then 'no date' when 8 then 'no value' end as error,
case event_key % 9 when 0 then 'CRON' when 1 then 'CRON' when 6 then 'REPEAT_AT' when 7 then 'ONE_TIME' when 8 then 'REPEAT_AT' else 'REPEAT_INTERVAL' end as pattern, case event_key % 9 when 1 then '* * * * * 0' when 0 then '* *' else v end as value
from (select event_key, ['* *', '', 'soon', '0 days', '3 years', '30 minutes', '6', 'never', ''][event_key % 9 + 1] as v from carrier_events)""")
def schedule_checks(t):
    kinds, values = ["CRON", "", *["REPEAT_INTERVAL"] * 4, "REPEAT_AT", "ONE_TIME", "REPEAT_AT"], ["* *", "", "soon", "0 days", "3 years", "30 minutes", "6", "never", ""]
    rows = _keyed(t).select("k", _cases("kind_", *map(F.lit, kinds)), _cases("value_", *map(F.lit, values)))
    rows = rows.withColumn("t_", S.schedule_timing("kind_", "value_", F.lit("* * * * * 0")))
    return rows.select("k", S.schedule_error("t_.pattern", "t_.value").alias("error"), "t_.pattern", "t_.value")


@query("""select event_key as k, case event_key % 4 when 0 then '["a","' || event_key || '"]' when 1 then '{"n":' || event_key || '}' end as value, case event_key % 4 when 2 then 'value must be valid JSON' when 3 then 'value must be a JSON array or object' end as error, case event_key % 4 when 0 then 4 else 0 end as n_items from carrier_events""")
def config_values(t):
    k = F.col("k").cast("string")
    rows = _keyed(t).select("k", _cases("text_", F.concat(F.lit('[" a ","'), k, F.lit('","a",""]')), F.concat(F.lit('{ "n": '), k, F.lit(" }")), F.lit("[a"), F.lit('"a"')))
    return rows.withColumn("c", S.config_value("text_")).select("k", "c.value", "c.error", F.size(S.json_list("text_")).alias("n_items"))


@query("select event_key as k, '4500' || event_key as po_number, '00010' as line_item from carrier_events where event_key % 3 <> 0")
def selections_parsed(t):
    k = F.col("k").cast("string")
    one = F.concat(F.lit('[{"po_number":" 4500'), k, F.lit('","line_item":"10"},{"po_number":"","line_item":"10"},{"po_number":" 4500'), k, F.lit('","line_item":"00010"},{"po_number":"1"}]'))
    payload = _keyed(t).filter("k % 3 <> 0").select(one.alias("payload"))
    return relational.parse_selection(payload).select(F.expr("cast(substr(po_number, 5) as bigint)").alias("k"), "po_number", "line_item")


@query("""select event_key as k, 'Syncing ' || case when event_key % 2 = 0 then event_key || ' record(s) across ' else 'records for ' end || case when event_key % 3 = 0 then 'plants → materials' else 'S/4 entities' end || ' in batches of 50 — ' || case when event_key % 5 = 0 then 'limited sync (500 rows)' else 'full sync' end
|| ', ' || case when event_key % 3 = 0 then 'master data full refresh' else 'PO date scope: 2024 (po_lines only)' end || ', mode: ' || case when event_key % 5 = 0 then 'LIMITED' else 'FULL' end || case when event_key % 2 = 0 then ', ~' || cast(ceil(event_key / 50) as bigint) || ' page(s)' else '' end || ', reconcile: ' || case when event_key % 5 = 0 then 'off.' else 'on.' end as message from carrier_events""")
def sync_plan_messages(t):
    k = F.col("k")
    rows = _keyed(t).select(
        "k", F.when(k % 2 == 0, k).alias("total_to_sync"), F.when(k % 3 == 0, "plants → materials").alias("targets"), F.when(k % 5 == 0, 500).alias("row_limit"), F.lit(50).alias("page_size"), F.lit("2024").alias("date_scope"), (k % 3 == 0).alias("master"), (k % 5 != 0).alias("reconcile")
    )
    return rows.select("k", feedback.plan_message(rows).alias("message"))


@query("select event_key as k, '2024-01-01' as first, '2024-01-30' as last from carrier_events where event_time between timestamp '2024-01-01' and timestamp '2024-01-30 23:59:59.999'")
def trailing_window(t):
    first, last = S.trailing_window("2024-01-30", None, "never")
    return _keyed(t).filter(relational.date_range("event_time", first, last)).select("k", F.lit(first).alias("first"), F.lit(last).alias("last"))
