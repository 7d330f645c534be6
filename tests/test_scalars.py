from datetime import datetime

import pytest
from pyspark.sql import functions as F

from portlight.functions import scalars as S


def value(spark, column, x, kind="string"):
    return spark.createDataFrame([(x,)], f"c {kind}").select(column("c").alias("v")).first().v


@pytest.mark.parametrize("x, want", [("10", "00010"), (" 00010 ", "00010"), ("123456", "123456"), ("000123456", "123456"), ("0", "00000"), ("A1", "A1"), ("", None), (None, None)])
def test_line_item(spark, x, want):
    assert value(spark, S.line_item, x) == want


@pytest.mark.parametrize(
    "x, want",
    [
        ("/Date(1706572800000)/", datetime(2024, 1, 30)), ("1706572800000", datetime(2024, 1, 30)), ("2024-01-30T12:00:00+02:00", datetime(2024, 1, 30, 10)), ("2024-01-30T12:00:05Z", datetime(2024, 1, 30, 12, 0, 5)),
        ("2024-01-30T12:00:05", datetime(2024, 1, 30, 12, 0, 5)), ("2024-01-30 12:00", datetime(2024, 1, 30, 12)), ("30 Jan 2024 08:05", datetime(2024, 1, 30, 8, 5)), ("3 September 2024 08:05:09", datetime(2024, 9, 3, 8, 5, 9)),
        ("Sept 3, 2024 7:30", datetime(2024, 9, 3, 7, 30)), ("3.9.2024 7:30", datetime(2024, 9, 3, 7, 30)), ("20240903", datetime(2024, 9, 3)), ("2024-09-03", datetime(2024, 9, 3)), ("3.9.2024", datetime(2024, 9, 3)),
        ("2024/9/3", datetime(2024, 9, 3)), ("3 Sep 2024", datetime(2024, 9, 3)), ("Sep 3, 2024", datetime(2024, 9, 3)), ("3-Sep-2024", datetime(2024, 9, 3)), ("31.2.2026", datetime(2026, 3, 3)), ("nonsense", None), ("", None), (None, None), ("3.13.2024", None),
    ],
)
def test_timestamp(spark, x, want):
    assert value(spark, S.timestamp, x) == want


@pytest.mark.parametrize("x, want", [("PT8H5M0S", "08:05:00"), ("PT30M", "00:30:00"), ("8:05", "08:05:00"), ("08:05:09", "08:05:09"), ("080509", "08:05:09"), ("x", None), (None, None)])
def test_clock_time(spark, x, want):
    assert value(spark, S.clock_time, x) == want


@pytest.mark.parametrize("x, want", [("53", "POSTED"), ("56", "PENDING"), ("60", "RETRYING"), ("51", "ERROR"), ("", "ERROR"), (None, "ERROR"), ("5", "ERROR")])
def test_document_group(spark, x, want):
    assert value(spark, S.document_group, x) == want


@pytest.mark.parametrize("x, want", [("TRUE", True), (" x ", True), ("1", True), ("yes", True), ("no", False), ("2", False), (None, False)])
def test_is_true(spark, x, want):
    assert value(spark, S.is_true, x) is want


@pytest.mark.parametrize("x, want", [("12abc", 12.0), (" -3.5kg", -3.5), ("abc", None), (None, None)])
def test_leading_number(spark, x, want):
    assert value(spark, S.leading_number, x) == want


def test_open_quantities(spark):
    rows = spark.createDataFrame([("10", 4.0, 3.0, None, 1.0, 2.0), ("10", 4.0, 12.0, "2", 1.0, 2.0), ("10", None, None, "4", 1.0, 2.0), ("10", None, None, None, 1.0, 2.0), ("x", None, None, None, None, None)], "q string, r double, p double, o string, oldr double, oldp double")
    got = [tuple(float(x) for x in row.v) for row in rows.select(S.open_quantities("q", "r", "p", "o", "oldr", "oldp").alias("v")).collect()]
    assert got == [(4, 3, 7), (4, 12, 0), (6, 0, 10), (1, 2, 8), (0, 0, 0)]


def test_dates_and_text(spark):
    one = spark.range(1)
    row = one.select(
        S.excel_day(F.lit("2026-01-26").cast("timestamp")).alias("day"), S.date_number(F.lit("2026-01-26").cast("timestamp")).alias("number"), S.duration_text(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:03:05").cast("timestamp")).alias("long"),
        S.duration_text(F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-01 00:00:42").cast("timestamp")).alias("short"), S.ellipsis(F.lit("x" * 300)).alias("cut"), S.without_fences(F.lit("```json\n{}\n```")).alias("bare"),
        S.split_list(F.lit("a, ,b")).alias("parts"), S.confidence(F.lit("87")).alias("c"), S.run_status(F.lit("in_progress")).alias("s"), S.priority(F.lit(" high ")).alias("p"),
    ).first()
    assert (row.day, row.number, row.long, row.short, len(row.cut), row.bare, row.parts, row.c, row.s, row.p) == (46048, 20260126, "3m 5s", "42s", 250, "{}", ["a", "b"], 0.87, "RUNNING", "HIGH")


@pytest.mark.parametrize("days, want", [(-1, "overdue"), (0, "next7"), (7, "next7"), (8, "next14"), (15, "next30"), (31, "beyond30"), (None, "noDate")])
def test_delivery_bucket(spark, days, want):
    rows = spark.createDataFrame([(days,)], "d int").select(F.date_add(F.lit("1998-06-01").cast("date"), "d").alias("c"))
    assert rows.select(S.delivery_bucket("c", "1998-06-01").alias("v")).first().v == want


@pytest.mark.parametrize(
    "pattern, v, want",
    [("CRON", "* * * * *", None), ("", "* * * * *", None), ("cron", "* * * * *", "unknown pattern"), ("CRON", "* *", "cron needs five fields"), ("REPEAT_INTERVAL", "30 minutes", None), ("REPEAT_INTERVAL", "often", "interval needs a number and a unit"), ("REPEAT_AT", "5", "time is too short"), ("ONE_TIME", "2024-01-01", None), ("ONE_TIME", "x", "no date"), ("X", "1", "unknown pattern"), ("CRON", None, "no value"), ("REPEAT_INTERVAL", "0 days", "interval must be at least 1"), ("REPEAT_INTERVAL", "3 years", "unit must be minutes, hours, days or weeks")],
)
def test_schedules(spark, pattern, v, want):
    row = spark.createDataFrame([(pattern, v)], "p string, v string").select(S.schedule_error("p", "v").alias("e"), S.name_error("p").alias("n")).first()
    assert row.e == want and (row.n is None) == (pattern != "" and "_" not in pattern)


def test_timestamp_stays_small(spark):
    """A column of twelve forms once named its text several hundred times, and plans of many of them filled the driver."""
    plan = spark.range(1).selectExpr("cast(id as string) as text_").select(S.timestamp("text_"))._jdf.queryExecution().analyzed().toString()
    assert plan.splitlines()[0].count("text_#") == 1


def test_documents_are_parsed_once(spark):
    from portlight import queries as core

    from . import oracle

    plan = core.QUERIES["order_items_mapped"](spark, oracle.SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json(") == 1
