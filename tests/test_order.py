"""The order of rows, which a comparison by content doesn't see."""

from pyspark.sql import functions as F

from portlight.operators import classify, reports, runlogs


def test_usage_rows(spark):
    rows = spark.createDataFrame([("day", "2024-01-02", 9), ("day", "2024-01-01", 1), ("model", "b", 5), ("model", "a", 5), ("model", "c", 7), ("provider", "p", 1), ("provider", "q", 3), ("total", "all", 4)], "kind string, label string, tokens long")
    assert [(r.kind, r.label) for r in reports.by_usage(rows).collect()] == [("total", "all"), ("provider", "q"), ("provider", "p"), ("model", "c"), ("model", "a"), ("model", "b"), ("day", "2024-01-01"), ("day", "2024-01-02")]


def test_report_by_arrival(spark):
    rows = spark.createDataFrame([("2", "10", None), ("1", "20", "2024-01-02"), ("1", "10", "2024-01-02"), ("3", "10", "2024-01-01")], "po_number string, line_item string, at string").withColumn("eta", F.col("at").cast("timestamp"))
    assert [(r.po_number, r.line_item) for r in reports.by_arrival(rows).collect()] == [("3", "10"), ("1", "10"), ("1", "20"), ("2", "10")]


def test_counts(spark):
    rows = spark.createDataFrame([("b", 1), ("a", 1), ("c", 2)], "label string, n long")
    assert [r.label for r in reports.by_count(rows, "n", "label").collect()] == ["c", "a", "b"]


def test_rules_by_score(spark):
    rows = spark.createDataFrame([("a", None), ("b", "10"), ("c", "9"), ("d", "x"), ("e", "9")], "exception_type string, score string")
    assert [r.exception_type for r in classify.rules_in_order(rows).collect()] == ["c", "e", "b", "a", "d"]


def test_run_log_newest_first(spark):
    rows = spark.createDataFrame([(1, "2024-01-01"), (2, "2024-01-03"), (3, None), (4, "2024-01-02")], "run_id long, at string").withColumn("started_at", F.col("at").cast("timestamp"))
    assert [r.run_id for r in runlogs.newest_first(rows).collect()] == [2, 4, 1, 3]


def test_queue_and_ready_lines(spark):
    rows = spark.createDataFrame([("3", None, []), ("1", "2024-01-02", []), ("2", "2024-01-01", []), ("4", None, ["x"])], "po_number string, at string, notes array<string>")
    rows = rows.withColumn("ai_processed_at", F.col("at").cast("timestamp")).withColumn("line_item", F.lit("10"))
    assert [r.po_number for r in classify.ready_first(rows).collect()] == ["3", "2", "1", "4"]
    lines = rows.withColumns({"po_status": F.lit("OPEN"), "ai_processed": F.lit(False), "ai_reanalysis_needed": F.lit(None).cast("boolean")})
    assert [r.po_number for r in classify.queue(lines, 3).collect()] == ["3", "4", "2"]
