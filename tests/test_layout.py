import re

from pyspark.sql import functions as F

from portlight.operators import classify
from portlight.plans import layout
from portlight.plans.bridge import Tables
from portlight.queries_runs import STAR_COLUMNS, STAR_TABLES

from .oracle import SF


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_look_backs_read_the_days_in_reach(spark, tmp_path):
    rows = spark.range(240).select("id", F.timestamp_seconds(F.lit(1_704_067_200) + F.col("id") * 3600).alias("at"))
    rows = rows.unionByName(spark.createDataFrame([(-1, None)], "id long, at timestamp"))
    path = str(tmp_path / "t")
    layout.write_by_day(rows, path, "at")
    got = layout.read_days(spark, path, "at", "2024-01-03 12:00:00", "2024-01-05 01:00:00")
    assert sorted(r.id for r in got.collect()) == list(range(60, 98))
    scan = got._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert "day" in re.search(r"PartitionFilters: \[(.*?)\], PushedFilters", plan_of(got))[1]
    assert scan.metrics().apply("numFiles").value() == 3
    assert layout.read_days(spark, path, "at").count() == 241 and layout.read_days(spark, path, "at", until="2024-01-01 00:00:00").count() == 1


def test_star_of_co_located_tables_has_no_exchange_by_order(spark):
    t = Tables(spark, SF)
    b = layout.co_located(t, STAR_TABLES, 4)
    star = classify.enriched_lines(b.po_lines, b, ["FS"], ["1000122"])
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(star))
    assert not [x for x in exchanges if "po_number" in x or "reference_document" in x]
    plain = classify.enriched_lines(t.po_lines, t, ["FS"], ["1000122"])
    assert len([x for x in re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(plain)) if "po_number" in x]) > 3
    assert star.count() == plain.count() == t.po_lines.count()


def test_co_located_tables_are_narrow_and_stay_where_they_are(spark):
    """Round 4, F3: all columns of lines and exceptions were dealt and stored, and tables in buckets were dealt anew where their number isn't
    that of the session's shuffle partitions."""
    t = Tables(spark, SF)
    b = layout.co_located(t, STAR_TABLES, 8, STAR_COLUMNS)
    assert b.po_lines.columns == STAR_COLUMNS["po_lines"] and b.exceptions.columns == STAR_COLUMNS["exceptions"] and len(b.po_partners.columns) == 4
    star = classify.enriched_lines(b.po_lines, b, ["FS"], ["1000122"], 8)
    exchanges = re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan_of(star))
    assert not [x for x in exchanges if "po_number" in x or "reference_document" in x]
    assert star.count() == t.po_lines.count()


def test_buckets_grow_with_the_table(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1 << 21).selectExpr("id", "xxhash64(id) as x", "xxhash64(id, 1) as y").write.parquet(path)
    assert layout.buckets_for(spark.read.parquet(path)) > 8
    assert layout.buckets_for(spark.read.parquet(path).limit(0)) == 8
