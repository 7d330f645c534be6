import pytest
from pyspark.sql import functions as F

from portlight.operators import surface
from portlight.plans.bridge import Tables

from .oracle import SF

KINDS = {"a": "string", "b": "int", "c": "timestamp", "d": "boolean", "e": "decimal(13,3)", "s/n": "string"}


@pytest.mark.parametrize(
    ("text", "sql"),
    [
        ("a eq 'x' and b gt 1 or not (b le 2)", "`a` is not distinct from 'x' and `b` > 1 or not ( `b` <= 2 )"),
        ("a eq null", "`a` is not distinct from null"),
        ("a eq 'it''s \\' ", "`a` is not distinct from 'it\\'s \\\\'"),
        ("b in (1,2,-3)", "`b` in ( 1 , 2 , -3 )"),
        ("c ge 2024-01-02T03:04:05Z", "`c` >= cast('2024-01-02T03:04:05Z' as timestamp)"),
        ("c lt datetime'2024-01-02'", "`c` < cast('2024-01-02' as timestamp)"),
        ("5 lt e", "5 < `e`"),
        ("not d and s/n ne 'q'", "(not `d`) and `s`.`n` is distinct from 'q'"),
        ("substringof('x',a) and substring(a,1) eq 'y'", "0 < locate( 'x' , `a` ) and substring( `a` , 1 + 1 ) is not distinct from 'y'"),
        ("d eq true", "`d` is not distinct from true"),
    ],
)
def test_filters_become_sql(text, sql):
    assert surface.filter_sql(text, KINDS) == sql


@pytest.mark.parametrize(
    ("text", "position"),
    [("a eq 'x' and nope gt 1", 13), ("b gt 'x'", 5), ("a eq 5", 5), ("c gt 7", 5), ("c gt '2024-13-01'", 5), ("(a eq 'x'", 0), ("a eq 'x')", 8), ("a eq 'x' ; drop", 9), ("foo(a) eq 1", 0), ("d eq 'true'", 5), ("b in (1,'x')", 8), ("now() gt c", 0), ("a eq 'open", 5)],
)
def test_bad_filters_say_where(text, position):
    with pytest.raises(surface.RequestError) as e:
        surface.filter_sql(text, KINDS)
    assert e.value.position == position


@pytest.mark.parametrize(
    "text",
    ["nope?$top=1", "_dir?$top=1", "plants?$what=1", "plants?$top=x", "plants?$select=nope", "plants?$orderby=nope", "plants?$orderby=region sideways", "plants?$expand=nope", "po_lines?$expand=asns($skip=1)", "po_lines?$expand=supplier($select=nope)", "plants?$filter=region eq", "plants?$filter=region region", "plants?$filter=and"],
)
def test_bad_requests(spark, text):
    with pytest.raises(surface.RequestError):
        surface.request(Tables(spark, SF), text)[0].collect()


def test_nulls_order_and_counts(spark):
    class One:
        rows = spark.createDataFrame([(1, None, True), (2, "x", None), (3, "y", False)], "k int, v string, w boolean")

    get = lambda q: [r.k for r in surface.request(One, q)[0].collect()]
    assert get("rows?$filter=v ne 'x'&$orderby=k") == [1, 3]
    assert get("rows?$filter=v eq null") == [1]
    assert get("rows?$filter=not (v eq 'x')&$orderby=k desc") == [3, 1]
    assert get("rows?$filter=not w") == [3]
    assert get("rows?$orderby=v") == [1, 2, 3] and get("rows?$orderby=v desc") == [3, 2, 1]
    assert get("rows?$orderby=k&$skip=1&$top=1") == [2] and get("rows?$top=0") == []
    rows, total = surface.request(One, "rows?$filter=k gt 1&$top=1&$count=true")
    assert rows.count() == 1 and total.first().total == 2
    assert rows.columns == ["k", "v", "w"]


def test_filters_reach_the_scan(spark, tmp_path):
    spark.range(100).select("id", F.col("id").cast("string").alias("v")).write.parquet(str(tmp_path / "t"))

    class One:
        rows = spark.read.parquet(str(tmp_path / "t"))

    plan = surface.request(One, "rows?$filter=id gt 5 and v eq '7'&$select=id")[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(id,5)" in plan and "EqualNullSafe(v,7)" in plan or "EqualTo(v,7)" in plan
