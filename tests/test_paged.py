import json

import pytest
from pyspark.sql import functions as F

from portlight.sources import paged


def land(folder, pages):
    for i, page in enumerate(pages):
        (folder / f"page={i:06d}").mkdir()
        (folder / f"page={i:06d}" / "part.txt").write_text(json.dumps(page))


ROWS = [{"k": i, "v": f"x{i}" if i % 3 else None, "at": "2024-01-02T03:04:05+00:00", "q": "1.500", "w": i % 2 == 0} for i in range(25)]
SCHEMA = "k long, v string, at timestamp, q decimal(5,3), w boolean"


@pytest.mark.parametrize("count", [None, 25])
@pytest.mark.parametrize("shape", ["value", "d"])
def test_pages_up_to_the_short_one(spark, tmp_path, count, shape):
    """The last page is short; those behind it are left over from a longer run."""
    pages = [ROWS[i : i + 10] for i in (0, 10, 20)] + [[{"k": 99}] * 10]
    head = {} if count is None else {"@odata.count": count} if shape == "value" else {"__count": str(count)}
    land(tmp_path, [{"value": p, **head} if shape == "value" else {"d": {"results": p, **head}} for p in pages])
    df = paged.read_landed(spark, str(tmp_path), SCHEMA, 10, pages_per_task=1)
    assert df.rdd.getNumPartitions() == (1 if count is None else 3)
    got = df.orderBy("k").collect()
    assert [r.k for r in got] == list(range(25)) and got[1].v == "x1" and got[0].v is None and str(got[0].q) == "1.500" and got[3].w is False
    assert df.select(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).first()[0] == "2024-01-02 03:04:05"


@pytest.mark.parametrize("count", [None, 25])
@pytest.mark.parametrize("cap", [1, 10, 14, 24, 25, 100])
def test_row_cap(spark, tmp_path, count, cap):
    land(tmp_path, [{"value": ROWS[i : i + 10]} | ({} if count is None else {"@odata.count": count}) for i in (0, 10, 20)])
    df = paged.read_landed(spark, str(tmp_path), SCHEMA, 10, row_cap=cap, pages_per_task=2)
    assert sorted(r.k for r in df.collect()) == list(range(min(cap, 25)))


def test_full_last_page_and_no_pages(spark, tmp_path):
    assert paged.read_landed(spark, str(tmp_path), SCHEMA, 10).count() == 0
    land(tmp_path, [{"value": ROWS[:10]}, {"value": ROWS[10:20]}])
    assert paged.read_landed(spark, str(tmp_path), SCHEMA, 10).count() == 20


def test_filters_are_pushed(spark, tmp_path):
    land(tmp_path, [{"value": ROWS[i : i + 10], "@odata.count": 25} for i in (0, 10, 20)])
    df = paged.read_landed(spark, str(tmp_path), SCHEMA, 10).filter("k > 3 and v is not null and k in (4, 5, 6, 7) and w = true and q > 1 and length(v) = 2")
    assert [r.k for r in df.collect()] == [4]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "(length(v" in plan.split("BatchScan")[0] and "k#" not in plan.split("Filter")[-1].split("\n")[0]


def test_landed_rows_come_back(spark, tmp_path):
    rows = spark.range(2501).select("id", F.concat(F.lit('q"ü\n'), F.col("id").cast("string")).alias("t"), (F.col("id") / 4).cast("decimal(9,2)").alias("d"), F.timestamp_seconds("id").alias("at"), F.when(F.col("id") % 2 == 0, True).alias("w"))
    paged.land_pages(rows, str(tmp_path / "p"), ["id"], 100)
    back = paged.read_landed(spark, str(tmp_path / "p"), rows.schema, 100)
    assert back.count() == 2501 and back.exceptAll(rows).count() == 0
    assert back.rdd.getNumPartitions() == 2
    paged.land_pages(rows.limit(0), str(tmp_path / "none"), ["id"], 100)
    assert paged.read_landed(spark, str(tmp_path / "none"), rows.schema, 100).count() == 0
    with pytest.raises(Exception, match="schema"):
        spark.read.format("landed_pages").load(str(tmp_path / "p"))
