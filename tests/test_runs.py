import re

import pytest
from pyspark.sql import functions as F

from portlight.operators import changes, classify, offline
from portlight.plans import sync
from portlight.plans.bridge import Tables
from portlight.queries_sync import RUN, _order_items
from portlight.sources import files, shared
from portlight.sources.shared import shared_folder

from .oracle import SF

RULE = "exception_type string, priority string, score string, panel string, trigger string, pattern string"


def test_first_match_by_score(spark):
    rows = spark.createDataFrame([(1, 5, None), (2, None, "x"), (3, 50, "$1 \\ y"), (4, None, None)], "k int, n int, s string")
    rules = spark.createDataFrame(
        [("Z", "low", "x", "P", "k < 4", "any [k]"), ("B", "High", "10", "P", "n > 1", "B [n] [s] [what]"), ("A", "medium", "2", "Q", "n > 10", "A [s]"), ("C", None, "10", None, "s is not null", None)], RULE
    )
    got = {r.k: (r.exception_type, r.priority, r.priority_score, r.panel, r.recommendation, r.evidence) for r in offline.first_match(rows, rules).collect()}
    assert got[1] == ("B", "HIGH", 10, "P", "B 5 NO_DATA_FOUND [what]", "n > 1")
    assert got[2][0] == "C" and got[2][3:] == (None, "", "s is not null")
    assert got[3] == ("A", "MEDIUM", 2, "Q", "A $1 \\ y", "n > 10")
    assert got[4] == (None,) * 6
    assert offline.first_match(rows, rules.limit(0)).filter("exception_type is null").count() == 4


@pytest.mark.parametrize(("trigger", "message"), [("no_such > 1", "rule R: .*no_such"), ("k >", "rule R"), ("drop table x", "rule R")])
def test_rules_that_cannot_be_read_are_named(spark, trigger, message):
    with pytest.raises(ValueError, match=message):
        offline.first_match(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("R", "low", "1", "P", trigger, "")], RULE))


def test_rule_tables_have_a_bound(spark, monkeypatch):
    monkeypatch.setattr(offline, "MOST_RULES", 2)
    with pytest.raises(ValueError, match="more than 2"):
        offline.first_match(spark.createDataFrame([(1,)], "k int"), spark.createDataFrame([("R", "low", "1", "P", "true", "")] * 3, RULE))


def test_runs_persist_once_and_log_errors(spark, tmp_path):
    t = Tables(spark, SF)
    tables = {k: str(tmp_path / k) for k in ("exceptions", "lines", "runs")}
    with pytest.raises(ValueError, match="has no version"):
        offline.run(t, tables, "a", ["FS"], ["1000122"], "1998-06-01", "1998-01-01 00:00:00")
    (failed,) = files.read_version(spark, tables["runs"]).collect()
    assert (failed.run_id, failed.status, failed.total) == ("a", "ERROR", 0) and "has no version" in failed.message
    files.write_version(t.exceptions, tables["exceptions"], 1)
    files.write_version(t.po_lines, tables["lines"], 1)
    rules = spark.createDataFrame([("QUIET", "LOW", "9", "STATUS_REPORT", "n_errors = 0", "[po_number] is quiet")], RULE)
    one = offline.run(t, tables, "a", ["FS"], ["1000122"], "1998-06-01", "1998-01-01 00:00:00", rules).first()
    active = t.po_lines.filter("po_status in ('OPEN', 'GR_POSTED')").count()
    assert one.status == "SUCCESS" and one.total == active == one.processed + one.skipped + one.for_review and one.processed == one.created + one.updated > 0
    after = files.read_version(spark, tables["exceptions"])
    assert after.count() == t.exceptions.count() + one.created and after.filter("exception_type = 'QUIET'").count() > 0
    two = offline.run(t, tables, "b", ["FS"], ["1000122"], "1998-06-01", "1998-01-01 00:00:00", rules).first()
    assert [x["label"] for x in files.versions(spark, tables["exceptions"])] == ["", "a", "b"] and files.read_version(spark, tables["runs"]).count() == 2
    assert two.total == active


def test_counters_cost_no_second_pass(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    rows = spark.range(50).select((F.col("id") % 3 == 0).alias("unchanged"), F.when(F.col("id") % 2 == 0, "P").alias("panel"), F.when(F.col("id") % 5 == 0, F.col("id")).alias("exception_id"))

    def watched(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    out, observation = offline.counted(rows.mapInArrow(watched, rows.schema), "test")
    out.write.parquet(str(tmp_path / "t"))
    want = classify.outcome_counts(rows).first().asDict()
    assert observation.get == want and seen.value == 50


OLD = [(1, "a", 1), (2, "b", None), (3, None, 3), (4, "d", 4)]
NEW = [(1, "a", 1), (2, "b", 2), (3, "", 3), (5, "e", None)]


def test_difference_and_its_application(spark):
    old, new = (spark.createDataFrame(x, "k int, v string, n int") for x in (OLD, NEW))
    feed = changes.difference(old, new, ["k"])
    assert {r.k: (r.op, r.changed, r.v, r.n) for r in feed.collect()} == {2: ("update", ["n"], "b", 2), 3: ("update", ["v"], "", 3), 4: ("delete", [], None, None), 5: ("insert", [], "e", None)}
    assert sorted(map(tuple, changes.apply_difference(old, feed, ["k"]).collect())) == sorted(NEW, key=lambda r: r[0])
    assert {r.op: r.n for r in changes.outcome(feed).collect()} == {"update": 2, "delete": 1, "insert": 1}
    assert changes.difference(new, new, ["k"]).count() == 0


def test_difference_with_columns_that_come_and_go(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, None)], "k int, gone string"), spark.createDataFrame([(1, 7), (2, None)], "k int, come int")
    feed = changes.difference(old, new, ["k"])
    assert [(r.k, r.op, sorted(r.changed)) for r in feed.collect()] == [(1, "update", ["come", "gone"])]
    back = changes.apply_difference(old, feed, ["k"])
    assert sorted((r.k, r.gone, r.come) for r in back.collect()) == [(1, None, 7), (2, None, None)]
    empty = old.limit(0)
    assert changes.difference(empty, empty, ["k"]).count() == 0 and changes.difference(empty, old, ["k"]).filter("op = 'insert'").count() == 2


def test_a_repeated_run_does_not_classify_again(spark, monkeypatch):
    """Round 3, F8: a run that was repeated under its id derived and wrote everything again before it left the result as it was."""
    t = Tables(spark, SF)
    tables = {k: shared_folder(spark, k) for k in ("exceptions", "lines", "runs")}
    files.write_version(t.exceptions, tables["exceptions"], 1)
    files.write_version(t.po_lines, tables["lines"], 1)
    run = lambda: offline.run(t, tables, "once", ["FS"], ["1000122"], "1998-06-01", "1998-01-01 00:00:00").collect()
    first = run()
    monkeypatch.setattr(classify, "enriched_lines", None)
    assert run() == first and first[0].status == "SUCCESS"


def _exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") + df._jdf.queryExecution().executedPlan().toString().count("REPARTITION_BY_COL")


def test_a_difference_deals_each_version_once(spark, monkeypatch):
    """Round 3, F19 and F21: versions were dealt for their digests, and again for their values."""
    old, new = (spark.range(n).select(F.col("id").alias("k"), (F.col("id") % m).alias("v")).repartition(2) for n, m in ((50, 7), (60, 9)))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        feed = changes.difference(old, new, ["k"])
        assert _exchanges(feed) == 2
        back = changes.apply_difference(old, feed, ["k"])
        assert _exchanges(back) == 4
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, new.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_lines_are_dealt_by_order_once(spark):
    """Round 3, F15, F17, F18: lines were dealt anew for each side that they were joined with."""
    t = Tables(spark, SF)
    lines = t.po_lines.select("po_number", "line_item", "supplier_id", "material_id", "plant").localCheckpoint()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        rows = classify.enriched_lines(lines, t, ["FS"], ["1000122"])
        plan = rows._jdf.queryExecution().executedPlan()
        # from the top down the first side of each join: lines by plant, order, material and supplier
        dealt = 0
        plan = plan.initialPlan() if plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec" else plan
        while plan.children().size():
            plan = plan.children().apply(0)
            dealt += plan.getClass().getSimpleName() == "ShuffleExchangeExec"
        assert dealt <= 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_lines_without_an_exception_spread(spark):
    """Round 3, F25: as null keys of a join they all came to one task."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("po_number"), F.lit("00010").alias("line_item"), F.lit(None).cast("long").alias("exception_id"), F.lit("A").alias("panel"), F.lit(False).alias("ai_reanalysis_needed"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = classify.unchanged(rows, spark.createDataFrame([(1, "A")], "exception_id long, panel string"))
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()]
        assert sum(sizes) == 4000 and max(sizes) < 2000 and out.filter("unchanged").isEmpty()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_exceptions_of_a_run_need_no_compared_columns(spark):
    """Round 4, F4: all columns of the old lines were dealt for the plan, and lines once more for the merge; lineitem was dealt by order and
    line, and again by order."""
    t = Tables(spark, SF)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        left = sync.order_lines(t.po_lines, t.exceptions, _order_items(t), t.asn_ibd, RUN)[1]
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet \[[^\]]*l_extendedprice", plan)) == 1
        assert "hashpartitioning(l_orderkey" in plan and not re.search(r"hashpartitioning\(l_orderkey#\d+L?, l_linenumber", plan)
        assert plan.count("SortMergeJoin") == 8  # lines with orders and suppliers three times, incoming with lines, exceptions with closed lines
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_shuffle_files_of_a_run_go_after_each_step(spark, monkeypatch):
    """Round 4, F2: what classification had shuffled stayed on disk beside the files of both merges."""
    t, seen = Tables(spark, SF), []
    tables = {k: shared_folder(spark, k) for k in ("exceptions", "lines", "runs")}
    files.write_version(t.exceptions, tables["exceptions"], 1)
    files.write_version(t.po_lines, tables["lines"], 1)
    release, merge_into = shared.release, offline.merge_into
    monkeypatch.setattr(shared, "release", lambda spark: (seen.append("release"), release(spark)))
    monkeypatch.setattr(offline, "merge_into", lambda spark, folder, *a, **k: (seen.append(next(n for n, x in tables.items() if x == folder)), merge_into(spark, folder, *a, **k))[1])
    assert offline.run(t, tables, "steps", ["FS"], ["1000122"], "1998-06-01", "1998-01-01 00:00:00").first().status == "SUCCESS"
    assert seen == ["release", "release", "exceptions", "release", "lines", "runs"]
