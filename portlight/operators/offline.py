"""Classification without a model: rules from a table, compiled to predicates, first match by score; and whole runs of it."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException, ParseException
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import classify
from .merge import merge_into
from .relational import ACTIVE

#: A rule table is code in rows: it goes into one expression, and more rows than this are an error.
MOST_RULES = 200
RULE_COLUMNS = ["exception_type", "priority", "score", "panel", "trigger", "pattern"]
MISSING = "NO_DATA_FOUND"


def _filled(pattern: str, rows: DataFrame) -> Column:
    """A pattern whose [placeholders] that are columns give way to their values."""
    out = []
    for i, part in enumerate(re.split(r"\[(\w+)\]", pattern or "")):
        if i % 2 == 0:
            out.append(F.lit(part))
        elif part in rows.columns:
            out.append(S.first_text(F.col(part).cast("string"), F.lit(MISSING)))
        else:
            out.append(F.lit(f"[{part}]"))
    return F.concat(*out)


def first_match(rows: DataFrame, rules: DataFrame) -> DataFrame:
    """Adds exception_type, priority, priority_score, panel, recommendation and evidence of the first rule whose trigger, a Spark SQL
    predicate over the columns of rows, holds; null where none does.

    Rules (RULE_COLUMNS) count by their score as a number, those without one last, then by type. A trigger that can't be read is an
    error that names its rule; one that is null for a row doesn't hold.
    """
    found = classify.rules_in_order(rules.select(RULE_COLUMNS)).limit(MOST_RULES + 1).collect()
    if len(found) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    tests = []
    for r in found:
        try:
            rows.select(F.expr(r.trigger).cast("boolean"))
        except (ParseException, AnalysisException) as e:
            raise ValueError(f"rule {r.exception_type}: {str(e).splitlines()[0]}") from None
        tests.append(F.coalesce(F.expr(r.trigger).cast("boolean"), F.lit(False)))
    which = F.lit(None).cast("int")
    for i, test in reversed(list(enumerate(tests))):
        which = F.when(test, i).otherwise(which)
    picked = rows.withColumn("rule_", which)
    value = lambda f, kind: F.coalesce(*[F.when(F.col("rule_") == i, f(r)) for i, r in enumerate(found)], F.lit(None)).cast(kind) if found else F.lit(None).cast(kind)
    outcome = {
        "exception_type": value(lambda r: F.lit(r.exception_type), "string"), "priority": S.priority(value(lambda r: F.lit(r.priority), "string")) if found else F.lit(None).cast("string"), "priority_score": value(lambda r: F.lit(r.score).try_cast("int"), "int"),
        "panel": value(lambda r: F.lit(r.panel), "string"), "recommendation": value(lambda r: _filled(r.pattern, rows), "string"), "evidence": value(lambda r: F.lit(r.trigger), "string"),
    }
    matched = F.col("rule_").isNotNull()
    return picked.withColumns({c: F.when(matched, v) for c, v in outcome.items()}).drop("rule_")


def counted(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """rows (of classify.unchanged) with the counters of their run, gathered while whatever plan they are in runs."""
    ruled, skip, known = F.col("panel").isNotNull(), F.col("unchanged"), F.col("exception_id").isNotNull()
    observation = Observation(name)
    counters = {"total": F.lit(True), "processed": ruled & ~skip, "created": ruled & ~skip & ~known, "updated": ruled & ~skip & known, "skipped": skip, "for_review": ~ruled}
    return rows.observe(observation, *[F.count_if(c).alias(k) for k, c in counters.items()]), observation


def run(t, tables: dict[str, str], run_id: str, functions: list[str], suppliers: list[str], as_of: str, run_time: str, rules: DataFrame | None = None) -> DataFrame:
    """Classifies all active lines and persists what is new; returns the run's record, one row with its counters and status.

    tables has the folders of the versions of `exceptions`, `lines` and `runs`. The decision tree comes first; lines that it leaves
    go through the rules, if any. Lines are classified once: counters are observed while what is due is written. A run that is repeated
    under its id reads its record and does nothing else; one that fails leaves a record with status ERROR and its message. Each step's
    shuffle files go before the next one.
    """
    from ..sources.files import read_version, versions
    from ..sources.shared import release, shared_folder

    spark = t._spark
    record = lambda status, counters, message=None: spark.createDataFrame(
        [(run_id, status, *(int(counters.get(k, 0)) for k in COUNTERS), message)], "run_id string, status string, " + ", ".join(f"{k} long" for k in COUNTERS) + ", message string"
    )
    if any(x["label"] == run_id for x in versions(spark, tables["runs"])):
        return read_version(spark, tables["runs"]).filter(F.col("run_id") == run_id)
    release(spark)
    try:
        exceptions, lines = read_version(spark, tables["exceptions"]), read_version(spark, tables["lines"])
        noted = classify.with_outcome(classify.with_notes(classify.enriched_lines(lines.filter(F.col("po_status").isin(*ACTIVE)), t, functions, suppliers), as_of))
        if rules is not None:
            outcome = [*classify.SAME, "evidence"]
            free = noted.filter("panel is null").drop(*outcome)
            noted = noted.filter("panel is not null").unionByName(first_match(free, rules).select(noted.columns))
        rows, observation = counted(classify.unchanged(noted, exceptions).select(*classify.RECORDED, "unchanged"), f"classification {run_id}")
        path = shared_folder(spark, "classified")
        rows.filter("panel is not null and not unchanged").write.parquet(path)
        counters = observation.get
        release(spark)
        due = spark.read.schema(rows.schema).parquet(path)
        made = classify.records(due, classify.max_exception_id(exceptions)).drop("is_new")
        merge_into(spark, tables["exceptions"], made, ["exception_id"], run_id)
        release(spark)
        stamp = due.select("po_number", "line_item", F.lit(run_time).cast("timestamp").alias("ai_processed_at"), F.lit(False).alias("ai_reanalysis_needed"))
        merge_into(spark, tables["lines"], stamp, ["po_number", "line_item"], run_id)
        done = record("SUCCESS", counters)
    except Exception as e:
        merge_into(spark, tables["runs"], record("ERROR", {}, str(e).splitlines()[0][:500]), ["run_id"], f"{run_id}-failed")
        raise
    merge_into(spark, tables["runs"], done, ["run_id"], run_id)
    return read_version(spark, tables["runs"]).filter(F.col("run_id") == run_id)


COUNTERS = ["total", "processed", "created", "updated", "skipped", "for_review"]
