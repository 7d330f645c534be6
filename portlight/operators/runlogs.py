"""Run logs: rows for display and a compact timeline of their entries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

#: Messages that only mark progress.
NOISE = r"^Page \d+:|^Deactivating stale |reconcile skipped"
ENTRIES = "array<struct<level:string,timestamp:string,message:string>>"


def view(runs: DataFrame, logs: DataFrame) -> DataFrame:
    """Scheduler runs (run_id, job_name, run_status, started_at, and place, their order), the first of each run_id, with their
    logs; what the log has wins."""
    place = F.col("place") if "place" in runs.columns else F.lit(0)
    first = runs.groupBy("run_id").agg(F.min(F.struct(place.alias("place"), "started_at", "job_name", "run_status")).alias("r"))
    rows = first.select("run_id", "r.job_name", "r.run_status", F.col("r.started_at").alias("run_started"))
    rows = rows.join(logs.select("run_id", "status", "started_at", "completed_at", "total_tokens"), "run_id", "left")
    return rows.select(
        "run_id", "job_name", S.run_status(S.first_text("status", "run_status")).alias("status"), F.coalesce("started_at", "run_started").alias("started_at"),
        S.duration_text("started_at", "completed_at").alias("duration"), F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
    )


def newest_first(rows: DataFrame) -> DataFrame:
    return rows.orderBy(F.desc_nulls_last("started_at"), "run_id")


#: Kinds of jobs.
AI, MASTER, TRANSACTIONAL, CARRIER = "AI_ANALYSIS", "S4_MASTER_SYNC", "S4_TRANSACTIONAL_SYNC", "S4_CHR_SYNC"


def job_type(given, provider, name) -> Column:
    """The kind of a run: as given, else from its provider and job name."""
    p, n = (F.upper(F.coalesce(S.col(c), F.lit(""))) for c in (provider, name))
    return (
        F.when(S.first_text(given).isNotNull(), S.col(given)).when((p == "CHR") | F.contains(n, F.lit("CHR")), CARRIER)
        .when((p == "SAP") | F.contains(p, F.lit("S/4")), F.when(F.contains(n, F.lit("MASTER")), MASTER).otherwise(TRANSACTIONAL)).otherwise(AI)
    )


def _count(c: str) -> Column:
    return F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))


def run_summary(kind: Column) -> Column:
    """One sentence on a run with status, started_at, completed_at, error_message, total_batch_size, processed_count,
    created_count, updated_count, skipped_count and error_count; kind is its job_type."""
    status = S.run_status("status")
    done, made, changed, skipped, failed, total = map(_count, ("processed_count", "created_count", "updated_count", "skipped_count", "error_count", "total_batch_size"))
    text, grouped = lambda c: c.cast("string"), lambda c: F.format_number(c, 0)
    error = F.trim(S.first_text("error_message", F.lit("Job failed")))
    running = F.when(total > 0, F.concat(F.lit("Running… "), text(done), F.lit("/"), text(total), F.lit(" processed"))).otherwise("Running…")
    some = lambda c, shown, label: F.when(c > 0, F.concat(shown(c), F.lit(f" {label}")))
    after = F.coalesce(F.concat(F.lit(" · "), S.duration_text("started_at", "completed_at")), F.lit(""))
    upserted = F.when(done > 0, done).otherwise(made + changed)
    events = F.concat_ws(" · ", F.concat(text(upserted), F.when(upserted == 1, " event synced").otherwise(" events synced")), some(made, text, "new"), some(failed, text, "failed"))
    rows = F.concat_ws(" · ", F.concat(grouped(upserted), F.lit(" upserted")), some(made, grouped, "new"), some(changed, grouped, "updated"), some(skipped, grouped, "skipped"), some(failed, text, "failed"))
    short = F.when(F.length(error) > 140, F.concat(F.substring(error, 1, 137), F.lit("…"))).otherwise(error)
    analysis = F.concat(F.lit("Processed: "), text(done), F.lit(", Created: "), text(made), F.lit(", Updated: "), text(changed), F.lit(", Skipped: "), text(skipped), F.when(failed > 0, F.concat(F.lit(", Failed: "), text(failed))).otherwise(""))
    bad = status.isin("FAILURE", "ERROR")
    return F.when(kind == AI, F.when(bad, error).when(status == "RUNNING", running).otherwise(analysis)).when(bad, F.concat(short, after)).when(status == "RUNNING", running).when(kind == CARRIER, F.concat(events, after)).otherwise(F.concat(rows, after))


def analysis_summary() -> Column:
    """The closing sentence of an analysis run."""
    text = lambda c: _count(c).cast("string")
    seconds = F.coalesce(F.floor((F.unix_millis(F.col("completed_at").cast("timestamp")) - F.unix_millis(F.col("started_at").cast("timestamp")) + 500) / 1000).cast("string"), F.lit("0"))
    verb = F.when(S.run_status("status") == "SUCCESS", "completed").otherwise("finished with errors")
    return F.concat(
        F.lit("Analysis "), verb, F.lit(" — "), text("processed_count"), F.lit("/"), text("total_batch_size"), F.lit(" processed (Created: "), text("created_count"), F.lit(", Updated: "), text("updated_count"),
        F.lit(", Skipped: "), text("skipped_count"), F.lit(", Failed: "), text("error_count"), F.lit(") in "), seconds, F.lit("s"),
    )


def run_text_message(text) -> Column:
    """The message in a scheduler's run text: of a JSON array the first SUCCESS or FAILURE entry's text, which may be JSON
    with a message itself; '' where there is none."""
    entries = F.from_json(text, "array<struct<type:string,text:string>>")
    inner = F.get(F.filter(entries, lambda e: e["type"].isin("SUCCESS", "FAILURE")), F.lit(0))["text"]
    return F.coalesce(S.first_text(F.get_json_object(inner, "$.message"), inner), F.lit(""))


def token_usage(calls: DataFrame) -> DataFrame:
    """Calls and tokens of each run, from one row a call (run_id, input_tokens, output_tokens, total_tokens)."""
    total = S.token_total("total_tokens", "input_tokens", "output_tokens")
    sums = [F.sum(F.coalesce(c, F.lit(0))).alias(c.split("_")[0] + "_tokens") for c in ("input_tokens", "output_tokens")]
    return calls.groupBy("run_id").agg(F.count("*").alias("ai_calls"), *sums, F.sum(total).alias("total_tokens"))


def close_run(runs: DataFrame, usage: DataFrame, entries: DataFrame, longest: int = 250) -> DataFrame:
    """Log records of runs (run_id, status, started_at, completed_at, error_message): an unfinished run has no end, a long
    error is shortened, entries (run_id, at, level, message) become a JSON array in the order of time, and usage is added."""
    entry = F.struct(F.col("at").alias("timestamp"), "level", "message")
    logs = entries.groupBy("run_id").agg(F.to_json(F.array_sort(F.collect_list(entry))).alias("log_entries"))
    rows = runs.join(usage, "run_id", "left").join(logs, "run_id", "left").withColumn("status", S.run_status("status"))
    end = F.when(F.col("status") != "RUNNING", F.col("completed_at"))
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in usage.columns if c != "run_id"]
    return rows.select("run_id", "status", "started_at", end.alias("completed_at"), S.ellipsis("error_message", longest).alias("error_message"), F.coalesce("log_entries", F.lit("[]")).alias("log_entries"), *counts)


def timeline(logs: DataFrame) -> DataFrame:
    """run_id, at, level, message of logs (run_id, log_entries as JSON). Three or more progress entries of a run become one,
    at the time of the last. Entries that can't be read count as none."""
    rows = logs.select("run_id", F.posexplode(F.coalesce(F.from_json("log_entries", ENTRIES), F.array().cast(ENTRIES))).alias("at_", "e"))
    rows = rows.select("run_id", "at_", F.col("e.timestamp").alias("at"), F.col("e.level").alias("level"), F.col("e.message").alias("message"), F.coalesce(F.col("e.message").rlike(NOISE), F.lit(False)).alias("noise"))
    pages = rows.filter("noise").groupBy("run_id").agg(F.count("*").alias("n"), F.max("at").alias("at"))
    many = pages.filter("n > 2")
    kept = rows.join(many.select("run_id", F.lit(True).alias("many_")), "run_id", "left").filter("not (noise and many_ is not null)").select("run_id", "at", "level", "message")
    return kept.unionByName(many.select("run_id", "at", F.lit("info").alias("level"), F.concat(F.col("n").cast("string"), F.lit(" sync batch pages completed")).alias("message")))
