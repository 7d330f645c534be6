import json
import os
import random

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from portlight.operators import merge
from portlight.sources import feed, files
from portlight.streaming import events as streaming

SCHEMA = "source_hash string, event_time timestamp, po_number string, v string"


def events(spark, rows):
    return spark.createDataFrame(rows, "source_hash string, at string, po_number string, v string").select("source_hash", F.col("at").cast("timestamp").alias("event_time"), "po_number", "v")


def landed(spark, folder, hours, salt=""):
    feed.land_hours(events(spark, [(f"h{h}-{k}{salt}", f"2024-01-0{1 + h // 24} {h % 24:02d}:{k * 5:02d}:00", f"PO{k}", f"v{h}") for h in hours for k in range(3)]), folder)


def test_feed_replays_a_batch_and_overlaps(spark, tmp_path):
    """The sink fails in the middle of a batch, after it has written; the restarted stream gives the table of a batch run."""
    source, folder, ck = str(tmp_path / "in"), str(tmp_path / "t"), str(tmp_path / "ck")
    seen, broken = [], [True]
    sink = streaming.table_sink(folder, ["source_hash"])

    def failing(batch, number):
        seen.append((number, sorted(r.source_hash for r in batch.select("source_hash").collect())))
        sink(batch, number)
        if broken and number == 1:
            broken.clear()
            raise RuntimeError("lost")

    def go():
        run = streaming.run(feed.read_feed(spark, source, SCHEMA, 120), failing, ck)
        run.awaitTermination(120)

    landed(spark, source, range(3))
    go()
    landed(spark, source, range(3, 6))
    landed(spark, source, [1, 2], "-late")  # two hours that were read: one is within the look-back
    with pytest.raises(StreamingQueryException):
        go()
    landed(spark, source, [6])
    go()  # the batch that was lost
    go()
    numbers = [n for n, _ in seen]
    assert numbers[:3] == [0, 1, 1] and seen[1] == seen[2] and len(numbers) >= 3
    assert any(x.startswith("h2-") for x in seen[1][1]) and "h2-0-late" in seen[1][1]
    want = {f"h{h}-{k}" for h in range(7) for k in range(3)} | {f"h{h}-{k}-late" for h in (1, 2) for k in range(3)}
    got = [r.source_hash for r in files.read_version(spark, folder).collect()]
    assert set(got) == want and len(got) == len(want)
    assert [x["label"] for x in files.versions(spark, folder)] == [f"batch-{n}" for n in sorted(set(numbers))]


def test_feed_without_news_has_no_batch(spark, tmp_path):
    seen = []
    for _ in range(2):
        streaming.run(feed.read_feed(spark, str(tmp_path / "none"), SCHEMA), lambda b, n: seen.append(b.count()), str(tmp_path / "ck")).awaitTermination(60)
    assert sum(seen) == 0


def file_stream(spark, folder, batches):
    folder.mkdir()
    for i, rows in enumerate(batches):
        (folder / f"{i}.json").write_text("\n".join(json.dumps(dict(zip(("source_hash", "event_time", "po_number", "v"), r, strict=True))) for r in rows))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i,) * 2)  # files are read in the order of their times
    return streaming.read_stream(spark, str(folder), SCHEMA, files=1)


def test_state_gives_ids_and_links(spark, tmp_path):
    """The table after several batches is that of one upsert over all rows; only new events mark their orders' lines."""
    batches = [[(f"{k:02d}" * 20, f"2024-01-01T0{i}:{k:02d}:00Z", f"PO{k % 4}", f"v{i}") for k in range(i, i + 6)] * 2 for i in range(4)]
    orders = spark.createDataFrame([("PO1",), ("PO2",)], "po_number string")
    lines = spark.createDataFrame([(f"PO{k}", "10", "OPEN", True, None, False) for k in range(4)], "po_number string, line_item string, po_status string, ai_processed boolean, ai_processed_at timestamp, ai_reanalysis_needed boolean")
    folder, line_folder = str(tmp_path / "t"), str(tmp_path / "lines")
    files.write_version(lines, line_folder, 1)
    marked = []
    sink = streaming.events_sink(folder, line_folder, orders)

    def watched(batch, number):
        marked.append(sorted(r.source_hash[:2] for r in batch.filter("is_new").collect()))
        sink(batch, number)

    streaming.run(streaming.with_known_ids(file_stream(spark, tmp_path / "in", batches)), watched, str(tmp_path / "ck")).awaitTermination(120)
    assert [m for m in marked if m] == [["00", "01", "02", "03", "04", "05"], ["06"], ["07"], ["08"]]
    got = {r.source_hash: (r.id, r.po_number, r.v, r.po_linked) for r in files.read_version(spark, folder).collect()}
    want = {}
    for i, rows in enumerate(batches):
        for key, _, po, v in rows:
            want[key] = (key[:32], po, v, po in ("PO1", "PO2"))
    assert got == want
    after = {r.po_number: (r.ai_processed, r.ai_reanalysis_needed) for r in files.read_version(spark, line_folder).collect()}
    assert after == {"PO0": (True, False), "PO1": (False, True), "PO2": (False, True), "PO3": (True, False)}


def test_state_ends_with_its_time(spark, tmp_path):
    """A key is known while its state lasts, and new again after that, with the same id."""
    batches = [[("a" * 40, "2024-01-01T00:00:00Z", "P", "1")], [("a" * 40, "2024-01-01T00:30:00Z", "P", "2")], [("b" * 40, "2024-01-03T00:00:00Z", "P", "3")], [("c" * 40, "2024-01-03T00:10:00Z", "P", "4")], [("a" * 40, "2024-01-03T00:20:00Z", "P", "5")]]
    seen = []
    stream = streaming.with_known_ids(file_stream(spark, tmp_path / "in", batches), late="10 minutes", keep_minutes=60)
    streaming.run(stream, lambda b, n: seen.extend((r.source_hash[0], r.id, r.is_new) for r in b.collect()), str(tmp_path / "ck")).awaitTermination(120)
    assert seen == [("a", "a" * 32, True), ("a", "a" * 32, False), ("b", "b" * 32, True), ("c", "c" * 32, True), ("a", "a" * 32, True)]


def test_late_rows_are_kept(spark, tmp_path):
    """On time and late are all rows, whatever their order; a batch that comes again is split as it was."""
    rows = [(f"h{i}", f"2024-01-{1 + i // 4:02d}T{(i % 4) * 6:02d}:00:00Z", "P", str(i)) for i in range(40)]
    random.Random(3).shuffle(rows)
    batches = [rows[i : i + 8] for i in range(0, 40, 8)]
    folder, late = str(tmp_path / "t"), str(tmp_path / "late")
    sink, held = streaming.late_sink(folder, late, ["source_hash"], minutes=2880), {}

    def twice(batch, number):
        sink(batch, number)
        held[number] = len(files.versions(spark, folder)), len(files.versions(spark, late))
        sink(batch, number)
        assert held[number] == (len(files.versions(spark, folder)), len(files.versions(spark, late)))

    streaming.run(file_stream(spark, tmp_path / "in", batches), twice, str(tmp_path / "ck")).awaitTermination(120)
    on_time = {r.source_hash for r in files.read_version(spark, folder).collect()}
    behind = {r.source_hash: r.late_seconds for r in files.read_version(spark, late).collect()}
    assert on_time | set(behind) == {r[0] for r in rows} and not on_time & set(behind)
    want, newest = {}, None
    seconds = lambda text: spark.sql(f"select unix_timestamp(timestamp '{text}')").first()[0]
    at = {r[0]: seconds(r[1]) for r in rows}
    for batch in batches:
        for key, *_ in batch:
            if newest is not None and at[key] < newest - 2880 * 60:
                want[key] = newest - 2880 * 60 - at[key]
        newest = max([newest or 0, *(at[r[0]] for r in batch)])
    assert behind == want and want


def test_progress_becomes_a_run_log(spark, tmp_path):
    progress = streaming.Progress()
    spark.streams.addListener(progress)
    try:
        streaming.run(file_stream(spark, tmp_path / "in", [[("a", "2024-01-01T00:00:00Z", "P", "1")] * (i + 1) for i in range(3)]), lambda b, n: b.count(), str(tmp_path / "ck"), "events").awaitTermination(120)
        for _ in range(100):
            if any(r[6] == "SUCCESS" for r in progress.rows):
                break
            import time

            time.sleep(0.1)
    finally:
        spark.streams.removeListener(progress)
    (run,) = progress.runs(spark).collect()
    assert (run.job_name, run.batches, run.rows, run.status) == ("events", 3, 6, "SUCCESS")
    folder = str(tmp_path / "log")
    progress.save(spark, folder, "one")
    assert progress.save(spark, folder, "one").count() == 1 and merge.log_upsert(files.read_version(spark, folder).select("run_id", "status"), spark.createDataFrame([(run.run_id, "RUNNING")], "run_id string, status string")).first().status == "SUCCESS"
