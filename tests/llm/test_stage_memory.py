import pyarrow as pa
import pytest

import corpus_pipeline
from portlight.llm import ngram_join
from portlight.llm.suffix_dedup import remove_repeats

from .. import oracle

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def largest_batch(spark) -> int:
    """Rows of the largest batch that a task of the session gets now."""

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["rows"])

    return spark.range(0, 12_000, 1, 1).mapInArrow(sizes, "rows long").agg({"rows": "max"}).first()[0]


@pytest.mark.parametrize("name", ["quality", "repeated_strings", "op10"])
def test_whole_texts_go_to_python_in_small_batches(spark, name):
    """Round 3, finding 1: a batch of 10,000 rows held all texts of a split, in the executor and in its worker. Plans are lazy, so the
    limit has to hold when the result is asked for."""
    before = spark.conf.get(BATCH)
    spark.conf.set(BATCH, 10_000)
    try:
        assert largest_batch(spark) == 10_000
        docs = spark.read.parquet(f"{oracle.SF}/documents.parquet").limit(30)
        out = remove_repeats(docs) if name == "op10" else dict(corpus_pipeline.STAGES)[name](spark, docs, oracle.SF)
        assert largest_batch(spark) <= 1000
        assert out.count() <= 30 and largest_batch(spark) <= 1000
    finally:
        spark.conf.set(BATCH, before)


def test_near_duplicates_broadcast_no_side_that_grows(spark, monkeypatch):
    """Round 4, F1: sides with a row for each text were broadcast up to 10 MB of files, which is many times that on the driver's heap."""
    name, seen, plain = "spark.sql.autoBroadcastJoinThreshold", [], ngram_join.materialise
    before = spark.conf.get(name)

    def watched(df, label):
        seen.append(int(str(spark.conf.get(name)).rstrip("b")))
        return plain(df, label)

    monkeypatch.setattr(ngram_join, "materialise", watched)
    out = ngram_join.keep_representatives(spark, spark.read.parquet(f"{oracle.SF}/documents.parquet"), oracle.SF)
    assert seen and max(seen) <= 1 << 20 and spark.conf.get(name) == before
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") == plan.count("BroadcastHashJoin [page_") == 2 and plan.count("SortMergeJoin") == 1
    # the texts that are joined find the window dealt: the join's two exchanges, and two for each filter
    assert plan.count("Exchange hashpartitioning") == 6 and out.count() > 0
