import functools
import os
import random

import pytest
from pyspark.sql import functions as F

from portlight.llm import ngram_join
from portlight.llm.common import materialise, maybe_in, shared_dir

WORDS = [f"w{i}" for i in range(5000)]


@pytest.fixture
def dealt(spark, monkeypatch):
    """Bytes that jobs of a function write to shuffles, where no side of a join is small but Bloom filters are."""
    monkeypatch.setattr(ngram_join, "maybe_in", functools.partial(maybe_in, bits=15))
    context = spark.sparkContext
    store = context._jsc.sc().statusStore()

    def written() -> int:
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, context._gateway.new_array(context._jvm.double, 0), context._jvm.java.util.ArrayList())
        return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))

    def measure(run) -> int:
        before = written()
        run()
        return written() - before

    name = "spark.sql.autoBroadcastJoinThreshold"
    threshold = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield measure
    spark.conf.set(name, threshold)


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices(WORDS, k=700))) for i in range(300)]
    rows += [(1000 + i, rows[i][1]) for i in range(6)]
    return materialise(spark.createDataFrame(rows, "doc_id long, text string"), "disk-docs")


def noop(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def test_only_keys_of_copied_sets_are_dealt_by_doc_id(spark, docs, dealt):
    whole = materialise(ngram_join.describe(docs, ngram_join.STAGE_WIDTH, ngram_join.STAGE_PERCENT, 0), "disk-sets")
    classes = whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"))
    classes = materialise(classes, "disk-classes")
    one = ngram_join._one_each(whole, classes)
    assert one.count() == classes.count() == 300
    keys = 8 * whole.selectExpr("sum(size(keys))").first()[0]
    assert 0 < dealt(lambda: noop(one)) < keys / 4


def test_only_texts_of_doubtful_ids_are_dealt_and_sets_are_deleted(spark, docs, dealt, monkeypatch):
    folder = f"{shared_dir(spark).removeprefix('file:')}/{spark.sparkContext.applicationId}"
    stored = lambda: {x for x in os.listdir(folder) if x.startswith(("ngram-sets", "ngram-tokens"))}
    before = stored()
    found = materialise(ngram_join.link_components(docs, ngram_join.STAGE_WIDTH, ngram_join.STAGE_PERCENT), "disk-found")
    assert stored() == before
    monkeypatch.setattr(ngram_join, "link_components", lambda *_: found)
    kept = ngram_join.keep_representatives(spark, docs, "")
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == list(range(300))
    assert 0 < dealt(lambda: noop(kept)) < docs.selectExpr("sum(length(text))").first()[0] / 8


def test_representatives_by_text_ids(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "maybe_in", functools.partial(maybe_in, bits=15))
    rows = [("01", "a b c d e f"), ("2", "A B C D E F"), ("3", "q r s t u v"), ("3", "k l m n o p"), ("4", ""), ("05", "zz yy xx ww vv"), (None, "a b c d e f")]
    docs = spark.createDataFrame(rows, "doc_id string, text string")
    kept = ngram_join.keep_representatives(spark, docs, "")
    assert kept.dtypes == docs.dtypes
    want = [("01", "a b c d e f"), ("3", "k l m n o p"), ("4", ""), ("05", "zz yy xx ww vv"), (None, "a b c d e f")]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
