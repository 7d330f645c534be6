"""Quality classifier: an additive model with pairwise interactions over statistics of the whole text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .boosting import AdditiveModel, bounded_sample, fit_additive
from .common import free_name, limit_batches, mix64, table, word_hashes

#: Labelled rows that the model is fitted on at most.
TRAIN_ROWS = 20_000
#: A document is kept (predicted 1) from this score on.
THRESHOLD = 0.7

FEATURES = [
    "log_bytes", "upper", "lower", "digits", "symbols", "sentence_marks", "other_bytes", "spaces", "lines", "entropy",
    "log_words", "word_length", "word_length_spread", "distinct", "repeats_last", "most_common", "caps_words", "symbol_words", "distinct_pairs", "line_repeats",
    "short_words", "long_words", "bars", "worst_symbols", "worst_upper", "worst_repeats",
]

_CLASS = np.full(256, 6)  # of bytes: upper, lower, digits, symbols, sentence marks, white space, other
_CLASS[ord("A") : ord("Z") + 1], _CLASS[ord("a") : ord("z") + 1], _CLASS[ord("0") : ord("9") + 1] = 0, 1, 2
_CLASS[33:48] = _CLASS[58:65] = _CLASS[91:97] = _CLASS[123:127] = 3
_CLASS[[ord(x) for x in ".,;:?'\"-()"]] = 4
_CLASS[[32, 9, 10, 11, 12, 13]] = 5


def _worst(x: np.ndarray, width: int = 40) -> float:
    """The largest mean of x over blocks of `width` words."""
    if len(x) <= width:
        return float(x.mean())
    starts = np.arange(0, len(x) - width // 2, width)
    return float((np.add.reduceat(x, starts) / np.diff(np.r_[starts, len(x)])).max())


def features(text: str | None) -> np.ndarray:
    """FEATURES of a whole text; all zero without words."""
    data = (text or "").encode()
    out = np.zeros(len(FEATURES))
    words = word_hashes(data)
    if not len(words):
        return out
    b = np.frombuffer(data, dtype=np.uint8)
    counts = np.bincount(b, minlength=256)
    kind = np.bincount(_CLASS, counts, 7) / len(b)
    share = counts[counts > 0] / len(b)
    space = _CLASS[b] == 5
    edge = np.diff((~space).astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    length = ends - starts
    per_word = lambda k: np.add.reduceat((_CLASS[b] == k).astype(np.int32), starts)
    upper, lower, symbols = per_word(0), per_word(1), per_word(3)
    _, times = np.unique(words, return_counts=True)
    again = np.r_[False, words[1:] == words[:-1]]
    pairs = mix64(words[1:] * np.uint64(3) + words[:-1])
    lines = [x for x in data.split(b"\n") if x.strip()]
    caps, marked = (upper > lower) & (upper > 1), symbols > 0
    out[:] = (
        np.log(len(b)), kind[0], kind[1], kind[2], kind[3], kind[4], kind[6], kind[5], counts[10] / len(b), -(share * np.log2(share)).sum(),
        np.log(len(words)), length.mean(), length.std(), len(times) / len(words) ** 0.8, again.mean(), times.max() / len(words), caps.mean(), marked.mean(),
        len(np.unique(pairs)) / max(1, len(pairs)), 1 - len(set(lines)) / len(lines), (length <= 2).mean(), (length >= 15).mean(), counts[124] / len(words),
        _worst(marked.astype(float)), _worst(caps.astype(float)), _worst(again.astype(float)),
    )
    return out


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, bound: int = TRAIN_ROWS) -> AdditiveModel:
    """The model from labelled rows that aren't held out, `bound` at most, chosen by a hash of doc_id."""
    limit_batches(docs.sparkSession)
    known = labels.filter("doc_id is not null and quality is not null").filter(~is_held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality_"))
    known = bounded_sample(known, "doc_id", bound)
    joined = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")  # bounded by `bound`
    # of rows of one doc_id the smallest text counts, so that repeated ones can't outgrow the bound either
    joined = joined.groupBy("doc_id").agg(F.min(F.struct("text", "quality_")).alias("r")).select("doc_id", "r.text", "r.quality_")

    def measured(batches):
        for batch in batches:
            rows = [features(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.list_(pa.float64())), batch.column(2).cast(pa.float64()), batch.column(0).cast(pa.int64())], names=["x", "y", "doc_id"]
            )

    pdf = joined.mapInArrow(measured, "x array<double>, y double, doc_id long").toPandas().sort_values("doc_id", kind="stable")
    if not len(pdf):
        return fit_additive(np.zeros((1, len(FEATURES))), np.ones(1))
    return fit_additive(np.stack(pdf["x"].to_numpy()), pdf["y"].to_numpy())


def score_documents(docs: DataFrame, model: AdditiveModel, out: str) -> DataFrame:
    """Adds the column `out`, the score (0 to 1), to docs, from the whole text alone. A null text counts as empty."""
    limit_batches(docs.sparkSession)
    at, columns = docs.columns.index("text"), docs.columns

    def scored(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([features(t) for t in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(model.score(x))], names=[*columns, out])

    schema = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{out}` double"
    return docs.mapInArrow(scored, schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row of docs (doc_id, text).

    Labels of held-out documents are never read. Without labels, or with labels of one kind, the score is the smoothed share
    of label 1. Empty and null texts get the score of an all-zero row; repeated rows stay; other columns are ignored.
    """
    scored = score_documents(docs.select("doc_id", "text"), fit(docs, labels), "score")
    return scored.select(
        "doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def op6_additive_quality(spark, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def keep_good(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the classifier predicts as good, with the columns of docs, whatever they are called. Empty
    and null texts are judged by the score of an all-zero row; repeated rows stay or go together; an empty table stays empty."""
    score = free_name(docs, "score")
    return score_documents(docs, fit(docs, table(spark, sf_dir, "labels")), score).filter(F.col(score) >= THRESHOLD).select(docs.columns)
