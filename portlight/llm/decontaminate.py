"""Benchmark decontamination: SimHash fingerprints of item-sized windows, found by Hamming blocks, verified exactly.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, table, words_of

SHINGLE = 5
THRESHOLD = 0.8
#: Fingerprints of 64 bits within this distance are candidates. Shingle sets 0.8 alike differ in 10 bits on average,
#: with a standard deviation of 3.
RADIUS = 20
#: Rows of benchmark shingles up to which they are broadcast (about 50 MB); more are joined by shuffle.
BROADCAST_ROWS = 2_000_000


def add_shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds sh_, the hashes of all runs of SHINGLE words of the column text in order; empty where there are fewer words."""
    kept = df.columns
    df = df.withColumn("words_", F.transform(words_of(F.col(text)), lambda w: F.xxhash64(w)))
    runs = F.transform(F.sequence(F.lit(0), F.size("words_") - SHINGLE), lambda i: F.xxhash64(*[F.get("words_", i + k) for k in range(SHINGLE)]))
    return df.withColumn("sh_", F.when(F.size("words_") >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))).select(*kept, "sh_")


def simhash(shingles: str) -> Column:
    """64 bits: bit b is set when most shingles, each as often as it stands there, have it set."""
    votes = f"transform(sequence(0, 63), b -> aggregate({shingles}, 0, (v, h) -> v + 2 * cast(shiftright(h, b) & 1 as int) - 1))"
    whole = f"aggregate(transform({votes}, (v, b) -> if(v > 0, shiftleft(1L, b), 0L)), 0L, (x, y) -> x | y)"
    return F.expr(f"if(size({shingles}) = 0, 0L, {whole})")


def blocks(fingerprint: str, radius: int = RADIUS) -> Column:
    """radius + 1 runs of bits that make up the fingerprint: two within radius agree in one of them at least."""
    n, at, parts = radius + 1, 0, []
    for j in range(n):
        size = 64 * (j + 1) // n - at
        parts.append(f"shiftrightunsigned({fingerprint}, {at}) & {(1 << size) - 1}L")
        at += size
    return F.expr(f"array({', '.join(parts)})")


def weighted_jaccard(a: str, b: str) -> Column:
    """Sum of smaller over sum of larger counts of the shingles of two arrays."""
    count = f"aggregate(array_intersect({a}, {b}), 0, (s, x) -> s + least(size(filter({a}, y -> y = x)), size(filter({b}, y -> y = x))))"
    plain = f"size(array_distinct({a})) = size({a}) and size(array_distinct({b})) = size({b})"
    shared = f"if({plain}, size(array_intersect({a}, {b})), {count})"
    return F.expr(f"{shared} / cast(size({a}) + size({b}) - {shared} as double)")


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def find_leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, radius: int = RADIUS) -> DataFrame:
    """doc_id, item_id, similarity, first_word: documents (doc_id, text) that hold a benchmark item (item_id, text).

    Each shingle that a document shares with an item places windows of that item's length, in shingles, where the item
    would stand. A window's fingerprint meets those of the items of that length by radius + 1 blocks, which finds all
    within the radius, and the weighted Jaccard similarity of their shingles decides. A window without a shared shingle has
    similarity 0, so none is missed by not placing it. A document shorter than an item is one window. For each pair the
    most similar window counts, the first one of ties. Items of fewer than SHINGLE words identify no text and match none,
    as do null and empty texts; rows with a null doc_id or item_id are left out; repeated rows give one result; other
    columns are ignored.
    """
    items = add_shingles(benchmark.filter("item_id is not null").select("item_id", "text"), "text").select("item_id", F.col("sh_").alias("item_sh"), F.size("sh_").alias("len_"))
    items = materialise(items.filter("len_ > 0").distinct().withColumn("item_fp", simhash("item_sh")), "decontaminate-items")
    places = items.select("len_", F.posexplode("item_sh").alias("off_", "s_")).distinct()
    n = places.count()
    whole = docs.filter("doc_id is not null").select("doc_id", "text")
    # the outer form: Spark adds no filter on the array, which it would compute anew for it
    rows = add_shingles(whole, "text").select("doc_id", F.size("sh_").alias("n_"), F.posexplode_outer("sh_").alias("at_", "s_"))
    seeds = rows.join(_small(places, n), "s_")
    start = F.greatest(F.lit(0), F.least(F.col("at_") - F.col("off_"), F.col("n_") - F.col("len_")))
    windows = seeds.select("doc_id", F.struct(start.alias("start"), F.col("len_").alias("len")).alias("w_"))
    windows = windows.groupBy("doc_id").agg(F.collect_set("w_").alias("windows_"))
    cut = add_shingles(whole.join(windows, "doc_id"), "text").select("doc_id", "sh_", F.explode("windows_").alias("w_"))
    cut = cut.select("doc_id", F.col("w_.start").alias("first_word"), F.col("w_.len").alias("len_"), F.slice("sh_", F.col("w_.start") + 1, F.col("w_.len")).alias("win_sh"))
    cut = cut.withColumn("win_fp", simhash("win_sh"))
    ours = cut.withColumn("win_blocks", blocks("win_fp", radius)).select("*", F.posexplode_outer("win_blocks").alias("j_", "v_"))
    marks = items.select("len_", "item_fp").distinct()  # one for all items with this fingerprint; arrays come after the Hamming test
    theirs = marks.withColumn("item_blocks", blocks("item_fp", radius)).select("*", F.posexplode_outer("item_blocks").alias("j_", "v_"))
    pairs = ours.join(_small(theirs, marks.count() * (radius + 1)), ["len_", "j_", "v_"])
    first = F.expr("array_position(transform(win_blocks, (x, i) -> x = item_blocks[i]), true) - 1")  # one of the blocks in common
    pairs = pairs.filter((F.col("j_") == first) & (F.expr("bit_count(win_fp ^ item_fp)") <= radius))
    pairs = pairs.select("doc_id", "first_word", "len_", "win_sh", "item_fp").join(_small(items, n), ["len_", "item_fp"])
    pairs = pairs.withColumn("similarity", weighted_jaccard("win_sh", "item_sh")).filter(F.col("similarity") >= threshold)
    best = F.max(F.struct("similarity", (-F.col("first_word")).alias("m"))).alias("best")
    return pairs.groupBy("doc_id", "item_id").agg(best).select("doc_id", "item_id", F.col("best.similarity").alias("similarity"), (-F.col("best.m")).cast("long").alias("first_word"))


def op3_simhash_decontamination(spark, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def drop_leaks(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents without a benchmark item, with the columns of docs, whatever they are called. Rows without
    doc_id or words stay; all rows of a doc_id go when one of them holds an item; an empty table stays empty."""
    found = find_leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)
