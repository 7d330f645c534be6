"""SpotSigs fingerprints: chains of content words that follow common words, compared as sets. DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise, table, words_of

#: Common words (anchors) of English, German, French and Spanish.
COMMON_WORDS = (
    "a an and are as at be but by for from had has have he in is it of on or that the this to was were will with you "
    "das dem den der des die ein eine er es im ist mit nicht sich sie und von zu auf "
    "au aux ce dans de du elle en est et il la le les ne ou par pas pour que qui sur un une "
    "al como con del el los las no para por se su una y lo"
).split()
#: Content words in a chain.
CHAIN = 3
#: Documents of a range are ordered together to find each one's successor.
RANGE = 256
THRESHOLD = 0.8


def add_signatures(df: DataFrame, text: str, out: str) -> DataFrame:
    """Adds out, the sorted distinct hashes of the chains in the column text (null counts as empty).

    A chain is an anchor and the CHAIN content words after it, anchors in between skipped; at the end it may be shorter, so
    an anchor near the end counts too. Words without any anchor are one chain without anchor; no words, no chain.
    """
    common = lambda w: w.isin(COMMON_WORDS)
    kept = df.columns
    # columns of their own, so that the functions below read them and don't compute them again for each word
    df = df.withColumn("words_", words_of(F.col(text)))
    df = df.withColumn("anchors_", F.filter(F.transform("words_", lambda w, i: F.when(common(w), F.struct(i.alias("i"), w.alias("w")))), lambda x: x.isNotNull()))
    df = df.withColumn("content_", F.filter("words_", lambda w: ~common(w)))
    # before the j-th anchor, at i, stand i - j content words
    chains = F.transform("anchors_", lambda a, j: F.xxhash64(a["w"], *[F.get("content_", a["i"] - j + k) for k in range(CHAIN)]))
    alone = F.when(F.size("words_") > 0, F.array(F.xxhash64(F.array_join("words_", " ")))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.array_sort(F.array_distinct(F.when(F.size("anchors_") > 0, chains).otherwise(alone)))).select(*kept, out)


def fingerprint(signature: Column) -> Column:
    """Signatures as text: 16 hex digits each. Empty for a text without words."""
    return F.array_join(F.transform(signature, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard similarity of two signature sets, 1 for two empty ones. Below `least` it may return 0 without intersecting
    them: the smaller size over the larger one bounds it."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    shared = F.size(F.array_intersect(a, b))
    exact = shared / (F.size(a) + F.size(b) - shared)
    return F.when(large == 0, F.lit(1.0)).when((small == 0) | (small < least * large), F.lit(0.0)).otherwise(exact)


def with_next(rows: DataFrame, key: str, columns: list[str], span: int = RANGE) -> DataFrame:
    """Adds next_<column> of the row with the next larger key, of the row with the smallest one after the last.

    Rows are ordered within ranges of `span` keys; the successor of a range's last row is the first row of the next range
    that has one. So rows are shuffled once, and no task orders more than `span` keys together. Only rows at a place in
    their range where some range begins can be first rows: with keys without gaps that is one in `span`. Rows of one key
    follow each other in the order of `columns`, so every row has one successor.
    """
    w = Window.partitionBy("range_").orderBy(key, *columns)
    value = F.struct(*columns)
    ranged = rows.withColumn("range_", F.floor(F.col(key) / span))
    inner = ranged.withColumn("next_", F.lead(value).over(w))
    keys = rows.select(F.col(key).alias("key_"))
    firsts = keys.groupBy(F.floor(F.col("key_") / span).alias("next_range_")).agg(F.min("key_").alias("first_"))
    places = [r[0] for r in firsts.select(F.pmod("first_", F.lit(span))).distinct().collect()]  # at most span
    heads = ranged.filter(F.pmod(F.col(key), F.lit(span)).isin(places)).join(firsts, F.col(key) == F.col("first_")).groupBy("next_range_").agg(F.min(value).alias("head_"))
    heads = heads.join(next_ranges(keys, span), "next_range_").select("range_", "head_")
    out = inner.join(heads, "range_", "left").withColumn("next_", F.coalesce("next_", "head_"))
    return out.select(*rows.columns, *[F.col(f"next_.{c}").alias(f"next_{c}") for c in columns])


def next_ranges(keys: DataFrame, span: int) -> DataFrame:
    """range_, next_range_: the next range that has keys, the first one after the last."""
    return following(keys.select(F.floor(F.col("key_") / span).alias("range_")).distinct(), span)


def following(ranges: DataFrame, span: int) -> DataFrame:
    """range_, next_range_ of distinct numbers range_: the next one, the first one after the last. They are dealt to ranges
    of `span` in turn, level upon level, until one task orders at most `span` numbers on each."""
    low, high = ranges.agg(F.min("range_"), F.max("range_")).first()
    if low is None or high - low < span:
        w = Window.partitionBy(F.lit(0))
        return ranges.select("range_", F.coalesce(F.lead("range_").over(w.orderBy("range_")), F.min("range_").over(w)).alias("next_range_"))
    dealt = ranges.withColumn("upper_", F.floor(F.col("range_") / span))
    inner = dealt.withColumn("next_range_", F.lead("range_").over(Window.partitionBy("upper_").orderBy("range_")))
    tops = dealt.groupBy("upper_").agg(F.min("range_").alias("top_"))
    after = following(tops.select(F.col("upper_").alias("range_")), span).toDF("upper_", "next_upper_")
    heads = after.join(tops.toDF("next_upper_", "top_next_"), "next_upper_").select("upper_", "top_next_")
    return inner.join(heads, "upper_").select("range_", F.coalesce("next_range_", "top_next_").alias("next_range_"))


def edited_text(text: Column, next_text: Column) -> Column:
    """text with its last floor(n / 4) code points replaced by the first as many (or all) of next_text."""
    n = F.length(text)
    quarter = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - quarter), F.substring(next_text, F.lit(1), quarter))


def fingerprint_report(docs: DataFrame) -> DataFrame:
    """One row for each document (doc_id, text): its fingerprint, that of its edited text, and how alike they are.

    A null text is empty; rows without doc_id are left out (they have no place in the order); rows of one doc_id follow each
    other by text; the next document of a single one is itself; an empty table gives no rows; other columns are ignored.
    The fingerprints of equal texts are equal. Only the two likenesses asked for are computed here; similar_pairs() compares
    documents with each other.
    """
    rows = docs.filter("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = with_next(rows, "doc_id", ["text"])
    for text, sig in (("text", "sig"), ("next_text", "next_sig")):  # after the shuffle, which then carries texts alone
        rows = add_signatures(rows, text, sig)
    rows = rows.withColumn("edited", edited_text(F.col("text"), F.col("next_text")))
    rows = add_signatures(rows, "edited", "edited_sig")
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        fingerprint(F.col("sig")).alias("fingerprint"), fingerprint(F.col("edited_sig")).alias("edited_fingerprint"),
        likeness(F.col("sig"), F.col("edited_sig")).alias("near_edited"), likeness(F.col("sig"), F.col("next_sig")).alias("near_next"),
    )


def similar_pairs(docs: DataFrame, threshold: float = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b, likeness) of different signature sets at least `threshold` alike, named by their
    smallest doc_ids, and members (doc_id, class_id) of documents with equal sets.

    Sets are partitioned by length so that partners lie in one partition or the next; in each, a set meets those that
    share one of its first signatures in an order by rarity, enough of them that no partner is missed (prefix filter), and
    the length bound prunes before sets are intersected. Texts without words stand alone in one class without pairs.
    """
    sigs = add_signatures(docs.filter("doc_id is not null").select("doc_id", "text"), "text", "sig").select("doc_id", "sig")
    sigs = sigs.withColumn("class_key", F.sha2(fingerprint(F.col("sig")), 256))
    classes = materialise(sigs.groupBy("class_key").agg(F.min("doc_id").alias("class_id"), F.first("sig").alias("sig")), "spotsigs")
    members = sigs.select("doc_id", "class_key").join(classes.select("class_key", "class_id"), "class_key").select("doc_id", "class_id")
    sets = classes.filter(F.size("sig") > 0).select("class_id", "sig", F.size("sig").alias("n"))
    # rare signatures first: the count of each over all sets orders them
    rows = sets.select("class_id", "n", F.explode("sig").alias("s"))
    df = rows.groupBy("s").agg(F.count("*").alias("df"))
    ordered = rows.join(df, "s").groupBy("class_id", "n").agg(F.transform(F.array_sort(F.collect_list(F.struct("df", "s"))), lambda x: x["s"]).alias("order"))
    need = F.ceil(F.col("n") * threshold)
    probes = ordered.select("class_id", "n", F.explode(F.slice("order", F.lit(1), (F.col("n") - need + 1).cast("int"))).alias("s"))
    part = lambda n: F.floor(F.log(n) / F.log(F.lit(1 / threshold)))
    left = probes.select(F.col("class_id").alias("a"), F.col("n").alias("na"), "s", F.explode(F.array(part(F.col("n")), part(F.col("n")) + 1)).alias("p"))
    right = probes.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", part(F.col("n")).alias("p"))
    pairs = left.join(right, ["s", "p"]).filter("(na < nb or (na = nb and a < b))").filter(F.col("na") >= F.col("nb") * threshold)
    pairs = pairs.select("a", "b").distinct()
    of = lambda side: sets.select(F.col("class_id").alias(side), F.col("sig").alias(f"sig_{side}"))
    pairs = pairs.join(of("a"), "a").join(of("b"), "b").withColumn("likeness", likeness(F.col("sig_a"), F.col("sig_b"), threshold))
    return pairs.filter(F.col("likeness") >= threshold).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "likeness"), members


def op5_spotsigs(spark, sf_dir: str) -> DataFrame:
    return fingerprint_report(table(spark, sf_dir, "documents"))
