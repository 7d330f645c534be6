"""Exact n-gram Jaccard self-join by a token-group matrix, with the connected components of its links.

Documents with equal shingle sets are one node. Nodes are partitioned into groups of similar ones by content: a set is cut
into so many segments, by hashes of its shingles, that two sets which link must agree in one segment at least, whole; who
shares a segment meets in its bucket, whose smallest node is a pivot that all others are compared with. Where that leaves a
bucket in several components, its documents and those that buckets connect with them are partitioned into groups: the
token-group matrix holds each group's union of shingles, a document's overlap with a union bounds its overlap with any
member, and only groups whose bound suffices are opened, member by member.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, free_name, materialise, maybe_in, mix64, release, shingle_hashes, small_batches, small_broadcasts, table, word_hashes
from .suffix_dedup import digest

WIDTH = 3
#: Two sets link when 100 * shared >= PERCENT * union.
PERCENT = 90
#: The same of the pipeline's stage: five words, 0.8.
STAGE_WIDTH, STAGE_PERCENT = 5, 80
#: Sizes from one bound to the next share a number of segments; sizes near a bound use that of both sides.
SIZE_STEP = 1.4
#: Sets below this size link only when they differ in two shingles at most; they are named by what is left without one or two.
SMALL = 29
#: Segment keys are dealt in so many turns, each of which frees its shuffle files before the next one.
TURNS = 2
#: Shingles in a group of similar sets; two groups are opened together in one task.
GROUP_TOKENS = 100_000


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text."""
    return np.unique(shingle_hashes(word_hashes((text or "").encode()), width))


@lru_cache
def size_bounds() -> list[int]:
    out = [1, SMALL]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * SIZE_STEP)))
    return out


def size_classes(n: int, percent: int = PERCENT) -> list[int]:
    """The size classes a set of n takes part in: that of each size it may link with."""
    bounds = size_bounds()
    most = 100 * n // percent
    return sorted({int(np.searchsorted(bounds, x, side="right")) - 1 for x in (n, most)})


def segments(percent: int, size_class: int) -> int:
    """One more than the most shingles that two linked sets differ in, the larger of which is of size_class."""
    most = size_bounds()[size_class + 1] - 1
    return 2 * most * (100 - percent) // (100 + percent) + 1


def segment_keys(tokens: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    """Hashes that name (size class, segment, its shingles). Segments without shingles are cut anew by another hash."""
    if percent < PERCENT:
        return _loose_keys(tokens, percent)
    out = []
    for size_class in size_classes(len(tokens), percent):
        n = segments(percent, size_class)
        if size_class == 0 and n <= 3:
            out.append(_left_over(tokens, percent))
            continue
        cut = lambda salt, name: _cut(tokens, n, np.uint64(salt), name)
        keys, empty = cut(1, np.uint64(size_class))
        out.append(keys)
        for j in empty:
            again, still = cut(2, mix64(np.array([size_class * 1_000_003 + j + 7], dtype=np.uint64))[0])
            out += [again, mix64(still.astype(np.uint64) + np.uint64(31 * size_class + 17) * np.uint64(j + 1))]
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _most_apart(percent: int, both: int) -> int:
    """The most shingles that two linked sets differ in whose sizes add up to both."""
    return both * (100 - percent) // (100 + percent)


@lru_cache
def _loose_bounds(percent: int) -> list[int]:
    out = [1]
    while out[-1] < 1 << 40:
        low = after = out[-1]
        while after < SMALL and _most_apart(percent, 2 * after) == _most_apart(percent, 2 * low):
            after += 1
        out.append(max(after, low + 1, int(low * SIZE_STEP)))
    return out


def _loose_keys(tokens: np.ndarray, percent: int) -> np.ndarray:
    """segment_keys for looser bounds, where segments are so small that many stay empty.

    A segment counts when it holds `least` shingles. If more segments of a set count than a set it links with differs from it
    in shingles, one that counts is equal in both. Each set is cut anew until so many count, so two sets that link share
    all cuts up to the first one that suffices for either.
    """
    bounds, n, out = _loose_bounds(percent), len(tokens), []
    biggest = 100 * n // percent
    first, last = (int(np.searchsorted(bounds, x, side="right")) - 1 for x in (n, biggest))
    for size_class in range(first, last + 1):
        top = bounds[size_class + 1] - 1
        apart = _most_apart(percent, n + min(biggest, top))
        if not apart:
            continue  # links with equal sets only, which are one node
        count = (_most_apart(percent, 2 * top) + 1) * 5 // 4 + 1
        for turn in range(1 << 20):
            least = 2 if bounds[size_class] > SMALL and turn < 4 else 1
            keys = _full_segments(tokens, count, least, mix64(np.array([size_class * 1_000_003 + turn], dtype=np.uint64))[0])
            out.append(keys)
            if len(keys) > apart:
                break
    return np.unique(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def _full_segments(tokens: np.ndarray, n: int, least: int, salt: np.uint64) -> np.ndarray:
    """Hashes of the segments that hold `least` tokens at least."""
    with np.errstate(over="ignore"):
        place = (mix64(tokens + salt) % np.uint64(n)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, value = place[order], mix64(tokens[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        keys = mix64(mix64(np.add.reduceat(value, firsts)) + mix64(place[firsts].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + salt))
        return keys[np.diff(np.r_[firsts, len(tokens)]) >= least]


def _left_over(tokens: np.ndarray, percent: int) -> np.ndarray:
    """Hashes of a small set whole, without each shingle and without each two, as far as a set that links may lack them."""
    n = len(tokens)
    with np.errstate(over="ignore"):
        value = mix64(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        total = value.sum(dtype=np.uint64)
        sums = [np.array([total])]
        if percent * n <= 100 * (n - 1):
            sums.append(total - value)
        if percent * n <= 100 * (n - 2):
            i, j = np.triu_indices(n, 1)
            sums.append(total - value[i] - value[j])
        return mix64(mix64(np.concatenate(sums)) + np.uint64(77))


def _cut(tokens: np.ndarray, n: int, salt: np.uint64, name: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        place = (mix64(tokens + salt) % np.uint64(n)).astype(np.int64)
        order = np.argsort(place, kind="stable")
        place, value = place[order], mix64(tokens[order] ^ np.uint64(0xA5A5A5A5A5A5A5A5))
        firsts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        sums = np.add.reduceat(value, firsts)
        keys = mix64(mix64(sums) + mix64(place[firsts].astype(np.uint64) * np.uint64(0x632BE59BD9B4E019) + name))
    return keys, np.setdiff1d(np.arange(n), place[firsts])


_SETS = "doc_id long, n long, node long, check long, keys array<long>"


def describe(docs: DataFrame, width: int, percent: int, seed: int) -> DataFrame:
    """_SETS of each document: size and digest of its shingle set (node, and check, which tells a collision of nodes), and
    its segment keys."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).cast(pa.int64()), batch.column(1).to_pylist()
            n, node, check, keys = [], [], [], []
            for text in texts:
                tokens = shingle_set(text, width)
                a, b = digest(tokens.tobytes(), seed)
                n.append(len(tokens)), node.append(a), check.append(b)
                keys.append(segment_keys(tokens, percent).view(np.int64) if len(tokens) else np.zeros(0, dtype=np.int64))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.array(check, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "node", "check", "keys"])

    return docs.select("doc_id", "text").mapInArrow(run, _SETS)


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose sets (node, tokens) link."""

    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), dtype=np.uint64) for v in (x, y))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                shared = int((large[at] == small).sum())
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    of = lambda side: sets.select(F.col("node").alias(side), F.col("tokens").alias(f"tokens_{side}"))
    return pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "tokens_a", "tokens_b").mapInArrow(run, "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node) of every end of edges (a, b), by alternating large and small stars."""
    now = materialise(edges.select(F.least("a", "b").alias("v"), F.greatest("a", "b").alias("u")).filter("u <> v").distinct(), "components")
    mark = lambda df: tuple(df.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
    before = mark(now)
    while before[0]:
        both = now.union(now.select("u", "v"))  # v, u: each edge from both ends
        least = both.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("m", "v").alias("m"))
        large = both.filter("u > v").join(least, "v").select("m", "u").filter("u <> m").distinct().toDF("v", "u")
        large = materialise(large, "components")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select("m", F.explode(F.array("u", "v")).alias("u")).filter("u <> m").distinct().toDF("v", "u")
        now = materialise(small, "components")
        if (after := mark(now)) == before:
            break
        before = after
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v").distinct())


def link_components(docs: DataFrame, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id of every row of docs (doc_id, text); component_id is the smallest doc_id that links
    reach, the document's own without links.

    Words are cut at ASCII white space, A-Z lower-cased. Null and empty texts have no shingles and link with nothing, also
    not with each other. Rows without doc_id stay, without a component, and link with nothing. Each row counts by its own
    text, also where a doc_id repeats. Other columns are ignored.
    """
    with small_batches(docs.sparkSession), small_broadcasts(docs.sparkSession):
        described, found = _described_and_found(docs, width, percent)
    out = described.select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("node")).alias("node")).join(found.hint("merge"), "node", "left")  # one row a text: not broadcast
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _described_and_found(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, node of each document; node, component_id), both written."""
    spark = docs.sparkSession
    seed = 0
    while True:
        described = materialise(describe(docs, width, percent, seed), "ngram-sets")
        whole = described.filter("n > 0 and doc_id is not null")
        classes = whole.groupBy("node").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min("check").alias("x"), F.max("check").alias("y"))
        classes = materialise(classes, "ngram-classes")
        if classes.filter("x <> y").isEmpty():
            break
        seed += 1  # two different sets with one digest: all are named anew
        discard(described)
    nodes = materialise(described.select("doc_id", "n", "node"), "ngram-nodes")
    plain, members = _crowds(whole, classes)
    discard(described)  # the keys are the largest table by far
    links = _all_links(docs, classes, plain, members, width, percent)
    reached = components(links)
    named = classes.select("node", "rep").join(reached, "node", "left").select("node", "rep", F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    found = materialise(named.join(least, "component").select("node", "component_id"), "ngram-found")
    release(spark)
    return nodes, found


def _one_each(whole: DataFrame, classes: DataFrame) -> DataFrame:
    """node, keys, once for each node: of copies the one named rep. Only rows of nodes with copies are shuffled, by their
    own doc_id, so that copies in any number spread. A semi-join would be pushed below the Bloom filter, and deal all keys."""
    copied = classes.filter("copies > 1").select("rep", F.col("node").alias("node_"))
    alone = maybe_in(whole, "node", copied.select("node_"), wanted=False)
    first = maybe_in(whole, "node", copied.select("node_")).join(classes.select("rep", F.col("node").alias("node_")), (F.col("doc_id") == F.col("rep")) & (F.col("node") == F.col("node_")))
    return alone.select("node", "keys").unionByName(first.dropDuplicates(["doc_id", "node"]).select("node", "keys"))


def _crowds(whole: DataFrame, classes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): pairs (a, b) of nodes in buckets of two, and key, node, pivot of the buckets of more, both written."""
    spark, buckets = whole.sparkSession, None
    rows = _one_each(whole, classes).select("node", F.explode("keys").alias("key"))
    for turn in range(TURNS):
        met = rows.filter(F.pmod("key", F.lit(TURNS)) == turn).groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("b"), F.count("*").alias("rows")).filter("a <> b")
        met = materialise(met, "ngram-buckets")
        release(spark)
        buckets = buckets.union(met) if buckets else met
    plain = buckets.filter("rows = 2").select("a", "b")
    more = buckets.filter("rows > 2").select("key", F.col("a").alias("pivot"))
    members = maybe_in(rows, "key", more.select("key")).join(more, "key").select("key", "node", "pivot").distinct()
    return plain, materialise(members, "ngram-members")


def _all_links(docs: DataFrame, classes: DataFrame, plain: DataFrame, members: DataFrame, width: int, percent: int) -> DataFrame:
    """Enough links (a, b) between nodes that the ends of every link are connected."""
    spark = docs.sparkSession
    tested = materialise(plain.union(members.filter("node <> pivot").select("pivot", "node")).distinct(), "ngram-pairs")
    release(spark)
    ends = tested.select("a").union(tested.select("b")).union(members.select("node")).distinct()
    sets = materialise(_sets_of(docs, classes.join(ends.toDF("node"), "node", "left_semi").select("rep", "node", "n"), width), "ngram-tokens")
    release(spark)
    links = materialise(verified(tested, sets, percent), "ngram-links")
    release(spark)
    open_ = _open_buckets(members, links)
    release(spark)
    if not open_.isEmpty():
        links = links.union(materialise(_open_groups(open_, sets, percent), "ngram-links"))
        release(spark)
    discard(sets)
    return links


def _sets_of(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """node, tokens (sorted 64-bit shingle hashes) of wanted (rep, node), from the documents named rep."""

    def run(batches):
        seen = set()  # rows that repeat a doc_id stand in one task, one after the other
        for batch in batches:
            nodes, tokens = [], []
            for node, n, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = shingle_set(text, width)
                if node not in seen and len(data) == n:
                    nodes.append(node), tokens.append(data.tobytes())
                    seen.add(node)
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(tokens, pa.binary())], names=["node", "tokens"])

    rows = maybe_in(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "doc_id", wanted.select("rep"))
    return rows.join(wanted.withColumnRenamed("rep", "doc_id"), "doc_id").select("node", "n", "text").mapInArrow(run, "node long, tokens binary")


def _open_buckets(members: DataFrame, links: DataFrame) -> DataFrame:
    """key, node, component of the buckets whose members aren't connected by links so far."""
    grouped = members.select("key", "node").join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
    several = grouped.groupBy("key").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x <> y").select("key")
    return materialise(grouped.join(several, "key").select("key", "node", "component"), "ngram-open")


def _open_groups(open_: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between nodes of open buckets in different components, one for each two components at least.

    Nodes that buckets connect are similar. By a hash of their names they are dealt to groups of about GROUP_TOKENS
    shingles, and groups that buckets connect meet in pairs, each pair in a task of its own.
    """
    pivot = open_.groupBy("key").agg(F.min("node").alias("pivot"))
    crowd = components(open_.join(pivot, "key").select(F.col("node").alias("a"), F.col("pivot").alias("b"))).withColumnRenamed("component", "crowd")
    sized = sets.select("node", (F.octet_length("tokens") / 8).cast("long").alias("n"))
    nodes = open_.select("node", "component").distinct().join(crowd, "node").join(sized, "node")
    nodes = materialise(nodes.select("node", "component", "crowd", "n"), "ngram-groups")
    last = nodes.groupBy("crowd").agg((F.ceil(F.sum("n") / GROUP_TOKENS) - 1).cast("int").alias("last"))
    met = nodes.drop("n").join(last, "crowd").withColumn("grp", F.pmod(F.xxhash64("node"), F.col("last") + 1).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), "last")))
    met = met.select("crowd", F.least("grp", "other").alias("lo"), F.greatest("grp", "other").alias("hi"), "grp", "node", "component")
    rows = met.join(sets, "node")
    return rows.groupBy("crowd", "lo", "hi").applyInPandas(lambda frame: open_pair(frame, percent), "a long, b long")


def open_pair(frame: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between two groups (lo, hi) of nodes, or within one. The token-group matrix, here the columns of these groups,
    bounds what a node can share with any member of the other one; only nodes whose bound suffices are compared with its
    members."""
    frame = frame.sort_values("node")
    tokens = [np.frombuffer(x, dtype=np.uint64) for x in frame["tokens"]]
    size = np.array([len(x) for x in tokens])
    _, place = np.unique(np.concatenate(tokens), return_inverse=True)
    starts = np.cumsum(size) - size
    grp, component, node = frame["grp"].to_numpy(), frame["component"].to_numpy(), frame["node"].to_numpy()
    ours, theirs = np.flatnonzero(grp == frame["lo"].iloc[0]), np.flatnonzero(grp == frame["hi"].iloc[0])
    out: dict[tuple, tuple] = {}
    if len(ours) and len(theirs):
        rows = np.concatenate([place[starts[j] : starts[j] + size[j]] for j in theirs])
        firsts = np.cumsum(size[theirs]) - size[theirs]
        union = np.zeros(int(place.max()) + 1, dtype=bool)
        union[rows] = True
        mine = np.zeros(len(union), dtype=np.int32)
        for i in ours:
            own = place[starts[i] : starts[i] + size[i]]
            if 100 * int(union[own].sum()) < percent * size[i] or (component[theirs] == component[i]).all():
                continue
            mine[own] = 1
            shared = np.add.reduceat(mine[rows], firsts)
            mine[own] = 0
            linked = (100 * shared >= percent * (size[i] + size[theirs] - shared)) & (component[theirs] != component[i])
            for j in theirs[linked]:
                out.setdefault((component[i], component[j]), (node[i], node[j]))
    return pd.DataFrame(list(out.values()), columns=["a", "b"], dtype="int64")


def op8_token_group_join(spark, sf_dir: str) -> DataFrame:
    return link_components(table(spark, sf_dir, "documents"))


def keep_representatives(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of word shingles (STAGE_WIDTH, STAGE_PERCENT) the document with the smallest doc_id,
    with the columns of docs, whatever they are called. Documents without words or without doc_id stay; of rows that repeat
    a doc_id that with the smallest text stays; an empty table stays empty."""
    found = link_components(docs, STAGE_WIDTH, STAGE_PERCENT)
    key, whose, stays, place = (free_name(docs, x) for x in ("key", "whose", "stays", "place"))
    each = found.filter("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("component_id") == F.col("doc_id")).alias(stays), F.count("*").alias("rows"))
    doubtful = each.filter(~F.col(stays) | (F.col("rows") > 1)).select(F.col("doc_id").alias(whose), stays)
    with small_broadcasts(spark):
        doubtful = materialise(doubtful, "ngram-doubtful")
    # only texts of doubtful ids are shuffled, once: the key follows from doc_id, so the window finds them dealt
    named = docs.filter("doc_id is not null").withColumn(key, F.col("doc_id").cast("long"))
    kept = maybe_in(named, key, doubtful.select(whose)).join(doubtful.hint("merge"), F.col(key) == F.col(whose), "left").filter(F.coalesce(F.col(stays), F.lit(True)))
    kept = kept.withColumn(place, F.row_number().over(Window.partitionBy(key, "doc_id").orderBy("text"))).filter(F.col(place) == 1).select(docs.columns)
    sure = maybe_in(named, key, doubtful.select(whose), wanted=False).select(docs.columns)
    return sure.unionByName(kept).unionByName(docs.filter("doc_id is null"))
