"""Exact removal of repeated byte strings over all documents, by suffix arrays of shards.

Strings of two lengths are looked for at once: LENGTH bytes, and PASSAGE bytes for passages of some fifty words. Windows of
the shorter length are dealt to shards by content: a window goes by its smallest hashed run of RUN bytes, so equal windows
meet and nothing else need. A document thereby falls into pieces of consecutive windows with one such anchor; a piece also
holds what follows, as far as the longer strings reach. Pieces whose anchor occurs once in all documents hold no repeat.
Equal pieces count once, with their number, and an anchor that has only equal pieces needs no sorting. Of the others each
window goes by its anchor and the bytes at that side of it where the window holds more; what meets there is sorted into
suffix arrays by induction, and windows whose common prefix with a neighbour is long enough are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import byte_values, discard, free_name, limit_batches, materialise, maybe_in, mix64, table
from .suffixes import repeated_runs

LENGTH = 400
#: Bytes of a repeated passage: fifty words of five bytes, blanks included.
PASSAGE = 250
RUN = 32
#: Bytes of text sorted into one suffix array.
SHARD_BYTES = 1 << 20
#: Where more different pieces than this meet, their windows are counted by 128-bit digests, which spread over all tasks.
HOT_PIECES = 2000
#: Windows that are counted together there, as long as their whole text repeats.
BLOCK = 16
#: Frames of so many keys are broadcast; larger ones are joined by shuffles.
BROADCAST_KEYS = 1_000_000
#: Windows of one document that are cut together: the position takes 24 bits.
_CHUNK = 8 << 20

_VALUES = byte_values(99)
_BASE = np.uint64(0xD1342543DE82EF95)

PIECES = "doc_id long, doc_key long, anchor long, d long, width int, size int, place int, starts array<int>"


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def digest(data: bytes, seed: int = 0) -> tuple[int, int]:
    """Two signed 64-bit halves of a 128-bit hash."""
    x = xxhash.xxh3_128_intdigest(data, seed)
    return _signed(x >> 64), _signed(x & ((1 << 64) - 1))


def cut_pieces(data: bytes, length: int = PASSAGE, run: int = RUN):
    """(anchor, first window, number of windows, where the anchor stands behind the first window's begin) for each run of
    windows of data with one anchor. run is a power of two."""
    for base in range(0, len(data) - length + 1, _CHUNK):  # hashes wrap around
        b = np.frombuffer(data[base : base + _CHUNK + length - 1], dtype=np.uint8)
        h, step, power = _VALUES[b], 1, np.array([_BASE])
        while step < run:
            h = h[:-step] * power + h[step:]
            power, step = power * power, 2 * step
        h = mix64(h)
        # smallest of each `span` neighbours: the hash's upper 40 bits, then the place
        span, place = length - run + 1, np.uint64((1 << 24) - 1)
        key = (h & ~place) | np.arange(len(h), dtype=np.uint64)
        rows = -(-len(key) // span)
        block = np.full(rows * span, ~np.uint64(0))
        block[: len(key)] = key
        block = block.reshape(rows, span)
        ahead = np.minimum.accumulate(block, axis=1).ravel()
        back = np.minimum.accumulate(block[:, ::-1], axis=1)[:, ::-1].ravel()
        n = len(key) - span + 1
        at = (np.minimum(back[:n], ahead[span - 1 : span - 1 + n]) & place).astype(np.int64)
        firsts = np.r_[0, np.flatnonzero(np.diff(at)) + 1]
        widths = np.diff(np.r_[firsts, n])
        yield from zip(h[at[firsts]].view(np.int64).tolist(), (firsts + base).tolist(), widths.tolist(), (at[firsts] - firsts).tolist(), strict=True)


def find_pieces(keyed: DataFrame, short: int, long: int, run: int) -> DataFrame:
    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for doc_id, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = (text or "").encode()
                if len(data) < short:
                    continue
                found: dict[tuple, list[int]] = {}
                for anchor, first, width, place in cut_pieces(data, short, run):
                    piece = data[first : first + width + long - 1]
                    found.setdefault((anchor, _signed(xxhash.xxh3_64_intdigest(piece)), width, len(piece), place), []).append(first)
                for kind, starts in found.items():
                    for column, x in zip(rows, (doc_id, key, *kind, starts), strict=True):
                        column.append(x)
                if len(rows[0]) > 50_000:
                    yield _batch(rows, PIECES)
                    rows = [[] for _ in range(8)]
            yield _batch(rows, PIECES)

    return keyed.select("doc_id", "doc_key", "text").mapInArrow(cut, PIECES)


_ARROW = {"long": pa.int64(), "int": pa.int32(), "array<int>": pa.list_(pa.int32()), "string": pa.string(), "binary": pa.binary(), "boolean": pa.bool_()}


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], names=[name for name, _ in fields])


def split_piece(piece: bytes, width: int, place: int, short: int, long: int, run: int):
    """(key, first window, number of windows, place, text) for the windows of a piece that hold at least half of their other
    bytes left of the anchor at `place`, and for those that hold more right of it. The key hashes the anchor and that half."""
    half = (short - run) // 2
    left = max(0, min(width, place - half + 1))
    if left:
        yield _signed(xxhash.xxh3_64_intdigest(piece[place - half : place + run], 1)), 0, left, place, piece[: left + long - 1]
    if left < width:
        yield _signed(xxhash.xxh3_64_intdigest(piece[place : place + run + half], 2)), left, width - left, place - left, piece[left:]


SPANS = "anchor long, d long, short_spans array<int>, long_spans array<int>"
PARTS = "key long, anchor long, d long, n long, first int, width int, place int, part binary"


def sort_shards(parts: DataFrame, short: int, long: int) -> DataFrame:
    """SPANS of the parts of pieces that hold repeats; those of a key lie together."""

    def sort(batches):
        held: list[tuple] = []  # of keys with several parts
        size, out = 0, [[] for _ in range(4)]  # of keys with one

        def settle(group):
            nonlocal size
            if len(group) > 1:
                held.extend(group)
                size += sum(len(x[7]) for x in group)
            elif group and group[0][3] > 1:  # only copies of itself
                _, anchor, d, _, first, width, _, part = group[0]
                fit = min(width, len(part) - long + 1)
                for column, x in zip(out, (anchor, d, [first, first + width - 1 + short], [first, first + fit - 1 + long] if fit > 0 else []), strict=True):
                    column.append(x)

        def shard():
            firsts = np.array([x[4] for x in held], dtype=np.int64)
            runs = repeated_runs([x[7] for x in held], [x[5] for x in held], [x[3] for x in held], short, long)
            some = np.flatnonzero(runs[0][0])  # a long repeat is a short one too
            columns = [pa.array([held[i][k] for i in some], pa.int64()) for k in (1, 2)]
            for counts, values in runs:
                values = (values + np.repeat(firsts, counts)).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts[some])].astype(np.int32)), pa.array(values)))
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SPANS.split(", ")])

        def flush():
            nonlocal held, size, out
            if held:
                yield shard()
            if out[0]:
                yield _batch(out, SPANS)
            held, size, out = [], 0, [[] for _ in range(4)]

        group: list[tuple] = []
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                if group and row[0] != group[0][0]:
                    settle(group)
                    group = []
                    if size >= SHARD_BYTES or len(out[0]) > 50_000:
                        yield from flush()
                group.append(row)
        settle(group)
        yield from flush()

    columns = [x.split()[0] for x in PARTS.split(", ")]
    return parts.repartition("key").sortWithinPartitions("key").select(columns).mapInArrow(sort, SPANS)


def count_windows(parts: DataFrame, short: int, long: int) -> DataFrame:
    """As sort_shards, for keys where very many parts meet: windows are counted by digest, wherever they are.

    Runs of BLOCK windows at fixed distances from the anchor go first: where a run's whole text repeats, all its windows do.
    Only runs that occur once are looked at window by window, and windows are counted over different runs, not over all.
    """
    blocks = "anchor long, d long, n long, length int, at int, width int, b1 long, b2 long, block binary"
    singles = "anchor long, d long, n long, length int, at int, once boolean, w1 long, w2 long"

    def cut(batches):
        for batch in batches:
            rows: list[tuple] = []
            for anchor, d, n, first, width, place, part in zip(*(batch.column(i).to_pylist() for i in range(7)), strict=True):
                for length in sorted({short, long}):
                    a, fit = 0, min(width, len(part) - length + 1)
                    while a < fit:
                        b = min(fit, a + (place - a) % BLOCK + 1)
                        text = part[a : b - 1 + length]
                        rows.append((anchor, d, n, length, first + a, b - a, *digest(text, length), text))
                        a = b
            yield _batch([list(x) for x in zip(*rows, strict=True)] or [[] for _ in range(9)], blocks)

    def windows(batches):
        for batch in batches:
            rows: list[tuple] = []
            for anchor, d, n, length, at, width, once, text in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
                rows += [(anchor, d, n, length, at + i, once, *digest(text[i : i + length], length)) for i in range(width)]
            yield _batch([list(x) for x in zip(*rows, strict=True)] or [[] for _ in range(8)], singles)

    runs = materialise(parts.select("anchor", "d", "n", "first", "width", "place", "part").mapInArrow(cut, blocks), "suffix-runs")
    one = F.min(F.struct("anchor", "d", "at", "length", "width", "block")).alias("x")
    kinds = materialise(runs.groupBy("b1", "b2").agg(F.sum("n").alias("n"), one).select("b1", "b2", "n", "x.*"), "suffix-run-kinds")
    whole = runs.drop("block", "n").join(kinds.filter("n > 1").select("b1", "b2"), ["b1", "b2"]).select("anchor", "d", "length", "at", "width")
    single = kinds.select("anchor", "d", "n", "length", "at", "width", (F.col("n") == 1).alias("once"), "block").mapInArrow(windows, singles)
    single = materialise(single, "suffix-windows")
    many = single.groupBy("w1", "w2", "length").agg(F.sum("n").alias("total")).filter("total > 1").select("w1", "w2", "length")
    rest = single.filter("once").join(many, ["w1", "w2", "length"], "left_semi").select("anchor", "d", "length", "at", F.lit(1).alias("width"))
    at = lambda length: F.array_sort(F.collect_list(F.when(F.col("length") == length, F.struct("at", "width"))))
    hit = whole.unionByName(rest).groupBy("anchor", "d").agg(at(short).alias("short_at"), at(long).alias("long_at"))
    spans = lambda c, length: F.flatten(F.transform(c, lambda x: F.array(x["at"], x["at"] + x["width"] - 1 + length)))
    return hit.select("anchor", "d", spans("short_at", short).alias("short_spans"), spans("long_at", long).alias("long_spans"))


def repeated_spans(docs: DataFrame, short: int = PASSAGE, long: int = LENGTH, run: int = RUN) -> DataFrame:
    """doc_id, doc_key, cover of the rows of docs (doc_id, doc_key, text) that hold repeats.

    cover has short and long, arrays of from, to, from, to ...: byte ranges, in no order and overlapping, that strings of that
    length cover which begin elsewhere too.
    """
    pieces = materialise(find_pieces(docs, short, long, run), "suffix-pieces")
    count = F.sum(F.size("starts"))
    anchors = pieces.groupBy("anchor").agg(count.alias("total"), F.min("d").alias("least"), F.max("d").alias("most"))
    anchors = materialise(anchors.filter("total > 1").select("anchor", (F.col("least") == F.col("most")).alias("alike")), "suffix-anchors")
    candidates = materialise(maybe_in(pieces, "anchor", anchors.select("anchor")).join(anchors, "anchor"), "suffix-candidates")
    discard(pieces)
    covered = F.array(F.lit(0), F.col("width") + short - 1)
    far = F.when(F.col("size") >= long, F.array(F.lit(0), F.col("size"))).otherwise(F.array().cast("array<int>"))
    alike = candidates.filter("alike").select("doc_id", "doc_key", "starts", covered.alias("short_spans"), far.alias("long_spans"))

    mixed = candidates.filter("not alike")
    kinds = mixed.groupBy("anchor", "d").agg(count.alias("n"), F.min(F.struct("doc_id", "doc_key", F.col("starts")[0].alias("start"), "width", "size", "place")).alias("at"))
    wanted = kinds.groupBy("at.doc_id", "at.doc_key").agg(F.collect_list(F.struct("anchor", "d", "n", "at.start", "at.width", "at.size", "at.place")).alias("wanted"))

    def cut(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(8)]
            for text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data = (text or "").encode()
                for w in want:
                    piece = data[w["start"] : w["start"] + w["size"]]
                    for key, first, width, place, part in split_piece(piece, w["width"], w["place"], short, long, run):
                        for column, x in zip(rows, (key, w["anchor"], w["d"], w["n"], first, width, place, part), strict=True):
                            column.append(x)
            yield _batch(rows, PARTS)

    wanted = materialise(wanted, "suffix-wanted")
    once = maybe_in(docs, "doc_key", wanted.select("doc_key")).select(F.col("doc_id").alias("id_"), F.col("doc_key").alias("key_"), "text")
    joined = once.join(wanted, F.col("id_").eqNullSafe(F.col("doc_id")) & (F.col("key_") == F.col("doc_key"))).dropDuplicates(["doc_id", "doc_key"])
    parts = materialise(joined.select("text", "wanted").mapInArrow(cut, PARTS), "suffix-parts")
    hot = materialise(parts.groupBy("key").agg(F.count("*").alias("kinds")).filter(F.col("kinds") > HOT_PIECES).select("key"), "suffix-hot")
    n_hot = hot.count()
    if n_hot:
        some = F.broadcast(hot) if n_hot <= BROADCAST_KEYS else hot
        spans = sort_shards(parts.join(some, "key", "left_anti"), short, long).unionByName(count_windows(parts.join(some, "key", "left_semi"), short, long))
    else:
        spans = sort_shards(parts, short, long)
    spans = materialise(spans, "suffix-spans")
    discard(parts)
    sorted_ = maybe_in(mixed, "d", spans.select("d")).join(spans, ["anchor", "d"]).select("doc_id", "doc_key", "starts", "short_spans", "long_spans")
    moved = lambda c: F.flatten(F.transform("starts", lambda s: F.transform(c, lambda x: x + s)))
    ranges = alike.unionByName(sorted_).select("doc_id", "doc_key", moved("short_spans").alias("short"), moved("long_spans").alias("long"))
    return ranges.groupBy("doc_id", "doc_key").agg(F.struct(F.flatten(F.collect_list("short")).alias("short"), F.flatten(F.collect_list("long")).alias("long")).alias("cover"))


def _merged(ranges: pa.ListArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The maximal byte ranges of each row of a column of covers, in order: where each row's begin (and, last, their number), from, to."""
    counts = pc.fill_null(pc.list_value_length(ranges), 0).to_numpy(zero_copy_only=False).astype(np.int64) // 2
    ends = pc.list_flatten(ranges).to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, 2)
    row = np.repeat(np.arange(len(counts)), counts) << 40  # a row's ranges lie behind all those of the row before
    order = np.argsort(row + ends[:, 0], kind="stable")
    start, stop = (row + ends[:, 0])[order], np.maximum.accumulate((row + ends[:, 1])[order])
    first = np.r_[True, start[1:] > stop[:-1]][: len(start)]
    last = np.r_[first[1:], True][: len(start)]
    start, stop = start[first], stop[last]
    low = (1 << 40) - 1
    return np.searchsorted(start >> 40, np.arange(len(counts) + 1)), start & low, stop & low


def with_cover(docs: DataFrame, short: int, long: int, run: int, out: str) -> DataFrame:
    """Adds `out`, the cover of repeated_spans or null, to docs with doc_id and text, whatever its other columns are called."""
    limit_batches(docs.sparkSession)
    # a hash of doc_id and text tells rows of one doc_id apart
    key, id_, key_ = (free_name(docs, x) for x in ("doc_key", "cover_id", "cover_key"))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    cover = repeated_spans(keyed.select("doc_id", F.col(key).alias("doc_key"), "text"), short, long, run)
    cover = materialise(cover, "suffix-cover").toDF(id_, key_, out)
    # only texts that may have a cover are shuffled
    some, none = (maybe_in(keyed, key, cover.select(key_), wanted=x) for x in (True, False))
    found = some.join(cover, (F.col(key) == F.col(key_)) & F.col("doc_id").eqNullSafe(F.col(id_)), "left").select(*docs.columns, out)
    return found.unionByName(none.select(*docs.columns, F.lit(None).cast(cover.schema[out].dataType).alias(out)))


def remove_repeats(docs: DataFrame, length: int = LENGTH, passage: int = PASSAGE, run: int = RUN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_passage_bytes, n_passages of every row of docs (doc_id, text).

    A byte goes when a string of `length` bytes that covers it begins anywhere else too, in the same document or another.
    n_passage_bytes and n_passages count the bytes, and the maximal runs of them, that strings of `passage` bytes (at most
    `length`) cover in the same sense; these stay. Null and empty texts have no bytes. Rows count as documents of their own,
    also with a repeated or null doc_id. Matches never cross documents. Other columns are ignored.
    """
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passage_bytes long, n_passages long"

    def report(batches):
        for batch in batches:
            (at, start, stop), (near, near_start, near_stop) = (_merged(batch.column(i)) for i in (2, 3))
            rows: list[list] = [[] for _ in range(3)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                data = (text or "").encode()
                kept, done = hashlib.sha256(), 0
                for k in range(at[i], at[i + 1]):
                    kept.update(data[done : start[k]])
                    done = stop[k]
                kept.update(data[done:])
                for column, x in zip(rows, (len(data), at[i + 1] - at[i], kept.hexdigest()), strict=True):
                    column.append(x)
            total = lambda at, start, stop: np.diff(np.r_[0, np.cumsum(stop - start)][at])
            columns = [rows[0], total(at, start, stop), rows[1], rows[2], total(near, near_start, near_stop), np.diff(near)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.string() if c is rows[2] else pa.int64()) for c in columns]], names=[x.split()[0] for x in schema.split(", ")])

    found = with_cover(docs.select("doc_id", "text"), passage, length, run, "cover")
    return found.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "cover.long", "cover.short").mapInArrow(report, schema)


def kept_text(text: str | None, cover: list[dict] | None) -> str | None:
    """text without what a cover says, each of its starts plus each of its long_spans."""
    spans = [[s + x for s in c["starts"] for x in c["long_spans"]] for c in cover or ()]
    if not spans:
        return text
    _, start, stop = _merged(pa.array([[x for y in spans for x in y]], pa.list_(pa.int32())))
    return without_ranges(text, list(zip(start.tolist(), stop.tolist(), strict=True)))


def without_ranges(text: str | None, gone: list[tuple[int, int]]) -> str | None:
    """text without byte ranges, which are in order and apart; a character that is only partly covered stays whole."""
    if not gone:
        return text
    data, out, at = text.encode(), [], 0
    for a, b in gone:
        while a < b and data[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(data) and data[b] & 0xC0 == 0x80:
            b -= 1
        out.append(data[at:a])
        at = b
    out.append(data[at:])
    return b"".join(out).decode()


def strip_repeats(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: docs without their repeated passages (strings of PASSAGE bytes that begin elsewhere too, all of them),
    n_chars brought up to date. Documents that had words and have none left go; null and empty texts stay; repeated rows
    are copies of each other, so their strings repeat. Columns of any name pass through."""
    columns, at = docs.columns, docs.columns.index("text")
    cover, gone = free_name(docs, "cover"), free_name(docs, "gone")
    joined = with_cover(docs, PASSAGE, PASSAGE, RUN, cover).withColumn(cover, F.col(f"`{cover}`.long"))

    def strip(batches):
        for batch in batches:
            old, (places, start, stop) = batch.column(at).to_pylist(), _merged(batch.column(len(columns)))
            covers = [list(zip(start[a:b].tolist(), stop[a:b].tolist(), strict=True)) for a, b in zip(places[:-1].tolist(), places[1:].tolist(), strict=True)]
            texts = [without_ranges(t, c) for t, c in zip(old, covers, strict=True)]
            arrays = [batch.column(i) for i in range(len(columns))]
            arrays[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*arrays, pa.array([bool(c) and not t.strip() for t, c in zip(texts, covers, strict=True)], pa.bool_())], names=[*columns, gone])

    out = joined.mapInArrow(strip, ", ".join(f"`{c}` {t}" for c, t in docs.dtypes) + f", `{gone}` boolean").filter(~F.col(gone)).select(columns)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in columns else out


def op10_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))
