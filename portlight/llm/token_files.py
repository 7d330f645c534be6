"""Token ids in binary files of patched frame-of-reference blocks.

A file holds whole documents. Its ids are cut into blocks of 128; each block stores its minimum, the distances from it packed at the
width that PERCENTILE of them need, and what is wider in an exception list: places, and the bits above that width. An index
holds where each block starts, so a span of ids is read from its blocks alone. Little-endian throughout:

    magic | blocks | block starts (8 bytes each) | doc_ids (8) | null marks of doc_ids (1) | ids of each document (8) | footer

A block is its minimum (4), width (1), number of exceptions (1), bytes of each exception (1), a byte of zero, the packed
distances (16 times width), the exceptions' places (1 each) and their upper bits. The footer has the numbers of ids, blocks and
documents and the places of the sections (8 each), the crc32 of all before it (4) and the magic again.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import fresh_dir, materialise, table
from .packing import default_tokenizer, tokenizer

MAGIC = b"PFORIDS1"
BLOCK = 128
#: Share of a block's distances that its width holds at least; the others are exceptions.
PERCENTILE = 90
#: Ids after which a writer begins another file. One file is read by one task; a longer document still lies in one file.
FILE_IDS = 4 << 20
#: Blocks that are coded at a time.
CHUNK = 4096
#: Rows of a manifest that are broadcast at most (200 bytes each); a longer one is joined by a shuffle.
MANY = 50_000

_FOOTER = struct.Struct("<6QI8s")
_HEAD = 8

MANIFEST_SCHEMA = "file string, part long, piece long, docs long, ids long, bytes long"
DOCUMENT_SCHEMA = "file string, place long, doc_id long, start_in_file long, n_tokens long, ids_crc32 long, ids binary"


# ---- one file ----


def _pack(x: np.ndarray, width: int) -> np.ndarray:
    """(rows, 128) distances to (rows, 2 * width) words of 64 bits."""
    columns = np.ascontiguousarray(x.T.astype(np.uint64))
    words = np.zeros((2 * width, len(x)), dtype=np.uint64)
    for j in range(BLOCK):
        at, bit = divmod(j * width, 64)
        words[at] |= columns[j] << np.uint64(bit)
        if bit + width > 64:
            words[at + 1] |= columns[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(words.T)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    rows = np.ascontiguousarray(words.T)
    out, mask = np.empty((BLOCK, words.shape[0]), dtype=np.uint32), np.uint64((1 << width) - 1)
    for j in range(BLOCK):
        at, bit = divmod(j * width, 64)
        x = rows[at] >> np.uint64(bit)
        if bit + width > 64:
            x = x | rows[at + 1] << np.uint64(64 - bit)
        out[j] = x & mask
    return np.ascontiguousarray(out.T)


def _bits(x: np.ndarray) -> np.ndarray:
    """How many bits each number needs (none for 0)."""
    return np.frexp(x.astype(np.float64))[1].astype(np.int64)


def _spread(out: np.ndarray, starts: np.ndarray, rows: np.ndarray) -> None:
    """Writes row i of bytes at starts[i] of out."""
    if rows.shape[1]:
        out[starts[:, None] + np.arange(rows.shape[1])] = rows


def _blocks(ids: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The blocks of ids, whose number is a multiple of 128, and the length of each."""
    x = ids.reshape(-1, BLOCK)
    low = x.min(1)
    far = x - low[:, None]
    need = _bits(far)
    width = np.partition(need, (kth := -(-BLOCK * PERCENTILE // 100) - 1), axis=1)[:, kth]
    row, place = np.nonzero(need > width[:, None])
    upper = far[row, place] >> width[row].astype(np.uint32)
    n = np.bincount(row, minlength=len(x))
    most = np.zeros(len(x), dtype=np.uint32)
    np.maximum.at(most, row, upper)
    each = np.select([n == 0, most < 1 << 8, most < 1 << 16], [0, 1, 2], 4)
    lengths = _HEAD + 16 * width + n * (1 + each)
    starts = np.cumsum(lengths) - lengths
    out = np.zeros(int(lengths.sum()), dtype=np.uint8)
    _spread(out, starts, low.astype("<u4").view(np.uint8).reshape(-1, 4))
    _spread(out, starts + 4, np.stack([width, n, each], 1).astype(np.uint8))
    for w in np.unique(width[width > 0]):
        some = np.flatnonzero(width == w)
        kept = far[some] & np.uint32((1 << int(w)) - 1)
        _spread(out, starts[some] + _HEAD, _pack(kept, int(w)).astype("<u8").view(np.uint8).reshape(len(some), -1))
    nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    lists = starts + _HEAD + 16 * width
    out[lists[row] + nth] = place
    for size in (1, 2, 4):
        some = np.flatnonzero(each[row] == size)
        r = row[some]
        _spread(out, lists[r] + n[r] + nth[some] * size, upper[some].astype(f"<u{size}").view(np.uint8).reshape(-1, size))
    return out.tobytes(), lengths


def encode_file(ids: np.ndarray, doc_ids: list[int | None], lengths: list[int]) -> bytes:
    """A file of documents: their ids one after the other, and how many each has."""
    parts, sizes = [MAGIC], []
    full = np.concatenate([ids, np.full(-len(ids) % BLOCK, ids[-1] if len(ids) else 0, dtype=np.uint32)]).astype(np.uint32)
    for at in range(0, len(full), CHUNK * BLOCK):
        data, size = _blocks(full[at : at + CHUNK * BLOCK])
        parts.append(data)
        sizes.append(size)
    sizes = np.concatenate(sizes) if sizes else np.zeros(0, dtype=np.int64)
    starts = len(MAGIC) + np.cumsum(sizes) - sizes
    index_at = len(MAGIC) + int(sizes.sum())
    docs_at = index_at + 8 * len(starts)
    nulls = np.array([x is None for x in doc_ids], dtype=np.uint8)
    parts += [starts.astype("<u8").tobytes(), np.array([x or 0 for x in doc_ids], dtype="<i8").tobytes(), nulls.tobytes(), np.array(lengths, dtype="<u8").tobytes()]
    body = b"".join(parts)
    return body + _FOOTER.pack(len(ids), len(starts), len(doc_ids), index_at, docs_at, len(body), zlib.crc32(body), MAGIC)


class TokenFile:
    """Reads a file's documents, or any span of its ids by the blocks that hold it. A damaged file raises ValueError."""

    def __init__(self, data: bytes):
        if len(data) < len(MAGIC) + _FOOTER.size or data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a file of token ids")
        self.n_ids, self.n_blocks, self.n_docs, index_at, docs_at, end, crc, magic = _FOOTER.unpack_from(data, len(data) - _FOOTER.size)
        if magic != MAGIC or end + _FOOTER.size != len(data) or zlib.crc32(memoryview(data)[:end]) != crc:
            raise ValueError("damaged file of token ids")
        self.data = np.frombuffer(data, dtype=np.uint8)
        part = lambda kind, n, at: np.frombuffer(data, dtype=kind, count=n, offset=at)
        self.starts = part("<u8", self.n_blocks, index_at).astype(np.int64)
        ids, nulls = part("<i8", self.n_docs, docs_at), part("u1", self.n_docs, docs_at + 8 * self.n_docs)
        self.doc_ids = [None if null else int(x) for x, null in zip(ids, nulls, strict=True)]
        self.lengths = part("<u8", self.n_docs, docs_at + 9 * self.n_docs).astype(np.int64)

    def ids(self, start: int, length: int) -> np.ndarray:
        """The ids start to start + length of the file, from their blocks alone."""
        if not length:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // BLOCK, -(-(start + length) // BLOCK)
        out = np.concatenate([self._decode(self.starts[at : min(last, at + CHUNK)]) for at in range(first, last, CHUNK)])
        return out[start - first * BLOCK :][:length]

    def _decode(self, starts: np.ndarray) -> np.ndarray:
        take = lambda at, size, kind: self.data[at[:, None] + np.arange(size)].view(kind)
        head = take(starts, 3 + 4, np.uint8)
        low = np.ascontiguousarray(head[:, :4]).view("<u4")[:, 0]
        width, n, each = (head[:, i].astype(np.int64) for i in (4, 5, 6))
        far = np.zeros((len(starts), BLOCK), dtype=np.uint32)
        for w in np.unique(width[width > 0]):
            some = np.flatnonzero(width == w)
            far[some] = _unpack(take(starts[some] + _HEAD, 16 * int(w), "<u8"), int(w))
        row = np.repeat(np.arange(len(starts)), n)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        lists = starts + _HEAD + 16 * width
        place = self.data[lists[row] + nth]
        for size in (1, 2, 4):
            some = np.flatnonzero(each[row] == size)
            r = row[some]
            upper = take(lists[r] + n[r] + nth[some] * size, size, f"<u{size}").reshape(-1).astype(np.uint32)
            far[r, place[some]] |= upper << width[r].astype(np.uint32)
        return (far + low[:, None]).ravel()

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, start in the file and ids of each document; a stretch of blocks is decoded at a time."""
        ends = np.cumsum(self.lengths)
        held, begin = np.zeros(0, dtype=np.uint32), 0
        for doc_id, n, end in zip(self.doc_ids, self.lengths, ends, strict=True):
            start = int(end - n)
            if end > begin + len(held):
                begin = start
                held = self.ids(start, min(self.n_ids - start, max(int(n), CHUNK * BLOCK)))
            yield doc_id, start, held[start - begin : end - begin]


# ---- many files ----


def write_token_files(docs: DataFrame, target: str, tokenizer_path: str, end_id: int = 0, file_ids: int = FILE_IDS) -> DataFrame:
    """Writes the ids of documents (doc_id, text), each followed by end_id, below target (a folder that executors share), in
    ascending order of doc_id.

    The order goes on from file to file by (part, piece) of the manifest that is returned (MANIFEST_SCHEMA, already written).
    Null doc_ids come first, and rows of one doc_id follow the hash of their text, so that many of them spread over tasks. A null
    text is empty and still has end_id. A repeated task writes under another name, and only files in the manifest count.
    """

    def write(batches):
        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        task, encoder = TaskContext.get(), tokenizer(tokenizer_path)
        end = np.array([end_id], dtype="<u4").tobytes()
        held, doc_ids, lengths, size, made = [], [], [], 0, []

        def flush():
            nonlocal held, doc_ids, lengths, size
            data = encode_file(np.frombuffer(b"".join(held), dtype="<u4"), doc_ids, lengths)
            name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{len(made):05d}.pfor"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                out.write(data)
            made.append({"file": name, "part": task.partitionId(), "piece": len(made), "docs": len(doc_ids), "ids": size, "bytes": len(data)})
            held, doc_ids, lengths, size = [], [], [], 0

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = encoder.encode([text.as_py() or ""])[0]
                held += [ids, end]
                doc_ids.append(doc_id)
                lengths.append(len(ids) // 4 + 1)
                size += lengths[-1]
                if size >= file_ids:
                    flush()
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_pylist(made)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return materialise(rows.mapInArrow(write, MANIFEST_SCHEMA), "token-manifest")


def read_token_files(spark: SparkSession, target: str, manifest: DataFrame, with_ids: bool = True) -> DataFrame:
    """The documents of the files below target that are in the manifest (DOCUMENT_SCHEMA); place counts them in each file."""
    columns = DOCUMENT_SCHEMA if with_ids else DOCUMENT_SCHEMA.rsplit(",", 1)[0]
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in (x.split() for x in columns.split(", "))])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                name, rows, held = batch.column(0)[i].as_py(), [], 0
                for place, (doc_id, start, ids) in enumerate(TokenFile(batch.column(1)[i].as_buffer().to_pybytes()).documents()):
                    raw = ids.astype("<u4").tobytes()
                    rows.append((name, place, doc_id, start, len(ids), zlib.crc32(raw), *([raw] if with_ids else ())))
                    held += with_ids and len(raw)
                    if len(rows) >= 10_000 or held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = spark.read.format("binaryFile").load(target).select(F.substring_index("path", "/", -1).alias("file"), "content")
    named = manifest.select("file")
    files = files.join(F.broadcast(named) if manifest.count() <= MANY else named, "file", "left_semi")
    return files.mapInArrow(read, columns)


def starts_of_files(manifest: DataFrame) -> DataFrame:
    """file, first: how many ids stand in all files before. Sums go over the files of a part, and over the parts."""
    before = lambda w: F.coalesce(F.sum("ids").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = manifest.groupBy("part").agg(F.sum("ids").alias("ids"))
    parts = parts.select("part", before(Window.orderBy("part")).alias("before_part"))
    own = manifest.select("file", "part", before(Window.partitionBy("part").orderBy("piece")).alias("in_part"))
    return own.join(F.broadcast(parts), "part").select("file", (F.col("before_part") + F.col("in_part")).alias("first"))


def token_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """Writes documents (doc_id, text) as token files and reads them back: doc_id, start (ids of all documents before it),
    n_tokens, ids_crc32 and, with_ids, ids.

    A null text is an empty one; null doc_ids come first; rows that share a doc_id are documents of their own, in the order of
    their text's hash; an empty table has no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    target = fresh_dir(spark, "token-files")
    manifest = write_token_files(docs, target, tokenizer_path, end_id)
    if manifest.isEmpty():
        columns = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids
        return spark.createDataFrame([], columns)
    first = starts_of_files(manifest)
    rows = read_token_files(spark, target, manifest, with_ids)
    rows = rows.join(F.broadcast(first) if manifest.count() <= MANY else first, "file")
    return rows.select("doc_id", (F.col("first") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def op12_patched_ids(spark, sf_dir: str) -> DataFrame:
    return token_documents(table(spark, sf_dir, "documents"), default_tokenizer(), with_ids=False)
