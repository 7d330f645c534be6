"""WARC archives: a writer of gzip members with revisit records, and a reader that salvages damaged archives.

The reader checks every member and record. After a failed check it looks for the next valid gzip member or
version line, goes on from there, and reports the bytes in between as a quarantined gap.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh_dir, materialise

#: Compressed bytes after which a writer starts another archive. One archive is read by one task, whole.
ARCHIVE_BYTES = 32 << 20

#: Rows that are broadcast at most (100 bytes each): first pages of the payloads with the most pages, names of archives. What
#: goes beyond is joined by shuffles.
MANY = 50_000

#: A gzip member that unpacks to more than this is set apart as a gap: a record's payload has to fit a row.
MEMBER_BYTES = 1 << 30

#: A record's header is no longer than this; so a place where none ends costs no more than that.
HEADER_BYTES = 64 << 10

_END = b"\r\n\r\n"
_MAGIC = b"\x1f\x8b\x08"
_VERSION = re.compile(rb"WARC/\d\.\d\r\n")
_OWN_URN = re.compile(r"<?urn:page:(-?\d+)>?")
_DATE = "2024-01-01T00:00:00Z"
#: Digest algorithms by the label in front of a digest. A digest by another one isn't checked.
_ALGORITHMS = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha384": "sha384", "sha-384": "sha384", "sha512": "sha512", "sha-512": "sha512", "md5": "md5"}

SALVAGE_SCHEMA = (
    "archive string, kind string, start long, length long, reason string, warc_type string, page_id long, "
    "target_uri string, payload_bytes long, payload_digest string, refers_to long, record_id string, refers_to_id string, http_head string, payload binary"
)


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None = None) -> bytes:
    """One WARC record. With refers_to it is a revisit: the full payload's length and digest, but no block."""
    urn = lambda x: f"<urn:page:{'' if x is None else x}>"
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: {urn(page_id)}",
        f"WARC-Date: {_DATE}",
        f"WARC-Payload-Digest: sha1:{sha1_base32(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        head += [f"WARC-Refers-To: {urn(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return "\r\n".join(head).encode() + _END + payload + _END


def gzip_member(data: bytes, level: int = 5) -> bytes:
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def digest_holds(digest: str, *datas: bytes) -> bool:
    """Whether a digest `algorithm:value`, its value in base 32, hexadecimal or base 64, is that of one of the datas; so is one by an
    algorithm that isn't known."""
    label, colon, value = digest.partition(":")
    name = _ALGORITHMS.get(label.strip().lower())
    if not colon or name is None:
        return True
    value = value.strip()
    for data in datas:
        raw = hashlib.new(name, data).digest()
        if value.rstrip("=").upper() == base64.b32encode(raw).decode().rstrip("=") or value.lower() == raw.hex() or value.rstrip("=") in (base64.b64encode(raw).decode().rstrip("="), base64.urlsafe_b64encode(raw).decode().rstrip("=")):
            return True
    return False


def _unchunked(body: bytes) -> bytes | None:
    """An HTTP body without its chunks' lengths; None if it isn't in chunks."""
    out, at = [], 0
    while True:
        stop = body.find(b"\r\n", at, at + 1024)
        try:
            size = int(body[at:stop].split(b";")[0], 16) if stop >= 0 else -1
        except ValueError:
            size = -1
        if size < 0 or len(body) < stop + 2 + size:
            return None
        if not size:
            return b"".join(out)
        out.append(body[stop + 2 : stop + 2 + size])
        at = stop + 2 + size + 2


def _header(data: bytes, at: int, stop: int) -> dict[bytes, str] | None:
    """Fields by lower-case name, of the lines between two places; a line that begins with white space goes on with the field before
    it. None as soon as one is malformed, as another record's version line is."""
    head, last = {}, None
    while at < stop:
        end = data.find(b"\r\n", at, stop)
        end = stop if end < 0 else end
        line, at = data[at:end], end + 2
        if line[:1] in (b" ", b"\t") and last is not None:
            head[last] += " " + line.strip().decode("utf-8", "replace")
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return None
        last = name.strip().lower()
        head[last] = value.strip().decode("utf-8", "replace")
    return head


class _Next:
    """The next place of a pattern in data, remembered: asked with places that only rise, it reads the data once."""

    def __init__(self, data, find):
        self.data, self.find, self.at, self.asked = data, find, -1, -1

    def __call__(self, at: int) -> int:
        if self.asked < 0 or 0 <= self.at < at or at < self.asked:
            self.at, self.asked = self.find(self.data, at), at
        return self.at


def _next_version(data) -> _Next:
    return _Next(data, lambda d, at: m.start() if (m := _VERSION.search(d, at)) else -1)


def _next_end(data) -> _Next:
    return _Next(data, lambda d, at: d.find(_END, at))


def _next_magic(data) -> _Next:
    return _Next(data, lambda d, at: d.find(_MAGIC, at))


def _parse(data, at: int, next_end: _Next) -> tuple[dict, int] | str:
    """The record that begins at `at` and where it ends, or why there is none.

    The payload of an HTTP message is its body; digests of payload and block are checked by the algorithm that they name.
    """
    if not _VERSION.match(data, at):
        return "no version line"
    stop = next_end(at)
    if stop < 0 or stop - at > HEADER_BYTES:
        return "header without end"
    head = _header(data, at + len(b"WARC/1.1\r\n"), stop)
    if head is None:
        return "malformed header line"
    try:
        size = int(head[b"content-length"])
    except (KeyError, ValueError):
        return "no content length"
    body = stop + len(_END)
    if size < 0 or data[body + size : body + size + 4] != _END:
        return "block of another length"
    block = data[body : body + size]
    kind, said = head.get(b"warc-type", ""), head.get(b"warc-payload-digest", "")
    if not digest_holds(head.get(b"warc-block-digest", ""), block):
        return "block digest differs"
    payload, http = block, None
    if head.get(b"content-type", "").lower().startswith("application/http"):
        first, parted, rest = block.partition(_END)
        http, payload = first.decode("utf-8", "replace"), rest if parted else b""
    if kind != "revisit" and said:
        whole = _unchunked(payload) if http is not None and re.search(r"(?im)^transfer-encoding:.*chunked", http) else None
        if not digest_holds(said, payload, *([whole] if whole is not None else [])):
            return "digest differs"
    own = lambda x: int(m[1]) if (m := _OWN_URN.fullmatch(x or "")) else None
    full = head.get(b"x-payload-length", "")
    row = {
        "warc_type": kind, "page_id": own(head.get(b"warc-record-id")), "target_uri": head.get(b"warc-target-uri"),
        "payload_bytes": (int(full) if full.isdigit() else None) if kind == "revisit" else len(payload), "payload_digest": said.partition(":")[2] if kind == "revisit" else sha1_base32(payload),
        "refers_to": own(head.get(b"warc-refers-to")), "record_id": head.get(b"warc-record-id"), "refers_to_id": head.get(b"warc-refers-to"), "http_head": http, "payload": payload,
    }
    return row, body + size + len(_END)


def _header_holds(data: bytes, at: int, longest: int = 4096) -> bool:
    """Whether a gzip header at `at` comes to its end: no reserved flags, and name and comment of at most so many bytes."""
    flags = data[at + 3] if at + 10 <= len(data) else 0xFF
    place = at + 10
    if flags & 0xE0:
        return False
    if flags & 4:
        place += 2 + int.from_bytes(data[place : place + 2], "little")
    for bit in (8, 16):
        if flags & bit:
            place = data.find(b"\0", place, place + longest) + 1
            if not place:
                return False
    return place < len(data)


def _member(data: bytes, at: int) -> tuple[bytes, int] | str:
    """The bytes of the gzip member at `at` and where it ends, or why its check fails."""
    if not _header_holds(data, at):
        return "gzip check failed"
    unpacker = zlib.decompressobj(31)
    out, size, view, step = [], 0, memoryview(data), 1 << 16
    try:
        while not unpacker.eof:
            if at >= len(data):
                return "gzip check failed"
            out.append(unpacker.decompress(view[at : at + step], MEMBER_BYTES - size + 1))
            size += len(out[-1])
            if size > MEMBER_BYTES:
                return "member of too many bytes"
            at += step
    except zlib.error:
        return "gzip check failed"
    return b"".join(out), min(at, len(data)) - len(unpacker.unused_data)


def _records(inner: bytes, start: int, length: int) -> tuple[list[dict], str]:
    """Records and gaps of a whole member, and why the last bad record failed; records behind a bad one count from the next
    version line on."""
    found, failed, place = [], "member without records", 0
    next_version, next_end = _next_version(inner), _next_end(inner)
    while place < len(inner):
        got = _parse(inner, place, next_end)
        if isinstance(got, str):
            failed = got
            found.append({"kind": "gap", "start": start, "length": length, "reason": got})
            place = next_version(place + 1)
            if place < 0:
                break
        else:
            found.append(got[0] | {"kind": "record", "start": start, "length": length})
            place = got[1]
    return found if any(x["kind"] == "record" for x in found) else [], failed


def salvage(data: bytes) -> Iterator[dict]:
    """Records and gaps of one archive, in order. start and length count bytes of the archive as stored. After a failed check the
    search goes on at the next member or version line; both are remembered, so damage of any length is read once."""
    at, bad, why = 0, None, ""
    next_version, next_end, next_magic = _next_version(data), _next_end(data), _next_magic(data)
    while at < len(data):
        found, failed = [], "neither a member nor a version line"
        if data.startswith(_MAGIC, at):
            member = _member(data, at)
            if isinstance(member, str):
                failed = member
            else:
                inner, end = member
                found, failed = _records(inner, at, end - at)
        else:
            got = _parse(data, at, next_end)
            if isinstance(got, str):
                failed = got
            else:
                found, end = [got[0] | {"kind": "record", "start": at, "length": got[1] - at}], got[1]
        if found:
            if bad is not None:
                yield {"kind": "gap", "start": bad, "length": at - bad, "reason": why}
                bad = None
            yield from found
            at = end
            continue
        if bad is None:
            bad, why = at, failed
        steps = [x for x in (next_version(at + 1), next_magic(at + 1)) if x >= 0]
        at = min(steps, default=len(data))
    if bad is not None:
        yield {"kind": "gap", "start": bad, "length": len(data) - bad, "reason": why}


def mark_revisits(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, refers_to. Of equal payloads the smallest page_id keeps its payload and the others refer to it."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.length("payload"))
    first = rows.groupBy("sha", "size").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    first = materialise(first.filter("n > 1"), "warc-first")
    if first.count() <= MANY:
        rows = rows.join(F.broadcast(first.drop("n")), ["sha", "size"], "left")
    else:
        many = F.broadcast(first.orderBy(F.desc("n"), "sha").limit(MANY).drop("n"))  # payloads that could fill a task are here
        rest = rows.join(many.select("sha", "size"), ["sha", "size"], "left_anti").join(first.drop("n"), ["sha", "size"], "left")
        rows = rows.join(many, ["sha", "size"]).unionByName(rest)
    other = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.select("page_id", "url", "payload", F.when(other, F.col("first_id")).alias("refers_to"))


def write_archives(rows: DataFrame, target: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes page_id, url, payload, refers_to as gzip members below target (a folder that executors share).

    Returns the manifest (archive, records, bytes), already written. A repeated task writes under another name, and only
    archives in the manifest count.
    """

    def write(batches):
        from pyarrow import fs as pafs

        store, root = pafs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        task, part = TaskContext.get(), 0
        held, size, made = [], 0, []

        def flush():
            nonlocal held, size, part
            name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{part:04d}.warc.gz"
            with store.open_output_stream(f"{root}/{name}", compression=None) as out:
                for x in held:
                    out.write(x)
            made.append((f"{target}/{name}", len(held), size))
            held, size, part = [], 0, part + 1

        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                held.append(gzip_member(record_bytes(page_id, url, payload, refers_to)))
                size += len(held[-1])
                if size >= archive_bytes:
                    flush()
        if held:
            flush()
        if made:
            yield pa.RecordBatch.from_pylist([dict(zip(("archive", "records", "bytes"), x, strict=True)) for x in made])

    rows = rows.select("page_id", "url", "payload", "refers_to")
    return materialise(rows.mapInArrow(write, "archive string, records long, bytes long"), "warc-manifest")


def read_archives(spark, archives: str | list[str], with_payload: bool = True, only: DataFrame | None = None) -> DataFrame:
    """Records and gaps (kind) of WARC archives, plain or of gzip members, damaged or not. Every byte is in a record or a gap.

    archives is a folder, or a list of a few paths. `only` (archive) tells which of the folder's files count; it is a table, and
    no list of files goes through the driver's Python.
    """

    if not archives:
        return spark.createDataFrame([], SALVAGE_SCHEMA)
    arrow = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(name, arrow[kind]) for name, kind in (x.split() for x in SALVAGE_SCHEMA.split(", "))])

    def read(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows, held = batch.column(0)[i].as_py(), [], 0
                for row in salvage(batch.column(1)[i].as_py()):
                    held += len(row.get("payload") or b"")
                    if not with_payload:
                        row.pop("payload", None)
                    rows.append({"archive": path} | row)
                    if len(rows) >= 1000 or held > 8 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    files = spark.read.format("binaryFile").load(archives).select("path", "content")
    if only is not None:  # by name: ways to write a path differ
        name = lambda c: F.substring_index(c, "/", -1).alias("name")
        named = only.select(name("archive"))
        named = F.broadcast(named) if only.count() <= MANY else named
        files = files.select("path", "content", name("path")).join(named, "name", "left_semi").select("path", "content")
    return files.mapInArrow(read, SALVAGE_SCHEMA)


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes pages (page_id, url, html) as WARC archives, reads them back and returns one row for each record.

    A null html is an empty payload; a null url gives a record without target; null page_ids stay null and never are the
    record that others refer to, unless a group has none else (then all are responses). Repeated rows with one page_id and
    one payload are both responses. An empty table gives no archive and no rows. Other columns are ignored.
    """
    spark = pages.sparkSession
    target = fresh_dir(spark, "warc")
    manifest = write_archives(mark_revisits(pages), target)
    if manifest.isEmpty():
        return spark.createDataFrame([], SALVAGE_SCHEMA)
    return read_archives(spark, target, with_payload=False, only=manifest)


def op1_warc_salvage(spark, sf_dir: str) -> DataFrame:
    from .common import table

    read = archive_pages(table(spark, sf_dir, "pages"))
    return read.select("page_id", "payload_bytes", "payload_digest", F.col("warc_type").alias("record_type"), "refers_to", "kind").filter("kind = 'record'").drop("kind")


#: Base 32 of the SHA-1 by hand: each five hex digits hold four letters.
OP1_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as b, sha1(coalesce(html, '')) as h from pages),
g as (select *, min(page_id) over (partition by h) as first_id from p)
select page_id, octet_length(b) as payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    cast(((list_sum(list_transform(range(0, 5), lambda k: (strpos('0123456789abcdef', substr(h, cast(5 * (j // 4) + k + 1 as integer), 1)) - 1) * (1 << (4 * (4 - k)))))::BIGINT
      >> (15 - 5 * (j % 4))) & 31) + 1 as integer), 1)), '') as payload_digest,
  case when page_id = first_id then 'response' else 'revisit' end as record_type,
  case when page_id <> first_id then first_id end as refers_to
from g
"""
