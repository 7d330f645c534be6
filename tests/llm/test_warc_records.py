"""Records as crawlers write them, and how long damage takes."""

import base64
import gzip
import hashlib
import time

import pytest

from portlight.llm import warc

BODY = b"<html>\r\n\r\nbody</html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\nServer: x\r\n\r\n" + BODY


def record(kind: str, block: bytes, *lines: str, version: str = "WARC/1.0") -> bytes:
    head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:7d1f2c3a-0000-4000-8000-00000090bb01>", "WARC-Date: 2024-01-01T00:00:00Z", "WARC-Target-URI: http://x.org/", *lines, f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def response(*lines, block=HTTP):
    return record("response", block, "Content-Type: application/http; msgtype=response", *lines)


def one(data: bytes) -> dict:
    (row,) = warc.salvage(data)
    return row


CODINGS = {
    "base32": lambda raw: base64.b32encode(raw).decode(), "lower": lambda raw: base64.b32encode(raw).decode().lower(), "hex": lambda raw: raw.hex(), "HEX": lambda raw: raw.hex().upper(),
    "base64": lambda raw: base64.b64encode(raw).decode(), "url": lambda raw: base64.urlsafe_b64encode(raw).decode(),
}


@pytest.mark.parametrize("coding", CODINGS)
@pytest.mark.parametrize("name", ["sha1", "sha256", "md5", "SHA-512"])
def test_payload_and_block_digests_of_http_responses(name, coding):
    algorithm = name.replace("-", "").lower()
    value = lambda data: f"{name}:{CODINGS[coding](hashlib.new(algorithm, data).digest())}"
    good = one(response(f"WARC-Payload-Digest: {value(BODY)}", f"WARC-Block-Digest: {value(HTTP)}"))
    assert (good["kind"], good["payload"], good["payload_bytes"], good["payload_digest"]) == ("record", BODY, len(BODY), warc.sha1_base32(BODY))
    assert good["http_head"].startswith("HTTP/1.1 200") and good["page_id"] is None and good["record_id"].startswith("<urn:uuid:7d1f")
    assert one(response(f"WARC-Payload-Digest: {value(BODY + b'x')}"))["reason"] == "digest differs"
    assert one(response(f"WARC-Block-Digest: {value(BODY)}"))["reason"] == "block digest differs"


def test_unknown_digests_are_not_checked():
    assert one(response("WARC-Payload-Digest: blake9:abc", "WARC-Block-Digest: none"))["kind"] == "record"


def test_digests_of_chunked_bodies():
    chunked = b"5\r\nhello\r\n6;x=y\r\n world\r\n0\r\n\r\n"
    block = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked
    for data in (b"hello world", chunked):
        assert one(response(f"WARC-Payload-Digest: sha1:{warc.sha1_base32(data)}", block=block))["payload"] == chunked
    assert one(response(f"WARC-Payload-Digest: sha1:{warc.sha1_base32(b'else')}", block=block))["kind"] == "gap"
    assert warc._unchunked(b"zz\r\n") is None and warc._unchunked(b"5\r\nhel") is None


def test_folded_headers_and_other_records():
    row = one(record("metadata", b"a: b", "WARC-Concurrent-To: <urn:uuid:1>,", "   <urn:uuid:2>", "\t<urn:uuid:3>", "Content-Type: application/warc-fields"))
    assert row["kind"] == "record" and row["warc_type"] == "metadata" and row["payload"] == b"a: b" and row["http_head"] is None
    assert one(record("metadata", b"x", "no colon here"))["reason"] == "malformed header line"
    revisit = one(record("revisit", b"HTTP/1.1 200 OK\r\n\r\n", "Content-Type: application/http", f"WARC-Payload-Digest: sha1:{warc.sha1_base32(BODY)}", "WARC-Refers-To: <urn:uuid:77>"))
    assert (revisit["payload_digest"], revisit["refers_to"], revisit["refers_to_id"], revisit["payload"], revisit["payload_bytes"]) == (warc.sha1_base32(BODY), None, "<urn:uuid:77>", b"", None)
    assert one(record("response", b"", "Content-Type: application/http"))["payload"] == b""


def test_members_and_plain_records_mix():
    parts = [response(), record("warcinfo", b"software: x WARC/1.1\r\nmore: y", "Content-Type: application/warc-fields"), response()]
    for data in (b"".join(map(gzip.compress, parts)), b"".join(parts), gzip.compress(b"".join(parts)), parts[0] + gzip.compress(parts[1]) + parts[2]):
        assert [r["warc_type"] for r in warc.salvage(data)] == ["response", "warcinfo", "response"]
    bad = gzip.compress(parts[0] + b"WARC/1.0\r\nbroken\r\n\r\n" + parts[2])
    assert [r["kind"] for r in warc.salvage(bad)] == ["record", "gap", "record"]


def test_members_beyond_the_bound_are_gaps(monkeypatch):
    monkeypatch.setattr(warc, "MEMBER_BYTES", 10_000)
    big, small = gzip.compress(record("resource", b"x" * 20_000)), gzip.compress(record("resource", b"y"))
    rows = list(warc.salvage(small + big + small))
    assert [r["kind"] for r in rows] == ["record", "gap", "record"] and rows[1]["reason"] == "member of too many bytes" and rows[1]["length"] == len(big)


@pytest.mark.parametrize("junk", [b"\x1f\x8b\x08", b"WARC/1.1\r\n", b"WARC/1.1\r\nContent-Length: 5\r\n\r\n", b"WARC/1.1\r\nA: b\r\n", b"\x1f\x8b\x08WARC/1.0\r\n", b"\r\n\r\n", b"\x1f\x8b\x08\x00\x00\x00\x00\x00\x00\x03"])
def test_damage_is_read_once(junk):
    data = junk * 80_000
    began = time.time()
    rows = list(warc.salvage(data + response()))
    assert time.time() - began < 5
    assert [r["kind"] for r in rows] == ["gap", "record"] and rows[0]["length"] == len(data)
