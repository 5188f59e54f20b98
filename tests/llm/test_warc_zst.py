import base64
import hashlib
import struct

import pytest
import zstandard
from pyspark.sql import functions as F

from martloom.llm import warc_zst as warc
from martloom.session import scratch_path
from tests.llm.helpers import clashing, prose

LONG = "<p>" + prose(1, 400) + "</p>"


def rows():
    out = [(k, f"http://h{k % 3}.example/{k}", f"<html>{prose(k, 60 + 5 * k)}</html>") for k in range(40)]
    out += [(100 + k, "http://x/ y\r\nz", LONG) for k in range(30)]
    out += [(200, None, None), (201, "u", ""), (202, "u", ""), (203, "u", "tiny"), (204, "u", "tiny"), (None, "n", LONG), (300, "b", "é梦\r\n\r\n" * 20_000)]
    return [*out, (203, "u", "tiny"), (129, "again", LONG)]


def pages(spark, data):
    return spark.createDataFrame(data, "page_id long, url string, html string")


def plain(data):
    first = {}
    for i, _, html in data:
        body = (html or "").encode()
        if len(body) >= 1000 and i is not None:
            first[body] = max(i, first.get(body, i))
    out = []
    for i, _, html in data:
        body = (html or "").encode()
        again = body in first and first[body] != i
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", first[body] if again else None))
    return sorted(out, key=str)


def told(df):
    key = lambda c: F.col(c).try_cast("long")
    read = df.select(key("record_key"), "payload_bytes", "payload_digest", "record_type", key("refers_key"), "error").collect()
    assert all(r.error is None for r in read)
    return sorted((tuple(r)[:5] for r in read), key=str)


def test_round_trip(spark):
    assert told(warc.round_trip(clashing(pages(spark, rows()), "key", "payload", "digest"), "page_id", "url", "html")) == plain(rows())


def test_payloads_and_small_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 1)
    to = warc.Archives(scratch_path(spark, "one").replace("file:", ""), b"")
    import os

    os.makedirs(to.path)
    done = to.add(warc.record("response", "7", "u", b"abc", hashlib.sha1(b"abc").digest()))
    assert len(done) == 1 and to.close() == []
    manifest = spark.createDataFrame(done, warc.MANIFEST)
    read = warc.read_archives(manifest).collect()
    assert [(r.record_key, bytes(r.payload), r.target_uri) for r in read] == [("7", b"abc", "u")]


def test_empty_table(spark):
    assert warc.round_trip(pages(spark, []), "page_id", "url", "html").collect() == []


def archive(spark, data):
    import os

    folder = scratch_path(spark, "bad").replace("file:", "")
    os.makedirs(folder)
    with open(f"{folder}/a.warc.zst", "wb") as file:
        file.write(data)
    return f"{folder}/a.warc.zst"


def test_dictionary_is_read_from_the_leading_frame(spark):
    samples = [prose(k, 200).encode() for k in range(200)]
    words = zstandard.train_dictionary(4000, samples).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(words))
    body = packer.compress(samples[0]) + packer.compress(samples[1])
    for stored in (words, zstandard.ZstdCompressor().compress(words)):
        got = list(warc.frames(archive(spark, warc.skippable(stored) + body), chunk=13))
        assert got == [(samples[0], None), (samples[1], None)]


def test_broken_archives(spark):
    frame = zstandard.ZstdCompressor(write_checksum=True).compress(b"x" * 500)
    cases = {
        b"": "an empty archive",
        b"\x28\xb5": "a frame breaks off",
        frame + struct.pack("<II", 0x184D2A53, 9) + b"x": "a skippable frame breaks off",
        struct.pack("<II", warc.MAGIC, 99) + b"short": "the dictionary breaks off",
        warc.skippable(b"") + frame[:-3]: "a frame breaks off",
    }
    for data, error in cases.items():
        assert list(warc.frames(archive(spark, data)))[-1] == (b"", error)
    assert list(warc.frames(archive(spark, warc.skippable(b"") + b"garbage here")))[-1][1].startswith("a frame cannot be decoded")


GOOD = warc.record("response", "1", "http://a", b"abc", hashlib.sha1(b"abc").digest())


@pytest.mark.parametrize(
    ("data", "error"),
    [
        (GOOD, None),
        (b"", "not a WARC record"),
        (GOOD.replace(b"WARC/1.1", b"HTTP/1.1"), "not a WARC record"),
        (GOOD.replace(b"WARC-Date: ", b"Date: "), "without warc-date"),
        (GOOD.replace(b"Content-Length: 3", b"Content-Length: 4"), "the block has another length"),
        (GOOD.replace(b"abc\r\n", b"abd\r\n"), "the payload has another digest"),
        (GOOD.replace(b"Payload-Length: 3", b"Payload-Length: 9"), "the payload has another length"),
        (GOOD.replace(b"sha1:", b"sha1:!"), "no readable digest"),
        (GOOD.replace(b"WARC-Type: response", b"WARC-Type response"), "a header line without a colon"),
        (warc.record("revisit", "1", None, b"abc", b"d" * 20).replace(b"WARC-Refers-To", b"X"), "a revisit without its source"),
    ],
)
def test_records_are_validated(data, error):
    assert warc.parse(data)["error"] == error


def foreign(kind, block, *lines, version="WARC/1.0", content="application/http; msgtype=response"):
    head = [version, f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:1234>", "WARC-Date: 2020-02-02T02:02:02Z", f"Content-Type: {content}", f"Content-Length: {len(block)}"]
    return "\r\n".join([*head, *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


BODY = b"<html>\r\n\r\nbody</html>"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n" + BODY
SHA1 = lambda x: "sha1:" + base64.b32encode(hashlib.sha1(x).digest()).decode()
FOREIGN = {
    "warcinfo": (foreign("warcinfo", b"software: x\r\n", content="application/warc-fields"), b"software: x\r\n", None),
    "response": (foreign("response", HTTP, f"WARC-Payload-Digest: {SHA1(BODY)}", f"WARC-Block-Digest: {SHA1(HTTP)}", "WARC-Target-URI: <http://a/>"), BODY, None),
    "hex digest": (foreign("response", HTTP, f"WARC-Payload-Digest: SHA-256:{hashlib.sha256(BODY).hexdigest()}"), BODY, None),
    "base 32 without padding": (foreign("resource", b"x", "WARC-Payload-Digest: md5:" + base64.b32encode(hashlib.md5(b"x").digest()).decode().rstrip("="), content="text/plain"), b"x", None),
    "unknown algorithm": (foreign("response", HTTP, "WARC-Payload-Digest: blake3:abc"), BODY, None),
    "request": (foreign("request", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", content="application/http;msgtype=request"), b"", None),
    "metadata": (foreign("metadata", b"via: x", "X-Folded: one", " two", content="application/warc-fields"), b"via: x", None),
    "conversion": (foreign("conversion", "é梦".encode(), content="text/plain", version="WARC/1.1"), "é梦".encode(), None),
    "continuation": (foreign("continuation", b"part", f"WARC-Payload-Digest: {SHA1(b'whole')}", "WARC-Segment-Number: 2", content="text/plain"), b"part", None),
    "upper case type": (foreign("Response", HTTP), BODY, None),
    "dns": (foreign("response", b"a. 60 IN A 1.2.3.4", content="text/dns"), b"a. 60 IN A 1.2.3.4", None),
    "empty block": (foreign("response", b""), b"", None),
    "other payload": (foreign("response", HTTP, f"WARC-Payload-Digest: {SHA1(HTTP)}"), None, "the payload has another digest"),
    "other block": (foreign("response", HTTP, f"WARC-Block-Digest: {SHA1(BODY)}"), None, "the block has another digest"),
    "short digest": (foreign("response", HTTP, "WARC-Payload-Digest: sha1:ABCD"), None, "no readable digest"),
}


@pytest.mark.parametrize("case", FOREIGN)
def test_records_of_other_writers(case):
    data, payload, error = FOREIGN[case]
    got = warc.parse(data)
    assert (got["payload"], got["error"], got["record_key"]) == (payload, error, "<urn:uuid:1234>")
    if error is None:
        assert (got["payload_bytes"], got["payload_digest"]) == (len(payload), hashlib.sha1(payload).hexdigest())
    if case == "response":
        assert got["target_uri"] == "http://a/"


def test_revisits_of_other_writers():
    lines = (f"WARC-Payload-Digest: {SHA1(BODY)}", "WARC-Refers-To-Target-URI: http://a/", "WARC-Refers-To-Date: 2019-01-01T00:00:00Z")
    got = warc.parse(foreign("revisit", b"HTTP/1.1 304 Not Modified\r\n\r\n", *lines))
    assert (got["error"], got["refers_key"], got["payload_bytes"], got["payload_digest"]) == (None, None, None, hashlib.sha1(BODY).hexdigest())
    assert warc.parse(foreign("revisit", b"", "WARC-Refers-To: <urn:uuid:9>"))["refers_key"] == "<urn:uuid:9>"
    assert warc.parse(foreign("revisit", b""))["error"] == "a revisit without its source"


@pytest.mark.parametrize("chunk", [1, 7, 1 << 20])
def test_archives_of_other_writers(spark, chunk):
    parts = [data for data, *_ in FOREIGN.values()]
    packer = zstandard.ZstdCompressor(write_content_size=False)
    between = struct.pack("<II", 0x184D2A50, 5) + b"notes"
    body = b"".join(packer.compress(p) + between * (k % 2) for k, p in enumerate(parts))
    for head in (b"", between, warc.skippable(b"")):
        assert list(warc.frames(archive(spark, head + body), chunk)) == [(p, None) for p in parts]


def test_a_foreign_archive_is_read_as_a_table(spark):
    packer = zstandard.ZstdCompressor()
    name = archive(spark, b"".join(packer.compress(data) for data, *_ in FOREIGN.values()))
    read = warc.read_archives(spark.createDataFrame([(name, 1, 1)], warc.MANIFEST)).collect()
    assert [(None if r.payload is None else bytes(r.payload), r.error) for r in read] == [(p, e) for _, p, e in FOREIGN.values()]
