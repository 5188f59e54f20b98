"""WARC archives in Zstandard: one frame per record, with a dictionary in a leading skippable frame.

Writing: every row becomes a record. Of records with equal payloads of at least ``REVISIT_BYTES``, those
with the largest key are responses and the others revisits without a payload. Archives are closed at
``ARCHIVE_BYTES``. Each attempt of a task writes files of its own, and only those that a finished task
reports are in the manifest, so lost executors leave stray files at most, never double records.
Reading: the dictionary, if there is one, is loaded from the leading skippable frame, each frame is decoded to one record, and version,
required headers, block length, payload length and digests, where given, are checked; a record that fails has its reason in
``error``. Archives of other writers are read alike: records of any type, payloads behind HTTP headers, folded header lines,
digests in base 32 or hex, skippable frames in between.
A null payload is an empty one; a null key is kept, and counts as the smallest. Repeated rows are records of their own; of a tie for
the largest key all are responses. A record is held whole, however long. An empty table gives no archive and no row. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from martloom.llm.rows import file_system, map_batches, pick
from martloom.session import scratch_path, stage

MAGIC = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
# Any of 16 numbers marks a frame that holds no data.
SKIPPABLE = range(0x184D2A50, 0x184D2A60)
# Digest algorithms by name, and the bytes of each.
DIGESTS = {"md5": 16, "sha1": 20, "sha256": 32, "sha512": 64}
OWN_KEY = re.compile("<urn:row:(.*)>", re.S)
VERSION = b"WARC/1.1"
REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64_000_000
DICTIONARY_BYTES = 64_000
# The bounds of what a dictionary is made from: so many payloads of so many bytes at most.
DICTIONARY_ROWS = 400
DICTIONARY_PAYLOAD = 64_000
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
DATE = "2024-01-01T00:00:00Z"
MANIFEST = "archive string, records long, bytes long"
RECORD = (
    "archive string, record_key string, record_type string, target_uri string, refers_key string, "
    "payload_bytes long, payload_digest string, payload binary, error string"
)


def record(kind: str, key: str, uri: str | None, payload: bytes, digest: bytes, refers: str | None = None) -> bytes:
    """One WARC record, ``payload`` being the full one; a revisit carries its length and digest but not its bytes."""
    block = payload if kind == "response" else b""
    lines = [
        VERSION.decode(),
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: <urn:row:{key}>",
        f"WARC-Date: {DATE}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(digest).decode(),
        f"WARC-Payload-Length: {len(payload)}",
        f"Content-Length: {len(block)}",
        "Content-Type: text/html",
    ]
    if uri:
        lines.append("WARC-Target-URI: " + " ".join(uri.split()))
    if kind == "revisit":
        lines += [f"WARC-Refers-To: <urn:row:{refers}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of ``RECORD`` but the archive; ``error`` tells what is wrong.

    The payload is the block, behind its HTTP headers if it is an HTTP message. ``payload_bytes`` and ``payload_digest`` (SHA-1) are the full payload's;
    those of a revisit are what it says of its source, null if it does not.
    """
    out = dict.fromkeys(("record_key", "record_type", "target_uri", "refers_key", "payload_bytes", "payload_digest", "payload", "error"))
    head, gap, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not version.startswith(b"WARC/1."):
        return out | {"error": "not a WARC record"}
    headers, name = {}, None
    for line in lines:
        text = line.decode("utf-8", "replace")
        if text[:1] in (" ", "\t") and name:
            headers[name] += " " + text.strip()
            continue
        name, colon, value = text.partition(":")
        name = name.strip().lower()
        if not colon:
            return out | {"error": "a header line without a colon"}
        headers[name] = value.strip()
    if absent := [h for h in REQUIRED if h not in headers]:
        return out | {"error": "without " + ", ".join(absent)}
    length, kind = headers["content-length"], headers["warc-type"].lower()
    uri = headers.get("warc-target-uri")
    if uri and uri[0] == "<" and uri[-1] == ">":  # as the first version of the format wrote it
        uri = uri[1:-1]
    out |= {"record_type": kind, "target_uri": uri, "record_key": _key(headers["warc-record-id"])}
    if not _number(length) or len(rest) != int(length) + 4 or rest[-4:] != b"\r\n\r\n":
        return out | {"error": "the block has another length"}
    block = rest[:-4]
    payload = block
    if headers.get("content-type", "").replace(" ", "").lower().startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    try:
        said, of_block = (_digest(headers.get(f"warc-{part}-digest")) for part in ("payload", "block"))
    except ValueError:
        return out | {"error": "no readable digest"}
    if of_block and hashlib.new(of_block[0], block).digest() != of_block[1]:
        return out | {"error": "the block has another digest"}
    full = headers.get("warc-payload-length")
    if full is not None and not _number(full):
        return out | {"error": "the payload has another length"}
    if kind == "revisit":
        if "warc-refers-to" not in headers and "warc-refers-to-target-uri" not in headers:
            return out | {"error": "a revisit without its source"}
        refers = headers.get("warc-refers-to")
        return out | {
            "refers_key": None if refers is None else _key(refers),
            "payload_bytes": None if full is None else int(full),
            "payload_digest": said[1].hex() if said and said[0] == "sha1" else None,
        }
    whole = "warc-segment-number" not in headers  # a segment's digest and length are those of the whole payload
    if whole and said and hashlib.new(said[0], payload).digest() != said[1]:
        return out | {"error": "the payload has another digest"}
    if whole and full is not None and int(full) != len(payload):
        return out | {"error": "the payload has another length"}
    return out | {"payload_bytes": len(payload), "payload_digest": hashlib.sha1(payload).hexdigest(), "payload": payload}


def _number(text: str) -> bool:
    return text.isascii() and text.isdigit()


def _digest(text: str | None) -> tuple[str, bytes] | None:
    """(algorithm, digest) in base 32 or hex; nothing for an algorithm that is not known, an error for what is no digest."""
    if text is None:
        return None
    name, _, value = text.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in DIGESTS:
        return None
    value, size = value.strip(), DIGESTS[name]
    read = bytes.fromhex(value) if len(value) == 2 * size else base64.b32decode(value.upper() + "=" * (-len(value) % 8))
    if len(read) != size:
        raise ValueError("a digest of another length")
    return name, read


def _key(address: str) -> str:
    """The key of a record written here; another writer's identifier as it stands."""
    own = OWN_KEY.fullmatch(address)
    return own[1] if own else address


def train_dictionary(payloads: DataFrame, rows: int = DICTIONARY_ROWS) -> bytes:
    """A dictionary from the payloads with the smallest hashes, within the bounds above; empty if there are too few to make one.

    Hashes alone are ranked, so no task sends payloads to the driver but those of the sample.
    """
    hashed = payloads.where(F.length("payload").between(1, DICTIONARY_PAYLOAD)).select(F.xxhash64("payload").alias("hash"), "payload")
    least = hashed.select("hash").distinct().orderBy("hash").limit(rows).agg(F.max("hash").alias("top")).first()["top"]
    if least is None:
        return b""
    some = hashed.where(F.col("hash") <= least).groupBy("hash").agg(F.min("payload").alias("payload")).orderBy("hash").collect()
    samples = [bytes(r["payload"]) for r in some]
    if len(samples) < 8:
        return b""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def skippable(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


class Archives:
    """Writes records into archives of bounded size below one folder."""

    def __init__(self, folder: str, dictionary: bytes):
        self.files, self.path = file_system(folder)
        self.folder, self.dictionary = folder, dictionary
        known = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=known, write_content_size=True, write_checksum=True)
        self.out, self.name, self.records, self.size = None, "", 0, 0

    def add(self, data: bytes) -> list[tuple[str, int, int]]:
        """The archive that this record has filled, if it has."""
        if self.out is None:
            self.name = f"part-{uuid.uuid4().hex}.warc.zst"
            self.out = self.files.open_output_stream(f"{self.path}/{self.name}", compression=None)
            self.out.write(skippable(self.dictionary))
            self.records, self.size = 0, 8 + len(self.dictionary)
        frame = self.packer.compress(data)
        self.out.write(frame)
        self.records, self.size = self.records + 1, self.size + len(frame)
        return self.close() if self.size >= ARCHIVE_BYTES else []

    def close(self) -> list[tuple[str, int, int]]:
        if self.out is None:
            return []
        self.out.close()
        self.out = None
        return [(f"{self.folder}/{self.name}", self.records, self.size)]


def write_archives(rows: DataFrame, folder: str, key: str, uri: str, payload: str) -> DataFrame:
    """Write every row's record below ``folder``; the manifest (archive, records, bytes), as a table."""
    spark = rows.sparkSession
    plain = pick(rows, key, uri, payload).select(
        F.col(key).alias("key"), F.col(uri).cast("string").alias("uri"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")
    )
    dictionary = train_dictionary(plain)
    signed = plain.withColumn("digest", F.sha1("payload"))
    # one row per repeated digest; counted before the shuffle
    own = F.struct(F.col("key").isNotNull().alias("some"), F.col("key").alias("key"))
    large = signed.where(F.length("payload") >= REVISIT_BYTES).select("key", "digest")
    groups = large.groupBy("digest").agg(F.max(own).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = groups.select("digest", F.col("first.key").alias("refers"), F.lit(True).alias("again"))
    # digests and keys are joined first; payloads are shuffled by the last join, once
    others = large.join(first, "digest").where(~F.col("key").eqNullSafe(F.col("refers"))).select("key", "digest", "refers").distinct()
    _make_folder(spark, folder)
    told = signed.join(
        others.withColumnsRenamed({"key": "k", "digest": "d"}), F.col("key").eqNullSafe(F.col("k")) & (F.col("digest") == F.col("d")), "left"
    ).select(F.col("key").cast("string").alias("key"), "uri", "payload", "digest", F.col("refers").cast("string").alias("refers"), F.col("d").isNotNull().alias("again"))

    def work(steps):
        to = Archives(folder, dictionary)
        done = []
        for columns in steps:
            for k, address, data, digest, refers, again in zip(*columns, strict=True):
                kind = "revisit" if again else "response"
                done += to.add(record(kind, "" if k is None else k, address, bytes(data), bytes.fromhex(digest), "" if refers is None else refers))
        done += to.close()
        yield [list(c) for c in zip(*done, strict=True)] if done else [[], [], []]

    return stage(map_batches(told, MANIFEST, work), "archives")


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of ``RECORD`` per record of the archives; an archive is read by one task, record after record."""
    parts = max(1, min(manifest.count(), 10_000))
    names = manifest.select("archive").repartition(parts, "archive")

    def work(steps):
        for (archives,) in steps:
            for name in archives:
                yield from _rows(name, payloads)

    return map_batches(names, RECORD, work)


def _rows(name: str, payloads: bool):
    held, size = [], 0
    for data, error in frames(name):
        row = parse(data) if error is None else {"error": error}
        held.append(row)
        size += len(data)
        if len(held) >= 256 or size > 16_000_000:
            yield _columns(name, held, payloads)
            held, size = [], 0
    if held:
        yield _columns(name, held, payloads)


def _columns(name: str, rows: list[dict], payloads: bool) -> list[list]:
    names = [c.split()[0] for c in RECORD.split(", ")][1:]
    return [[name] * len(rows), *([r.get(c) if payloads or c != "payload" else None for r in rows] for c in names)]


def frames(name: str, chunk: int = 1 << 20):
    """(decoded frame, None) of every data frame, or (b"", error) where the archive breaks off.

    A leading skippable frame of the agreed number holds the dictionary, plain or compressed; other skippable frames are passed over.
    """
    folder, _, file = name.rpartition("/")
    files, path = file_system(folder)
    with files.open_input_stream(f"{path}/{file}", compression=None) as source:
        data, known, leading = b"", zstandard.ZstdDecompressor(), True
        while True:
            while len(data) < 8 and (more := source.read(chunk)):
                data += more
            if not data:
                if leading:
                    yield b"", "an empty archive"
                return
            magic, size = struct.unpack("<II", data[:8]) if len(data) >= 8 else (0, 0)
            if magic in SKIPPABLE:
                wanted = leading and magic == MAGIC
                held, data = [data[8 : 8 + size]], data[8 + size :]
                left = size - len(held[0])
                while left and (more := source.read(min(left, chunk))):
                    left -= len(more)
                    if wanted:
                        held.append(more)
                if left:
                    yield b"", "the dictionary breaks off" if wanted else "a skippable frame breaks off"
                    return
                if wanted and size:
                    known = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(_plain(b"".join(held))))
                leading = False
                continue
            leading = False
            one, out = known.decompressobj(), []
            try:
                while True:
                    out.append(one.decompress(data))
                    if one.eof:
                        break
                    data = source.read(chunk)
                    if not data:
                        yield b"", "a frame breaks off"
                        return
            except zstandard.ZstdError as e:
                yield b"", f"a frame cannot be decoded: {e}"
                return
            yield b"".join(out), None
            data = one.unused_data


def _plain(dictionary: bytes) -> bytes:
    """A dictionary may be compressed itself, with or without its size in the frame."""
    return zstandard.ZstdDecompressor().decompressobj().decompress(dictionary) if dictionary.startswith(ZSTD_MAGIC) else dictionary


def _make_folder(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)


def round_trip(rows: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """Write archives below the shared folder and read all records back, without the payloads."""
    folder = scratch_path(rows.sparkSession, "warc")
    return read_archives(write_archives(rows, folder, key, uri, payload), payloads=False)
