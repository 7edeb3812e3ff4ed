"""WARC archives, compressed with Zstandard: one frame for each record, the dictionary in a leading skippable frame.

Writing. Each task streams its records to archives of its own (a new one after `rotate` bytes), named by a random id, so a
task that is run again leaves files that no manifest names. The manifest - a row for each finished archive - is a table in
the shared folder; Spark's commit decides which attempt counts. Archives go through pyarrow's file systems, so the shared
folder may be any of those (file, hdfs, s3, gs). Identical payloads of at least `least` bytes are stored once: the record
with the smallest page_id is a response, the others are revisits that refer to it.

Reading. An archive is streamed: the dictionary is taken from the skippable frame (itself compressed or not), then one frame
is decoded for each record; version line, headers, Content-Length, the closing line breaks and the digests (by the algorithm
that they name) are checked, and an archive that fails raises ValueError with the path and the offset. Records of all types
are read; HTTP headers are looked for in responses and revisits alone. Archives that others wrote need no manifest.

Defined cases. Null html: empty payload, a response. Null url: `urn:x-unknown`. Line breaks in a url are percent-encoded.
Null page_id: `null` in the record's id, never the smallest of a group; if all of a group are null, all are responses. Rows
that repeat the smallest page_id and the payload are all responses. Very long payloads: one record is held in memory at a
time. Empty table: no archive, empty result. Other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import fresh_path, lowest, prepare, saved, strings, table

#: Fixed values of the formats.
SKIPPABLE, FRAME, DICTIONARY = 0x184D2A5D, 0xFD2FB528, 0xEC30A437
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANDATORY = ("warc-record-id", "content-length", "warc-date", "warc-type")


class Record(NamedTuple):
    kind: str
    headers: dict[str, str]
    block: bytes


def page_uri(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(uri: str) -> int | None:
    """The page of a record's id; None for pages without id and for ids of other kinds."""
    m = re.fullmatch(r"<urn:x-page:(-?[0-9]+)>", uri)
    return int(m[1]) if m else None


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder, and its path there."""
    if not re.match(r"[A-Za-z][A-Za-z0-9+.-]+:", folder):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))


def check_digest(label: str, data: bytes, what: str) -> None:
    """label is algorithm:value, in hex or base32; algorithms that are not known here are not checked."""
    algorithm, _, value = label.partition(":")
    if (name := algorithm.lower().replace("-", "")) in hashlib.algorithms_guaranteed and not name.startswith("shake"):
        raw = hashlib.new(name, data).digest()
        if value.lower() != raw.hex() and value.upper().rstrip("=") != base64.b32encode(raw).decode().rstrip("="):
            raise ValueError(f"{what} digest")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response or revisit record for a page. A revisit has the response's HTTP headers and no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "urn:x-unknown"
    headers = {
        "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": page_uri(page_id), "WARC-Date": date, "WARC-Target-URI": target,
        "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha256:{hashlib.sha256(payload).hexdigest()}", "WARC-Block-Digest": f"sha256:{hashlib.sha256(block).hexdigest()}",
    }
    if revisit:
        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To": page_uri(refers_to)}
    headers["Content-Length"] = str(len(block))
    return b"".join([VERSION, b"\r\n", *(f"{k}: {v}\r\n".encode() for k, v in headers.items()), b"\r\n", block, b"\r\n\r\n"])


def parse_record(data: bytes) -> Record:
    """Check and take apart the bytes of one record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line or no end of headers")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.strip() != name:
            raise ValueError(f"header line {line[:60]!r}")
        if name.lower() in headers and name.lower() != "warc-concurrent-to":  # the only one that may be repeated
            raise ValueError(f"header {name} twice")
        headers[name.lower()] = value.strip()
    if missing := [h for h in MANDATORY if h not in headers]:
        raise ValueError(f"no header {missing[0]}")
    if not headers["content-length"].isascii() or not headers["content-length"].isdigit():
        raise ValueError("Content-Length is no number")
    n = int(headers["content-length"])
    if len(rest) != n + 4 or rest[n:] != b"\r\n\r\n":
        raise ValueError(f"Content-Length {n}, but {len(rest) - 4} bytes")
    block = rest[:n]
    if "warc-block-digest" in headers:
        check_digest(headers["warc-block-digest"], block, "block")
    return Record(headers["warc-type"], headers, block)


def http_payload(record: Record) -> tuple[bytes | None, int]:
    """The payload (None in a revisit) and the full payload's length, checked against headers and digest. A record without
    HTTP in it is its own payload."""
    if record.kind not in ("response", "revisit") or not record.headers.get("content-type", "").startswith("application/http"):
        return record.block, len(record.block)
    head, gap, payload = record.block.partition(b"\r\n\r\n")
    if not gap:
        raise ValueError("no end of HTTP headers")
    m = re.search(rb"\r\ncontent-length: *([0-9]+)", head, re.IGNORECASE)
    if record.kind == "revisit":
        if payload:
            raise ValueError("a revisit with a payload")
        return None, int(m[1]) if m else 0
    if m and len(payload) != int(m[1]):
        raise ValueError(f"HTTP length {int(m[1])}, but {len(payload)} bytes")
    if "warc-payload-digest" in record.headers:
        check_digest(record.headers["warc-payload-digest"], payload, "payload")
    return payload, len(payload)


def payload_digest(record: Record, payload: bytes | None) -> str | None:
    """SHA-256 of the payload in hex: named by the record, or else made from what it holds."""
    named = record.headers.get("warc-payload-digest", "")
    if named.startswith("sha256:"):
        return named.removeprefix("sha256:")
    return None if payload is None else hashlib.sha256(payload).hexdigest()


def dictionary_frame(dictionary: bytes) -> bytes:
    """The leading skippable frame; the dictionary is stored compressed if that is smaller."""
    packed = zstandard.ZstdCompressor(level=19).compress(dictionary)
    content = packed if len(packed) < len(dictionary) else dictionary
    return struct.pack("<II", SKIPPABLE, len(content)) + content


def loaded_dictionary(content: bytes) -> zstandard.ZstdCompressionDict:
    if content[:4] == struct.pack("<I", FRAME):
        content = zstandard.ZstdDecompressor().decompress(content, max_output_size=1 << 27)
    if content[:4] != struct.pack("<I", DICTIONARY):
        return zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressionDict(content)


def read_archive(stream, name: str = "archive", chunk: int = 1 << 17) -> Iterator[Record]:
    """The records of an open archive, one frame at a time."""
    data, at = b"", 0

    def need(n: int) -> bool:
        nonlocal data
        while len(data) < n:
            more = stream.read(chunk)
            if not more:
                return False
            data += more
        return True

    decompressor = zstandard.ZstdDecompressor()
    if need(8) and struct.unpack("<I", data[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", data[4:8])[0]
        if not need(8 + size):
            raise ValueError(f"{name}: the dictionary is cut off")
        decompressor = zstandard.ZstdDecompressor(dict_data=loaded_dictionary(data[8 : 8 + size]))
        data, at = data[8 + size :], 8 + size
    while need(1):
        frame = decompressor.decompressobj()
        out: list[bytes] = []
        used = 0
        try:
            while True:
                used += len(data)
                out.append(frame.decompress(data))
                if frame.eof:
                    break
                data = stream.read(chunk)
                if not data:
                    raise ValueError("the frame is cut off")
            data = frame.unused_data
            used -= len(data)
            yield parse_record(b"".join(out))
        except (ValueError, zstandard.ZstdError) as e:
            raise ValueError(f"{name}, byte {at}: {e}") from e
        at += used


def train_dictionary(samples: list[bytes], size: int) -> bytes:
    """A dictionary from sample records, or (too few of them) their own bytes, or nothing."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def classified(pages: DataFrame, least: int = 100) -> DataFrame:
    """page_id, url, payload, revisit, first_id (the response's page_id) for each page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload")).withColumn("digest", F.when(F.octet_length("payload") >= least, F.sha2("payload", 256)))
    # smaller payloads have no key to meet on: they are spread, and find nothing
    rows = rows.withColumn("key", F.coalesce("digest", F.pmod(F.xxhash64("page_id"), F.lit(65_536)).cast("string")))
    # only payloads that occur more than once; pre-aggregated before the shuffle
    first = rows.filter("digest is not null").groupBy(F.col("digest").alias("key")).agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n")
    revisit = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return rows.join(first, "key", "left").select("page_id", "url", "payload", revisit.alias("revisit"), "first_id")


def write_archives(pages: DataFrame, folder: str, least: int = 100, rotate: int = 64 << 20, level: int = 6, dictionary_size: int = 64 << 10, sample_rows: int = 400, sample_bytes: int = 16 << 10, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write a record for each page into archives below folder; returns the manifest (path, records, bytes), saved.

    The dictionary, which only compresses, is trained on at most sample_rows payloads (those with the smallest hash), of each
    a stretch of sample_bytes code points at a place that the hash chooses."""
    spark = pages.sparkSession
    prepare(spark)
    place = F.pmod(F.xxhash64("page_id", "url"), F.greatest(F.length("html") - sample_bytes, F.lit(0)) + 1)
    stretch = pages.filter("length(html) > 0").select("page_id", "url", F.substring(F.col("html"), place.cast("int") + 1, F.lit(sample_bytes)).alias("html"))
    sample = lowest(stretch, sample_rows, "page_id", "url", "html").collect()
    made = train_dictionary([record_bytes(r.page_id, r.url, r.html.encode(), None, False, date) for r in sample], dictionary_size)
    dictionary = spark.sparkContext.broadcast((made, dictionary_frame(made) if made else b""))  # at most dictionary_size bytes each
    first, base = opened(folder)
    first.create_dir(base, recursive=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = opened(folder)
        made, head = dictionary.value
        compressor = zstandard.ZstdCompressor(level=level, dict_data=loaded_dictionary(made) if made else None, write_content_size=True, write_checksum=True)
        out, path, records, size, raw = None, "", 0, 0, 0
        finished: list[dict] = []
        for b in batches:
            for page_id, url, payload, revisit, first_id in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "payload", "revisit", "first_id")), strict=True):
                if out is None:
                    path, records, raw = f"{top}/pages-{uuid.uuid4().hex}.warc.zst", 0, 0
                    out = store.open_output_stream(path, compression=None)  # pyarrow would compress by the name
                    out.write(head)
                    size = len(head)
                record = record_bytes(page_id, url, payload.encode(), first_id, revisit, date)
                frame = compressor.compress(record)
                out.write(frame)
                records, size, raw = records + 1, size + len(frame), raw + len(record)
                if raw >= rotate:
                    out.close()
                    finished.append({"path": path, "records": records, "bytes": size})
                    out = None
        if out is not None:
            out.close()
            finished.append({"path": path, "records": records, "bytes": size})
        if finished:
            yield pa.RecordBatch.from_pylist(finished, schema=pa.schema([("path", pa.string()), ("records", pa.int64()), ("bytes", pa.int64())]))

    return saved(classified(pages, least).mapInArrow(run, "path string, records long, bytes long"), "warc-manifest")


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """Each record of the archives that manifest (path, and records if their number is to be checked) names: page_id and
    record_id, url, record_type, payload (null in a revisit), payload_bytes and payload_digest (SHA-256) of the full payload,
    refers_to."""
    prepare(manifest.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])
    counted = "records" in manifest.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = opened(folder)
        rows: list[tuple] = []
        held = 0
        for b in batches:
            for path, records in zip(strings(b.column("path")), b.column("records").to_pylist() if counted else [None] * b.num_rows, strict=True):
                seen = 0
                with store.open_input_stream(path, compression=None) as stream:
                    for r in read_archive(stream, path):
                        payload, n = http_payload(r)
                        name, refers = r.headers["warc-record-id"], r.headers.get("warc-refers-to")
                        rows.append((page_of(name), name, r.headers.get("warc-target-uri"), r.kind, payload, n, payload_digest(r, payload), refers and page_of(refers)))
                        seen, held = seen + 1, held + len(payload or b"")
                        if len(rows) >= 1024 or held >= 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows, held = [], 0
                if records is not None and seen != records:
                    raise ValueError(f"{path}: {seen} records, not {records}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return manifest.mapInArrow(run, "page_id long, record_id string, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def archive(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Write pages to archives in the shared folder and read them back. The archives stay: the result reads them."""
    folder = fresh_path(spark, "warc")
    manifest = write_archives(pages, folder)
    files = manifest.count()  # a row for each archive
    return read_archives(manifest.repartition(max(1, min(files, 4 * spark.sparkContext.defaultParallelism)), "path"), folder)


def op6_warc(spark, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each."""
    return archive(table(spark, sf_dir, "pages"), spark).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
), f AS (
  SELECT payload_digest AS d, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first_id IS NOT NULL AND page_id IS DISTINCT FROM first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.d AND p.payload_bytes >= 100
"""
