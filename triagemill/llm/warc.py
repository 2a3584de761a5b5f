"""Legacy archive converter: ARC records in, WARC archives out, and a reader for them.

An ARC record is one header line and a body of the declared length.  Version 1 lines have five fields (URL, IP address,
date, content type, length), version 2 lines ten (status, checksum, location, offset and file name come before the
length).  The converter takes the version from the line, checks the declared length, parts the HTTP head from the
payload and makes the WARC fields: a record id that holds the record's key, an ISO time from the 14 digits, the type,
and SHA-1 digests.  Of records with equal payloads of at least ``min_bytes`` bytes, the one with the smallest key is the
response and the others become revisits that refer to it; only digests and keys are shuffled for that.

Archives are plain WARC/1.1 files, one per task, written by Spark's own committer as lines of text whose separator is
the end of a record, so a task that runs again leaves nothing behind, and any file system Spark knows will do.

Cases: null html is an empty payload; a null url is ``about:blank`` (spaces and control characters in a url are
percent-encoded); a null key can be a response or a revisit but nothing refers to it; rows with equal key and payload
are all responses; a body shorter than declared or a line with other fields raises an error; an empty table gives an
empty archive; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagemill.llm.common import sent, ship
from triagemill.session import scratch_path, settle

KEYED, NAMESPACE = 1 << 61, 0x5741524300000000
UNSAFE = re.compile(r"[\x00-\x20\x7f]")
HEAD = "key long, digest string, payload_bytes long, record_id string, uri string, date string"


def arc_record(url: str | None, payload: bytes, key: int | None, version: int, date: str = "20200101000000") -> bytes:
    """A legacy record; the key travels in an HTTP header."""
    url = UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    http = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + f"X-Key: {'' if key is None else key}\r\n"
    body = f"{http}Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    extra = " 200 - - 0 legacy.arc" if version == 2 else ""
    return f"{url} 0.0.0.0 {date} text/html{extra} {len(body)}\n".encode() + body + b"\n"


def parse_arc(record: bytes) -> dict:
    """The fields of an ARC record of either version."""
    line, _, rest = record.partition(b"\n")
    fields = line.decode().split(" ")
    if len(fields) not in (5, 10):
        raise ValueError(f"an ARC header line has 5 or 10 fields, not {len(fields)}")
    length = int(fields[-1])
    if len(rest) < length:
        raise ValueError(f"{length} bytes are declared, {len(rest)} are there")
    head, _, payload = rest[:length].partition(b"\r\n\r\n")
    key = re.search(rb"X-Key: (-?\d+)", head)
    return {"url": fields[0], "ip": fields[1], "date": fields[2], "mime": fields[3], "http": head + b"\r\n\r\n",
            "payload": payload, "key": int(key[1]) if key else None}


def record_id(key: int | None) -> str:
    """A version 8 UUID (own layout) that holds the key, so that readers get it back."""
    low = (key or 0) & (1 << 64) - 1
    # 48 bits name the layout, then 12 + 62 free bits hold whether there is a key, and the key
    free = (key is not None) << 64 | low
    return str(uuid.UUID(int=(NAMESPACE >> 16) << 80 | 8 << 76 | (free >> 62 & 0xFFF) << 64 | 2 << 62 | free & (1 << 62) - 1))


def key_of(record: str) -> int | None:
    n = uuid.UUID(record).int
    free = (n >> 64 & 0xFFF) << 62 | n & (1 << 62) - 1
    low = free & (1 << 64) - 1
    return (low - (1 << 64) if low >> 63 else low) if free >> 64 else None


def iso_time(digits: str) -> str:
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def to_arc(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Legacy records (``arc``) of a page table, of both versions in turn."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for some in _pieces(b):
                out = [arc_record(u, (h or "").encode(), k, 1 + (k or 0) % 2) for k, u, h in zip(*(c.to_pylist() for c in some.columns))]
                yield pa.RecordBatch.from_pydict({"arc": pa.array(out, pa.binary())})

    ship(pages.sparkSession)
    return pages.select(F.col(key).cast("bigint"), F.col(url), F.col(html)).mapInArrow(write, "arc binary")


def _pieces(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Small slices, so that a batch of large rows is not held many times over."""
    for i in range(0, batch.num_rows, rows):
        yield batch.slice(i, rows)


def _converted(arcs: DataFrame, whole: bool) -> DataFrame:
    """The WARC fields of every record; with ``whole`` also the bytes of its two possible forms."""

    def parse(batches):
        for b in batches:
            for some in _pieces(b):
                rows = []
                for arc in some.column(0).to_pylist():
                    x = parse_arc(arc)
                    rid, date, digest = record_id(x["key"]), iso_time(x["date"]), _base32(x["payload"])
                    row = [x["key"], digest, len(x["payload"]), rid, x["url"], date]
                    if whole:
                        def head(kind, block, more=""):
                            return (f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:uuid:{rid}>\r\nWARC-Date: {date}\r\n"
                                    f"WARC-Target-URI: {x['url']}\r\nWARC-IP-Address: {x['ip']}\r\nWARC-Payload-Digest: sha1:{digest}\r\n"
                                    f"WARC-Block-Digest: sha1:{_base32(block)}\r\nContent-Type: application/http; msgtype=response\r\n{more}"
                                    f"Content-Length: {len(block)}\r\n").encode()
                        profile = "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
                        block = x["http"] + x["payload"]
                        row += [head("response", block) + b"\r\n" + block + b"\r\n", head("revisit", x["http"], profile), b"\r\n" + x["http"] + b"\r\n"]
                    rows.append(row)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * len(kinds), kinds)], names)

    fields = HEAD + (", response binary, revisit_head binary, revisit_tail binary" if whole else "")
    names = [f.split()[0] for f in fields.split(", ")]
    kinds = [{"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}[f.split()[1]] for f in fields.split(", ")]
    return arcs.mapInArrow(parse, fields)


def write_warc(arcs: DataFrame, path: str | None = None, min_bytes: int = 0) -> str:
    """Convert ARC records and write the archives; returns their folder."""
    spark = arcs.sparkSession
    ship(spark)
    path = path or scratch_path(spark, "warc")
    first = F.min(F.struct("key", "record_id", "uri", "date"))
    seen = _converted(arcs, False).filter(F.col("payload_bytes") >= min_bytes).groupBy("digest", "payload_bytes").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("key").isNotNull(), F.struct("key", "record_id", "uri", "date"))).alias("first"))
    seen = settle(seen.filter("n > 1 and first is not null").drop("n"), "payloads")
    rows = _converted(arcs, True).join(sent(seen), ["digest", "payload_bytes"], "left")
    refers = F.concat(
        F.lit("WARC-Refers-To: <urn:uuid:"), F.col("first.record_id"), F.lit(">\r\nWARC-Refers-To-Target-URI: "), F.col("first.uri"),
        F.lit("\r\nWARC-Refers-To-Date: "), F.col("first.date"), F.lit("\r\n")).cast("binary")
    alone = F.col("first").isNull() | F.coalesce(F.col("first.key") == F.col("key"), F.lit(False))
    record = F.when(alone, F.col("response")).otherwise(F.concat("revisit_head", refers, "revisit_tail"))
    rows.select(record.cast("string").alias("value")).write.option("lineSep", "\r\n").text(path)
    return path


def parse_warc(data: bytes) -> Iterator[dict]:
    """Records of an archive by their headers and declared lengths."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        fields = dict(x.split(": ", 1) for x in lines[1:])
        size = int(fields["Content-Length"])
        yield fields | {"block": data[end + 4 : end + 4 + size]}
        at = end + 4 + size + 4


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """key, payload_bytes, payload_digest, record_type and refers_to (a key) of every record of the archives."""

    def read(batches):
        for b in batches:
            for data in b.column("content"):
                rows = []
                for x in parse_warc(data.as_buffer().to_pybytes()):
                    head, _, payload = x["block"].partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    digest = x["WARC-Payload-Digest"].removeprefix("sha1:")
                    if x["WARC-Type"] == "response" and (len(payload) != size or _base32(payload) != digest):
                        raise ValueError(f"damaged record {x['WARC-Record-ID']}")
                    refers = x.get("WARC-Refers-To")
                    rows.append((key_of(x["WARC-Record-ID"][10:-1]), size, digest, x["WARC-Type"], refers and key_of(refers[10:-1])))
                cols = list(zip(*rows)) or [()] * 5
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()))],
                    ["key", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(read, "key long, payload_bytes long, payload_digest string, record_type string, refers_to long")
