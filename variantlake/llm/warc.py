"""WARC archives: a writer and a sequential reader, one gzip member per record."""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import unquote, urlparse

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Workspace, join_split

LEVEL = 6
ROLL_BYTES = 32 << 20  # an archive is closed once it holds this much
REVISIT_LEAST = 1000
BROADCAST_ROWS = 250_000  # digests of repeated payloads, about 120 bytes each when broadcast
CHUNK = 1 << 16
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the WARC 1.1 standard
RECORD = "warc_type string, record_id string, target_uri string, date string, refers_to_uri string, payload_digest string, payload_length long, block_length long, digest_ok boolean, content binary"


def _open(path: str, mode: str):
    """A file in a folder that all executors share: by the file system itself, or through Arrow's for other stores."""
    url = urlparse(path)
    if url.scheme in ("", "file"):
        return open(unquote(url.path), mode + "b")
    from pyarrow import fs

    store, at = fs.FileSystem.from_uri(path)
    return store.open_output_stream(at) if mode == "w" else store.open_input_stream(at)


def encode_record(kind: str, record_id: str, uri: str, date: str, payload: bytes, digest: str, refers: str | None, size: int) -> bytes:
    """One record as one gzip member. A revisit carries the HTTP header alone; its digest is of the full payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id}", f"WARC-Target-URI: {uri}", f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{sha}", f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if refers is not None:
        head += [f"WARC-Refers-To: {refers}", f"WARC-Profile: {PROFILE}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated piece by piece; only one record is held at a time."""
    z, parts, rest, open_member = zlib.decompressobj(31), [], b"", False
    while True:
        data = rest or stream.read(CHUNK)
        rest = b""
        if not data:
            break
        parts.append(z.decompress(data))
        open_member = True
        if z.eof:
            rest = z.unused_data
            yield b"".join(parts)
            z, parts, open_member = zlib.decompressobj(31), [], False
    if open_member:
        raise ValueError("the archive ends inside a record")


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Named fields (lower case) and the content block, framed by Content-Length."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    n = int(fields["content-length"])
    if len(rest) < n or rest[n:] != b"\r\n\r\n":
        raise ValueError("content length doesn't match the record")
    return fields, rest[:n]


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes (record_id, uri, date, payload, payload_digest, record_type, refers_to_id) as archives below ``folder``.

    Each task fills archives of about ROLL_BYTES, under names of its own attempt. What a lost attempt wrote is in no
    row that is returned, so nothing reads it. Returns (path, records).
    """
    schema = "path string, records long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, out, name, held, n = [], None, "", 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((name, n))
                out = None

        for batch in batches:
            for r in (r for a in range(0, len(batch), 64) for r in batch.slice(a, 64).to_pylist()):
                if out is None:
                    name, held, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = _open(name, "w")
                data = encode_record(r["record_type"], r["record_id"], r["uri"], r["date"], r["payload"], r["payload_digest"], r["refers_to_id"], r["size"])
                out.write(data)
                held, n = held + len(data), n + 1
                if held >= ROLL_BYTES:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], names=["path", "records"])

    if urlparse(folder).scheme in ("", "file"):
        os.makedirs(unquote(urlparse(folder).path), exist_ok=True)
    return records.mapInArrow(write, schema)


def read_archives(paths: DataFrame, with_content: bool = True) -> DataFrame:
    """Reads each archive named in ``paths`` (path, records) record by record: RECORD's columns.

    ``digest_ok`` tells whether the block digest, and for responses the payload digest, match what was read. A broken
    member, header or length raises, and so does an archive with more or fewer records than ``records`` says (null: not
    known), as one cut between two members would have. ``with_content`` off returns null content, for checks that need no payloads.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORD.split(", ")]
        kinds = [pa.string()] * 6 + [pa.int64(), pa.int64(), pa.bool_(), pa.binary()]
        rows, held = [], 0
        for batch in batches:
            for path, expected in zip(batch.column("path").to_pylist(), batch.column("records").to_pylist()):
                found = 0
                with _open(path, "r") as f:
                    for raw in members(f):
                        found += 1
                        h, block = parse_record(raw)
                        payload = block.partition(b"\r\n\r\n")[2]
                        http = dict(x.partition(b":")[::2] for x in block.partition(b"\r\n\r\n")[0].split(b"\r\n")[1:])
                        told = base64.b32decode(h["warc-payload-digest"].removeprefix("sha1:"))
                        ok = base64.b32encode(hashlib.sha1(block).digest()).decode() == h["warc-block-digest"].removeprefix("sha1:")
                        if h["warc-type"] == "response":
                            ok = ok and hashlib.sha1(payload).digest() == told
                        rows.append((h["warc-type"], h["warc-record-id"], h.get("warc-target-uri"), h.get("warc-date"), h.get("warc-refers-to"), told.hex(),
                                     int(http[b"Content-Length"]), len(block), ok, payload if with_content else None))
                        held += len(payload) if with_content else 100
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if expected is not None and found != expected:
                    raise ValueError(f"{path} has {found} records, not {expected}")
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return paths.select("path", "records").mapInArrow(read, RECORD)


def with_revisits(pages: DataFrame, key: str, payload: Column, work: Workspace) -> DataFrame:
    """Adds payload, size, payload_digest, record_type and refers_to.

    Of records with equal payloads (by length, SHA-1 and a second digest) of at least REVISIT_LEAST bytes, the one
    with the largest key is the response and the others revisit it; smaller ones are all responses. Maxima are taken
    with partial sums per digest, and only digests that occur twice come back to the rows: by broadcast up to
    BROADCAST_ROWS of them, else to (digest, key) alone with hot digests split, and then by key to the payloads. So a
    payload that a third of all pages share is neither gathered nor moved by its digest.
    """
    p = pages.withColumn("payload", payload).withColumns({
        "size": F.length("payload").cast("long"), "payload_digest": F.sha1("payload"), "_more": F.xxhash64("payload"),
    })
    group = ["payload_digest", "size", "_more"]
    least = p.filter(F.col("size") >= REVISIT_LEAST).select(*group, F.col(key))
    last = least.groupBy(*group).agg(F.max(key).alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    last = work.keep(last, "repeated")
    if last.count() <= BROADCAST_ROWS:
        p = p.join(F.broadcast(last), group, "left")
    else:
        ids = p.select(F.col(key).alias("_key"), F.struct(*group).alias("_group")).distinct()
        told = join_split(ids, last.select(F.struct(*group).alias("_group"), "_last"), "_group", "_key", work)
        p = p.withColumn("_id", F.struct(*group)).join(told, F.col(key).eqNullSafe(F.col("_key")) & (F.col("_id") == F.col("_group")), "left").drop("_id", "_group", "_key")
    later = F.col("_last").isNotNull() & ~F.col(key).eqNullSafe(F.col("_last"))
    return p.withColumns({
        "record_type": F.when(later, "revisit").otherwise("response"), "refers_to": F.when(later, F.col("_last")),
    }).drop("_last", "_more")


def warc_round_trip(pages: DataFrame, work: Workspace, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes a record per page into ``work`` and returns what the reader finds there, per page.

    Columns: key, payload_bytes, payload_digest, record_type, refers_to, url, digest_ok. Null html is an empty payload,
    a null url an empty one; a null key is written as an empty id and read back as null. Repeated rows give repeated
    records, of which those equal in key and payload are all of the same type. An empty table gives no rows. Line
    breaks in a url, which a header can't hold, are percent-coded.
    """
    spark, folder = pages.sparkSession, work.path("archives")
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    base = pages.select(F.col(key).cast("long").alias("key"), F.col(url).alias("url"), F.col(html).alias("html"))
    typed = with_revisits(base.select("key", "url", payload.alias("payload")), "key", F.col("payload"), work)
    name = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    records = typed.select(
        name(F.col("key")).alias("record_id"),
        F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")).alias("uri"),
        F.lit("2024-01-01T00:00:00Z").alias("date"),
        F.when(F.col("record_type") == "response", F.col("payload")).alias("payload"), "size", "payload_digest", "record_type",
        F.when(F.col("refers_to").isNotNull(), name(F.col("refers_to"))).alias("refers_to_id"),
    )
    written = write_archives(records, folder)
    manifest = f"{folder}/manifest"
    written.write.mode("overwrite").parquet(manifest)
    files = spark.read.schema(written.schema).parquet(manifest)
    back = read_archives(files.repartition(max(1, spark.sparkContext.defaultParallelism * 2), "path"), with_content=False)
    number = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    as_id = lambda c: F.when(number(F.col(c)) != "", number(F.col(c)).cast("long"))
    return back.select(
        as_id("record_id").alias(key), F.col("payload_length").alias("payload_bytes"), "payload_digest",
        F.col("warc_type").alias("record_type"), as_id("refers_to_uri").alias("refers_to"), F.col("target_uri").alias("url"), "digest_ok",
    )
