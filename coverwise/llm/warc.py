"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page id; every task writes the records of its range
into gzip members (one per record) and rolls to a new file when the compressed
size passes a limit. Headers and digests are regenerated from the payload: the
record id is a UUID of page id and payload digest, the date is a fixed argument, and gzip
members carry no time, so the same table and number of shards give the same bytes.

Equal payloads of at least 1000 bytes are written once: the record with the
largest page id is a ``response``; every other one is a ``revisit`` (profile
identical-payload-digest) that names the response and carries no payload.

Commit: a task writes under a name of its own attempt and reports (shard, file,
size, checksum, records). The manifest of reports is itself a table that Spark commits, so
exactly one attempt of each task is in it. Only files in the manifest are renamed
to their final names, and only then is the manifest published as
``manifest.json``. A lost executor or a speculative attempt leaves nothing but an
unnamed temporary file, which the commit removes.

Defined results: null html is an empty payload; payloads under 1000 bytes are all
responses; of several rows with the same page id and payload, one is the response
and the others revisit it; a null page id is written with an empty id header and read back
as null; an empty table gives no file and an empty manifest; extra columns are ignored.
"""
from __future__ import annotations

import gzip
import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_path, partitions, save

MIN_REVISIT_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
ROLL_BYTES = 32 << 20
#: A shard is about this much payload.
SHARD_BYTES = 16 << 20

MANIFEST = "shard int, seq int, temp string, bytes long, crc32 long, records long"
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary")

_CRLF = b"\r\n"


def open_folder(uri: str):
    """File system and path of a folder that the driver and all executors share."""
    from pyarrow import fs
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri("file://" + uri[5:] if uri.startswith("file:/") and not uri.startswith("file://") else uri)


# ---------------------------------------------------------------- records

def http_block(payload: bytes, full_length: int) -> bytes:
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % full_length
    return head + payload


def record_bytes(page_id, url, payload: bytes | None, digest: str, length: int, refers_to, date: str = DATE) -> bytes:
    """One WARC/1.1 record. ``payload`` None makes it a revisit of ``refers_to``."""
    def rid(p, d):
        return "<urn:uuid:%s>" % uuid.uuid5(uuid.NAMESPACE_OID, f"{p}/{d}")

    revisit = payload is None
    block = http_block(b"" if revisit else payload, length)
    head = [("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", rid(page_id, digest)),
            ("WARC-Date", date),
            ("WARC-Target-URI", (url or "").replace("\r", "%0D").replace("\n", "%0A")),
            ("WARC-Page-ID", "" if page_id is None else str(page_id)),
            ("WARC-Payload-Digest", "sha1:" + digest),
            ("WARC-Block-Digest", "sha1:" + hashlib.sha1(block).hexdigest())]
    if revisit:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
                 ("WARC-Refers-To", rid(refers_to, digest)),
                 ("WARC-Refers-To-Page-ID", "" if refers_to is None else str(refers_to))]
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    lines = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head) + "\r\n"
    return lines.encode() + block + _CRLF + _CRLF


def parse_record(data: bytes) -> dict:
    """The inverse of :func:`record_bytes`; checks the block digest and, of responses, the payload digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    if "sha1:" + hashlib.sha1(block).hexdigest() != h["WARC-Block-Digest"]:
        raise ValueError(f"damaged record of page {h['WARC-Page-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(http.rsplit(b"Content-Length: ", 1)[1])
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    kind = h["WARC-Type"]
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"payload of page {h['WARC-Page-ID']} does not match its digest")
    number = lambda x: int(x) if x else None
    return {"page_id": number(h["WARC-Page-ID"]), "url": h["WARC-Target-URI"], "payload_bytes": length,
            "payload_digest": digest, "record_type": kind,
            "refers_to": number(h.get("WARC-Refers-To-Page-ID")) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


# ---------------------------------------------------------------- writing

def _writer(folder: str, roll_bytes: int, date: str):
    """mapInArrow function: rows sorted by (page id, is-the-page) of one shard -> manifest rows.

    A decision row (no html, ``refers_to`` set) precedes the page row it speaks of.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        ctx = TaskContext.get()
        shard, attempt = ctx.partitionId(), ctx.taskAttemptId()
        filesystem, base = open_folder(folder)
        out = {k: [] for k in ("shard", "seq", "temp", "bytes", "crc32", "records")}
        sink, size, crc, n, seq = None, 0, 0, 0, 0

        def close():
            nonlocal sink, size, crc, n, seq
            if sink is not None:
                sink.close()
                for k, v in zip(out, (shard, seq, name, size, crc, n)):
                    out[k].append(v)
                sink, size, crc, n, seq = None, 0, 0, 0, seq + 1

        told = None  # (page id, digest, refers_to): decisions for the page that follows
        here, seen = None, set()  # digests whose response was written under the current page id
        for batch in batches:
            cols = {c: batch.column(c) for c in batch.schema.names}
            for i in range(batch.num_rows):
                page, digest = cols["page_id"][i].as_py(), cols["digest"][i].as_py()
                if not cols["is_page"][i].as_py():
                    if told is None or told[0] != page:
                        told = (page, {})
                    told[1][digest] = cols["refers_to"][i].as_py()
                    continue
                if told is not None and told[0] != page:
                    told = None
                if page != here:
                    here, seen = page, set()
                html = cols["html"][i].as_buffer()
                payload = html.to_pybytes() if html is not None else b""
                target, revisit = None, False
                if told is not None and digest in told[1]:
                    target, revisit = told[1][digest], True
                elif len(payload) >= MIN_REVISIT_BYTES:
                    if digest in seen:
                        target, revisit = page, True
                    seen.add(digest)
                data = gzip.compress(record_bytes(page, cols["url"][i].as_py(), None if revisit else payload,
                                                  digest, len(payload), target, date), 6, mtime=0)
                if sink is not None and size + len(data) > roll_bytes:
                    close()
                if sink is None:
                    name = f"_temporary/{shard:06d}-{seq:04d}-{attempt}.warc.gz"
                    sink = filesystem.open_output_stream(f"{base}/{name}", compression=None)
                sink.write(data)
                size, crc, n = size + len(data), zlib.crc32(data, crc), n + 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["seq"], pa.int32()),
                                          pa.array(out["temp"], pa.string()), *(pa.array(out[k], pa.int64()) for k in ("bytes", "crc32", "records"))],
                                         names=list(out))
    return write


def write_warc(pages: DataFrame, folder: str | None = None, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", n_shards: int | None = None, roll_bytes: int = ROLL_BYTES,
               date: str = DATE) -> tuple[str, DataFrame]:
    """Write ``pages`` as WARC files into ``folder`` (a new one below the shared checkpoint
    folder by default). Returns the folder and the manifest: shard, seq, file, bytes, crc32, records.

    Payloads are shuffled once, by the range sort. Which pages revisit which is worked out
    on (id, digest) pairs alone; the decisions then ride along in the same sort.
    """
    spark = pages.sparkSession
    folder = (folder or new_path(spark, "warc")).rstrip("/")
    filesystem, base = open_folder(folder)
    filesystem.create_dir(f"{base}/_temporary", recursive=True)
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"),
                     F.coalesce(F.col(html_col), F.lit("")).cast("binary").alias("html"))
    light = save(p.select("page_id", F.sha1("html").alias("digest"), F.octet_length("html").cast("long").alias("n")), "warc-digests")
    groups = (light.where(F.col("n") >= MIN_REVISIT_BYTES).groupBy("digest")
              .agg(F.max("page_id").alias("refers_to"), F.count("*").alias("times")).where("times > 1").drop("times"))
    decisions = (light.where(F.col("n") >= MIN_REVISIT_BYTES).join(groups, "digest")
                 .where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "digest", "refers_to").distinct())
    n_shards = n_shards or max(partitions(spark), -(-int(light.agg(F.sum("n")).first()[0] or 0) // SHARD_BYTES))
    rows = (p.select("page_id", F.lit(True).alias("is_page"), F.sha1("html").alias("digest"), "url", "html",
                     F.lit(None).cast("long").alias("refers_to"))
            .unionByName(decisions.withColumn("is_page", F.lit(False)), allowMissingColumns=True)
            .repartitionByRange(n_shards, "page_id").sortWithinPartitions("page_id", "is_page", "digest", "url"))
    manifest = save(rows.mapInArrow(_writer(folder, roll_bytes, date), MANIFEST), "warc-manifest")
    files = sorted(manifest.collect())  # one row per file
    for f in files:
        filesystem.move(f"{base}/{f['temp']}", f"{base}/{final_name(f['shard'], f['seq'])}")
    filesystem.delete_dir(f"{base}/_temporary")
    listing = [{"file": final_name(f["shard"], f["seq"]), "bytes": f["bytes"], "crc32": f["crc32"], "records": f["records"]} for f in files]
    with filesystem.open_output_stream(f"{base}/manifest.json") as out:
        out.write(json.dumps({"date": date, "files": listing}).encode())
    return folder, manifest.select("shard", "seq", F.format_string("part-%06d-%04d.warc.gz", "shard", "seq").alias("file"),
                                   "bytes", "crc32", "records")


def final_name(shard: int, seq: int) -> str:
    return f"part-{shard:06d}-{seq:04d}.warc.gz"


# ---------------------------------------------------------------- reading

def _members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time."""
    buf = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            if not buf:
                buf = stream.read(1 << 18)
                if not buf:
                    if parts:
                        raise ValueError("truncated archive")
                    return
            parts.append(d.decompress(buf))
            buf = d.unused_data if d.eof else b""
        yield b"".join(parts)


class _Checked:
    """A stream that keeps the checksum of what was read."""

    def __init__(self, raw: io.RawIOBase):
        self.raw, self.crc = raw, 0

    def read(self, n: int) -> bytes:
        data = self.raw.read(n)
        self.crc = zlib.crc32(data, self.crc)
        return data


def _reader(folder: str, with_payload: bool):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filesystem, base = open_folder(folder)
        fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                  ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())]

        def flush(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in fields], names=[k for k, _ in fields])

        for batch in batches:
            for f in batch.to_pylist():
                rows, held, n = [], 0, 0
                with filesystem.open_input_stream(f"{base}/{f['file']}", compression=None) as raw:
                    stream = _Checked(raw)
                    for data in _members(stream):
                        r = parse_record(data)
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        n += 1
                        held += len(data) if with_payload else 300
                        if held > 4 << 20:
                            yield flush(rows)
                            rows, held = [], 0
                if stream.crc != f["crc32"] or n != f["records"]:
                    raise ValueError(f"{f['file']} is not the file of the manifest")
                if rows:
                    yield flush(rows)
    return read


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records of the manifest's files, files dealt evenly over tasks; checksums are verified."""
    files = manifest.select("file", "crc32", "records")
    # one row per file: each file is its own unit of work
    return files.repartition(partitions(spark), "file").mapInArrow(_reader(folder, with_payload), RECORDS)


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha1(b) AS payload_digest FROM p),
m AS (SELECT payload_digest, max(page_id) AS refers_to FROM d WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN refers_to > page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN refers_to > page_id THEN refers_to END AS refers_to
FROM d LEFT JOIN m USING (payload_digest)
"""
