"""WARC archives with an index of byte ranges, written and read back."""

from __future__ import annotations

import base64
import gzip
import hashlib
import uuid
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, forget, join_dealt, map_texts, new_path, table, utf8

#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 0
#: A new archive begins after so many bytes; ranges of one task lie in so many bytes of one archive.
ARCHIVE_BYTES, TASK_BYTES = 256 << 20, 32 << 20
#: Ranges closer than GAP are one read, of READ bytes at most (a larger record is a read of its own).
GAP, READ = 64 << 10, 8 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = "page_id long, url string, digest string, type string, file string, offset long, length long"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _store(base: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(base)


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(urn: str | None) -> int | None:
    value = None if urn is None else urn[len("<urn:page:") : -1]
    return None if value in (None, "none") else int(value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {_urn(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{payload_digest(payload)}"]
    if refers_to is not None:
        lines += [f"WARC-Refers-To: {_urn(refers_to)}", f"WARC-Profile: {PROFILE}"]
    block = head + payload if refers_to is None else head
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n", 6, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC fields by lower-case name, the HTTP head and the payload of one record; lengths are checked."""
    raw = gzip.decompress(member)
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    size = int(fields["content-length"])
    if lines[0] != "WARC/1.1" or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"broken WARC record {fields.get('warc-record-id')}")
    http, _, payload = rest[:size].partition(b"\r\n\r\n")
    return fields, http, payload


def _write(base: str, batches):
    """Archives of this attempt have names of their own; those of lost attempts are in no index."""
    store, path = _store(base)
    out, file, offset = None, "", 0
    try:
        for batch in batches:
            rows = []
            for page_id, url, html, refers_to in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = utf8(html)
                member = record(page_id, url, payload, refers_to)
                if out is None or offset >= ARCHIVE_BYTES:
                    if out is not None:
                        out.close()
                    file, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                    store.create_dir(path, recursive=True)
                    out = store.open_output_stream(f"{path}/{file}", compression=None)  # members are compressed already
                out.write(member)
                rows.append((page_id, url, payload_digest(payload), "response" if refers_to is None else "revisit", file, offset, len(member)))
                offset += len(member)
            columns = list(zip(*rows, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["page_id", "url", "digest", "type", "file", "offset", "length"])
    finally:
        if out is not None:
            out.close()


def write(pages: DataFrame, base: str, least: int = LEAST_BYTES) -> DataFrame:
    """Write archives under `base`, a folder that all executors share; returns their index, a written table.

    pages has page_id, url and html. Of records with equal payloads of `least` bytes or more, that of the largest
    page_id is the response and the others revisit it. Null html is an empty payload and null url an empty target;
    records of null page_id revisit like any, and are responses where no other has their payload; rows that repeat a
    page_id with its payload are responses alike; no rows make no archive. Other columns are never read. Records of a
    very common payload are dealt to several tasks.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("key", F.sha2("html", 256))
    first = cut(rows.where(F.octet_length("html") >= least).groupBy("key").agg(F.max("page_id").alias("response"), F.count(F.lit(1)).alias("n")), "responses")
    rows = join_dealt(rows, first, "key", F.xxhash64("page_id", "url"), "left")
    refers = F.when(F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response")), F.col("response"))
    out = cut(map_texts(rows.select("page_id", "url", "html", refers.alias("refers_to")), partial(_write, base), INDEX), "warc-index")
    forget(first)
    return out


def _ranges(rows):
    """Runs of index rows, in order, that one read fetches."""
    run, first, end = [], 0, 0
    for row in rows:
        file, offset, length = row
        if run and (file != run[0][0] or offset - end > GAP or offset + length - first > READ):
            yield run, first, end
            run = []
        if not run:
            first, end = offset, offset
        run.append(row)
        end = max(end, offset + length)
    if run:
        yield run, first, end


def _read(base: str, batches):
    store, path = _store(base)
    file, source = None, None
    kinds = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64())
    for batch in batches:
        for run, first, end in _ranges(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
            if run[0][0] != file:
                if source is not None:
                    source.close()
                file, source = run[0][0], store.open_input_file(f"{path}/{run[0][0]}")
            data = source.read_at(end - first, first)
            rows = []
            for _, offset, length in run:
                fields, http, payload = parse(data[offset - first : offset - first + length])
                digest = fields["warc-payload-digest"].removeprefix("sha1:")
                full = fields["warc-type"] == "response"
                if full and payload_digest(payload) != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} has another digest")
                size = next(int(x[16:]) for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))
                if full and size != len(payload):
                    raise ValueError(f"payload of {fields['warc-record-id']} has another length")
                rows.append((_page(fields["warc-record-id"]), fields["warc-target-uri"], digest, fields["warc-type"], size, payload if full else None, _page(fields.get("warc-refers-to"))))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["page_id", "url", "digest", "type", "payload_bytes", "payload", "refers_to"])
    if source is not None:
        source.close()


def read(index: DataFrame, base: str, payloads: bool = True) -> DataFrame:
    """The records that rows of an index name: page_id, url, digest, type, payload_bytes, payload, refers_to.

    Rows are dealt by archive and stretch of it and sorted by offset, and near ranges are read together. Digests and
    lengths are checked; a broken record stops the run. Without `payloads`, that column is left out.
    """
    rows = index.select("file", "offset", "length", F.floor(F.col("offset") / TASK_BYTES).alias("stretch"))
    rows = rows.repartition("file", "stretch").sortWithinPartitions("file", "offset").select("file", "offset", "length")
    out = map_texts(rows, partial(_read, base), "page_id long, url string, digest string, type string, payload_bytes long, payload binary, refers_to long")
    return out if payloads else out.drop("payload")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = new_path(spark, "warc")
    index = write(table(spark, sf_dir, "pages"), base)
    return read(index, base, payloads=False).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS d, max(page_id) OVER (PARTITION BY html) AS r FROM p),
b AS (SELECT *, array_to_string(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        (((('0x' || substr(d, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))::INT) & 31) + 1)::INT, 1)), '') AS b32 FROM h)
SELECT page_id, n::BIGINT AS payload_bytes, b32 AS payload_digest, CASE WHEN n >= {LEAST_BYTES} AND page_id <> r THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= {LEAST_BYTES} AND page_id <> r THEN r END AS refers_to FROM b
"""
