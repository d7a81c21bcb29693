"""WARC archives: a writer with one gzip member a record, and a splittable reader.

Reading deals byte ranges of the files to tasks. A task scans its range for the gzip magic, takes a candidate for a
member if what it inflates to starts with WARC headers, and owns the records that start inside its range; it reads past
the range's end for the last one. Behind a record the next one is expected at once; where none is (damage, padding),
the scan goes on byte by byte, so a damaged member costs no other record, and the work stays in proportion to the bytes.

Members of an archive stored inside a payload look like records too. A file starts with a ``warcinfo`` record, and its
records name that one's id (WARC-Warcinfo-ID, a new UUID for each file): a candidate whose headers name another file's
is none, and is left after its headers. Files whose first record isn't such a warcinfo are not split: the task of the
first range reads them from their start, where records follow each other; behind damage in such a file, records of an
archive stored in a damaged payload can't be told from its own and are given out.

Writing: tasks write files under names of their own, and only the files of successful attempts are listed in the
manifest that the reader takes, so lost executors and repeated attempts leave no record twice. Payloads that others
equal are stored once: the record of the smallest id is a response, the others are revisits that refer to it.

Null payloads are empty ones. Records without an id are responses that others don't refer to. Records that agree in
id and payload are all responses (a record can't revisit itself). An empty table makes an empty archive. A record is
held whole by its task, a very long payload too. Columns besides those named are neither written nor read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliomill.llm.shared import filesystem, shared_dir, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
SPLIT_BYTES = 8 << 20
READ_BYTES = 1 << 20
#: What has no end of headers in so many bytes is no record.
HEADER_BYTES = 1 << 20
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes long, payload binary"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(record_id: str, record_type: str, uri: str, sha1: str, payload: bytes, refers_to: str | None = None, file_id: str | None = None) -> bytes:
    """One record as a gzip member. A revisit keeps the HTTP headers, with the payload's length, and drops the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{record_id}>", *[f"WARC-Warcinfo-ID: <{file_id}>"] * bool(file_id), "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_line(uri)}", f"WARC-Payload-Digest: sha1:{sha1}", "Content-Type: application/http; msgtype=response"]
    if record_type == "revisit":
        head += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return _member(head, block)


def warcinfo(file_id: str) -> bytes:
    """The record that a file starts with."""
    return _member(["WARC-Type: warcinfo", f"WARC-Record-ID: <{file_id}>", "WARC-Date: 1970-01-01T00:00:00Z", "Content-Type: application/warc-fields"], b"format: WARC File Format 1.1\r\n")


def _member(head: list[str], block: bytes) -> bytes:
    raw = "\r\n".join(["WARC/1.1", *head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"
    gz = zlib.compressobj(6, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def _line(x: str) -> str:
    return x.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(x: str) -> str:
    return x.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def write(rows: DataFrame, folder: str, file_bytes: int = 256 << 20) -> DataFrame:
    """Archive ``rows`` (record_id, record_type, uri, sha1, refers_to: strings; payload: binary); returns the manifest: path, bytes, records."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = filesystem(folder)
        store.create_dir(top, recursive=True)
        out, name, file_id, size, n = None, "", "", 0, 0
        done = []
        for batch in batches:
            for r in batch.to_pylist():
                if out is None:
                    file_id, name = f"urn:uuid:{uuid.uuid4()}", f"{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(f"{top}/{name}", compression=None)  # the name would have it compress again
                    first = warcinfo(file_id)
                    out.write(first)
                    size, n = len(first), 0
                member = record(r["record_id"], r["record_type"], r["uri"] or "", r["sha1"], r["payload"], r["refers_to"], file_id)
                out.write(member)
                size, n = size + len(member), n + 1
                if size >= file_bytes:
                    out.close()
                    done.append((f"{folder}/{name}", size, n))
                    out = None
        if out is not None:
            out.close()
            done.append((f"{folder}/{name}", size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done, strict=True)], names=["path", "bytes", "records"])

    return stored(rows.select("record_id", "record_type", "uri", "sha1", "refers_to", "payload").mapInArrow(task, "path string, bytes long, records long"), "warc-manifest")


class _Window:
    """Bytes of a file from anywhere, read in pieces; what lies before the last place asked for is forgotten."""

    def __init__(self, source, size: int, at: int):
        self.source, self.size, self.at, self.data = source, size, at, b""

    def get(self, start: int, n: int) -> bytes:
        if start < self.at:
            self.at, self.data = start, b""
        if start + n > self.at + len(self.data):
            keep = self.data[start - self.at :] if start <= self.at + len(self.data) else b""
            self.at, self.data = start, keep
            want = min(self.size, start + max(n, READ_BYTES)) - (start + len(keep))
            if want > 0:
                self.source.seek(start + len(keep))
                self.data = keep + self.source.read(want)
        return self.data[start - self.at : start - self.at + n]


def _headers(raw: bytes) -> tuple[dict[str, str], int] | None:
    """(headers, place of the block); None if these aren't whole WARC headers."""
    end = raw.find(b"\r\n\r\n")
    if end < 0 or not raw.startswith(VERSION):
        return None
    try:
        headers = dict((k.strip().lower(), v.strip()) for k, _, v in (x.partition(":") for x in raw[:end].decode().split("\r\n")[1:]))
        return (headers, end + 4) if "warc-type" in headers and int(headers["content-length"]) >= 0 else None
    except (ValueError, KeyError):
        return None


def member(window: _Window, start: int, file_id: str | None = None) -> tuple[dict[str, str], bytes, int] | None:
    """(headers, block, place after it) of the member at ``start``; None if there is no whole record (of ``file_id``)."""
    gz, raw, at = zlib.decompressobj(31), bytearray(), start
    found = None
    while not gz.eof:
        piece = window.get(at, 1 << 16 if found else 1 << 10)
        if not piece:
            return None
        try:
            raw += gz.decompress(piece)
        except zlib.error:
            return None
        at += len(piece)
        if found is None:
            if not raw.startswith(VERSION[: len(raw)]):
                return None
            found = _headers(bytes(raw))
            if found and file_id and found[0].get("warc-warcinfo-id") != f"<{file_id}>" and found[0].get("warc-record-id") != f"<{file_id}>":
                return None
            if found is None and (len(raw) > HEADER_BYTES or b"\r\n\r\n" in raw):
                return None
    if found is None:
        return None
    headers, begin = found
    n = int(headers["content-length"])
    return (headers, bytes(raw[begin : begin + n]), at - len(gz.unused_data)) if len(raw) >= begin + n else None


def file_of(source, size: int) -> str | None:
    """The id of the file's warcinfo record, if it starts with one."""
    first = member(_Window(source, size, 0), 0)
    return first[0].get("warc-record-id", "").strip("<>") or None if first and first[0]["warc-type"] == "warcinfo" else None


def records(source, size: int, start: int, end: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and blocks of the records that start in [start, end) of a file, without its warcinfo."""
    file_id = file_of(source, size)
    second = member(_Window(source, size, 0), member(_Window(source, size, 0), 0)[2]) if file_id else None
    if file_id is None or (second and second[0].get("warc-warcinfo-id") != f"<{file_id}>"):
        file_id = None
        if start:
            return
        end = size
    window, at = _Window(source, size, start), start
    while at < end:
        found = member(window, at, file_id) if window.get(at, len(MAGIC)) == MAGIC else None
        if found is not None:
            headers, block, at = found
            if headers["warc-type"] != "warcinfo":
                yield headers, block
            continue
        piece = window.get(at + 1, READ_BYTES)
        hit = piece.find(MAGIC)
        if not piece:
            return
        at = at + 1 + hit if hit >= 0 else at + 1 + max(1, len(piece) - len(MAGIC) + 1)


def parsed(headers: dict[str, str], block: bytes) -> dict:
    http, _, body = block.partition(b"\r\n\r\n")
    said = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in http.decode("latin-1").split("\r\n")[1:])}
    ident = lambda x: x and x.removeprefix("<urn:page:").removesuffix(">")
    sha1 = headers.get("warc-payload-digest", "").removeprefix("sha1:")
    revisit = headers["warc-type"] == "revisit"
    if not revisit and sha1 and digest(body) != sha1:
        raise ValueError(f"record {headers.get('warc-record-id')}: payload and digest differ")
    return {"record_id": ident(headers.get("warc-record-id")), "record_type": headers["warc-type"], "target_uri": _unline(headers.get("warc-target-uri", "")), "refers_to": ident(headers.get("warc-refers-to")), "payload_digest": sha1, "payload_bytes": int(said.get("content-length", len(body))), "payload": None if revisit else body}


def read(manifest: DataFrame, split_bytes: int = SPLIT_BYTES, payloads: bool = True) -> DataFrame:
    """Records of the files in ``manifest`` (path, bytes), by byte ranges of ``split_bytes``; without ``payloads`` that column is null."""
    schema = [x.split()[0] for x in RECORD.split(", ")]
    types = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                store, path = filesystem(r["path"])
                rows, held = [], 0
                with store.open_input_file(path) as source:
                    for headers, block in records(source, r["bytes"], r["start"], min(r["bytes"], r["start"] + split_bytes)):
                        row = parsed(headers, block)
                        if not payloads:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"") + 300
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, types)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, types)

    ranges = manifest.where("bytes > 0").select("path", "bytes", F.explode(F.expr(f"sequence(0L, bytes - 1, {split_bytes}L)")).alias("start"))
    # A range a task, whatever the files: each has a number of its own.
    n = max(1, manifest.select(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1)
    ranges = ranges.repartition(min(int(n), 100_000), "path", "start")
    return ranges.mapInArrow(task, RECORD).select(*schema)


def base32_sha1(payload):
    """The digest as built-in expressions: base-32 digits of the hash, forty bits at a time."""
    hexed = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(hexed, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def archived(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = 0) -> DataFrame:
    """Write a record for each page; equal payloads of at least ``least`` bytes are stored once. Returns the manifest."""
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    df = pages.select(F.col(page_id).cast("string").alias("record_id"), F.col(page_id).alias("id"), F.col(url).alias("uri"), payload.alias("payload"))
    df = df.withColumn("sha1", base32_sha1(F.col("payload")))
    total = df.count()
    firsts = df.where((F.length("payload") >= least) & F.col("id").isNotNull()).groupBy("sha1").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    # Only payloads that occur twice need the table; the rest keeps its place.
    firsts = stored(firsts.where("n > 1"), "warc-first")
    hot = F.broadcast(firsts.where(F.col("n") * 1000 > F.lit(total)).select("sha1", F.col("first").alias("hot")))  # 1000 rows at most
    df = df.join(hot, "sha1", "left")
    df = df.withColumn("k", F.when(F.col("hot").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("~"), F.col("record_id"))))
    df = df.join(firsts.where(F.col("n") * 1000 <= F.lit(total)).select(F.col("sha1").alias("k"), "first"), "k", "left")
    first = F.coalesce("hot", "first")
    again = (F.length("payload") >= least) & F.col("id").isNotNull() & first.isNotNull() & (first != F.col("id"))
    df = df.withColumn("record_type", F.when(again, "revisit").otherwise("response")).withColumn("refers_to", F.when(again, first.cast("string")))
    return write(df.withColumn("record_id", F.coalesce("record_id", F.lit(""))), folder)


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    found = read(archived(pages, shared_dir(spark, "warc")), payloads=False)
    return found.select(F.expr("try_cast(nullif(record_id, '') as bigint)").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to as bigint)").alias("refers_to"))


OP1_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, cast(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS first FROM p),
d AS (SELECT *, list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[cast((cast('0x' || substr(x, cast(1 + 10 * (i // 8) AS BIGINT), 10) AS BIGINT) >> cast(35 - 5 * (i % 8) AS BIGINT)) & 31 AS BIGINT) + 1]) AS c FROM q)
SELECT page_id, payload_bytes, array_to_string(c, '') AS payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM d
"""
