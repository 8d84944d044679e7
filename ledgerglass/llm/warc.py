"""WARC archives as a PySpark data source, format `warc`.

Reading: files are packed into partitions by size; filters on record type and
header columns are pushed into the reader, which inflates a record no further
than its headers until it knows that the record is wanted. With the option
`payload` set to `none`, or for records that a filter rejects, the rest is
skipped: by the length in the gzip member's `sl` field where it has one, by
inflating without keeping anything otherwise.

Writing: every record is a gzip member of its own, with an `sl` field. A task
writes under a temporary name; only the files of successful attempts are
renamed into place, when the whole job commits.
"""

from __future__ import annotations

import base64
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, StringStartsWith, WriterCommitMessage

from .common import fresh_path, join_by_size, small_batches, written

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, headers map<string,string>, payload binary"
_ARROW = pa.schema([*((n, pa.string()) for n in ("record_type", "record_id", "target_uri", "date", "refers_to", "payload_digest")), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary())])
#: Columns that come from a header; only these take filters.
_HEADER = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_CHUNK = 1 << 16
_BATCH_BYTES = 4 << 20
_FAR = 1 << 30


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it, for a plain path or a URI."""
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def _value(column: str, raw: str | None) -> str | None:
    if raw is None:
        return None
    if column in ("record_id", "refers_to"):
        return raw.strip("<>")
    if column == "payload_digest" and raw.lower().startswith("sha1:"):
        digits = raw[5:]
        return (base64.b32decode(digits.upper()).hex() if len(digits) == 32 else digits.lower())
    return raw


class _Wanted:
    """The pushed filters, as tests on a record's parsed headers."""

    def __init__(self) -> None:
        self.tests: list[tuple[str, str, object]] = []

    def take(self, f) -> bool:
        column = f.attribute[0] if len(f.attribute) == 1 else None
        if column not in _HEADER:
            return False
        if isinstance(f, EqualTo):
            self.tests.append((column, "in", frozenset([f.value])))
        elif isinstance(f, In):
            self.tests.append((column, "in", frozenset(f.value)))
        elif isinstance(f, IsNotNull):
            self.tests.append((column, "set", None))
        elif isinstance(f, StringStartsWith):
            self.tests.append((column, "starts", f.value))
        else:
            return False
        return True

    def __call__(self, headers: dict[str, str]) -> bool:
        for column, how, value in self.tests:
            x = _value(column, headers.get(_HEADER[column]))
            if x is None or (how == "in" and x not in value) or (how == "starts" and not x.startswith(value)):
                return False
        return True


def parse_headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    out = {"": lines[0]}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


class _Buffered:
    """Reads forward over a file, inflated member by member or plain."""

    def __init__(self, stream):
        self.stream, self.data, self.ended = stream, b"", False

    def fill(self, n: int) -> bool:
        while len(self.data) < n and not self.ended:
            got = self.stream.read(max(_CHUNK, n - len(self.data)))
            self.ended = not got
            self.data += got
        return len(self.data) >= n

    def drop(self, n: int) -> None:
        if n <= len(self.data):
            self.data = self.data[n:]
        else:
            self.stream.seek(self.stream.tell() + n - len(self.data))
            self.data = b""


def _gzip_records(src: _Buffered, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    while src.fill(18):
        if src.data[:2] != b"\x1f\x8b":
            raise ValueError("not a gzip member")
        size, at = None, 10
        if src.data[3] & 4:
            extra = struct.unpack_from("<H", src.data, 10)[0]
            src.fill(12 + extra)
            field, at = src.data[12 : 12 + extra], 12 + extra
            while len(field) >= 4:
                n = struct.unpack_from("<H", field, 2)[0]
                if field[:2] == b"sl" and n == 8:
                    size = struct.unpack_from("<I", field, 4)[0]
                field = field[4 + n :]
        for flag in (8, 16):  # file name and comment end with a zero byte
            if src.data[3] & flag:
                while (end := src.data.find(b"\0", at)) < 0 and src.fill(len(src.data) + 1):
                    pass
                at = end + 1
        at += 2 if src.data[3] & 2 else 0
        inflate = zlib.decompressobj(-15)
        out, fed = b"", at
        headers = None
        keep = True

        def more() -> bool:
            """Inflate one more chunk; False when the member is over."""
            nonlocal out, fed
            if inflate.eof:
                return False
            if not src.fill(fed + 1):
                raise ValueError("a record ends early")
            chunk = src.data[fed : fed + _CHUNK]
            got = inflate.decompress(chunk, 4096 if headers is None else _FAR)
            fed += len(chunk) - len(inflate.unused_data if inflate.eof else inflate.unconsumed_tail)
            out = out + got if keep else b""
            return True

        while (end := out.find(b"\r\n\r\n")) < 0 and more():
            pass
        headers = parse_headers(out[: max(end, 0)])
        good = wanted(headers)
        length = int(headers.get("content-length", "0"))
        need_head = good and not payload  # the HTTP headers tell the payload's size
        while good and len(out) < end + 4 + length and (payload or out.find(b"\r\n\r\n", end + 4) < 0) and more():
            pass
        block = out[end + 4 : end + 4 + length] if good else None
        if size is not None:
            src.drop(size)
        else:
            keep = False
            while more():
                pass
            src.drop(fed + 8)
        if good:
            yield headers, block[: block.find(b"\r\n\r\n") + 4] if need_head else block


def _plain_records(src: _Buffered, wanted, payload: bool) -> Iterator[tuple[dict, bytes | None]]:
    while src.fill(1):
        while (end := src.data.find(b"\r\n\r\n")) < 0:
            if not src.fill(len(src.data) + 1):
                if src.data.strip():
                    raise ValueError("a record ends early")
                return
        headers = parse_headers(src.data[:end].lstrip())
        length = int(headers.get("content-length", "0"))
        if not wanted(headers):
            src.drop(end + 4 + length + 4)
            continue
        take = length if payload else min(length, 1 << 13)
        src.fill(end + 4 + take)
        block = src.data[end + 4 : end + 4 + take]
        src.drop(end + 4 + length + 4)
        yield headers, block if payload else block[: block.find(b"\r\n\r\n") + 4]


def read_records(stream, wanted=lambda h: True, payload: bool = True) -> Iterator[tuple[dict, bytes | None]]:
    """(headers, block) of the wanted records of an open file; of the block only the HTTP headers without `payload`."""
    src = _Buffered(stream)
    if not src.fill(1):
        return iter(())
    return (_gzip_records if src.fill(2) and src.data[:2] == b"\x1f\x8b" else _plain_records)(src, wanted, payload)


def _row(headers: dict[str, str], block: bytes, payload: bool) -> dict:
    row = {c: _value(c, headers.get(h)) for c, h in _HEADER.items()}
    row["headers"] = [(k, v) for k, v in headers.items() if k]
    body, size = block, int(headers.get("content-length", "0"))
    if headers.get("content-type", "").startswith("application/http"):
        head, _, body = block.partition(b"\r\n\r\n")
        http = parse_headers(head)
        size = int(http.get("content-length", size - len(head) - 4))
    row["payload_bytes"] = size
    row["payload"] = body if payload and row["record_type"] != "revisit" else None
    return row


class _Files(InputPartition):
    def __init__(self, paths: list[str]):
        super().__init__(paths)
        self.paths = paths


class WarcReader(DataSourceReader):
    def __init__(self, options):
        self.files = json.loads(options["files"])
        self.target = int(options.get("partitionbytes", 64 << 20))
        self.payload = options.get("payload", "all") != "none"
        self.wanted = _Wanted()

    def pushFilters(self, filters):
        for f in filters:
            if not self.wanted.take(f):
                yield f

    def partitions(self):
        packed: list[_Files] = []
        paths, total = [], 0
        for path, size in sorted(self.files, key=lambda x: -x[1]):
            if paths and total + size > self.target:
                packed.append(_Files(paths))
                paths, total = [], 0
            paths.append(path)
            total += size
        if paths:
            packed.append(_Files(paths))
        return packed or [_Files([])]

    def read(self, partition):
        rows, held = [], 0
        for path in partition.paths:
            system, inside = filesystem(path)
            with system.open_input_file(inside) as stream:
                for headers, block in read_records(stream, self.wanted, self.payload):
                    rows.append(_row(headers, block, self.payload))
                    held += len(block) + 500
                    if held > _BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, _ARROW)


class _Wrote(WriterCommitMessage):
    def __init__(self, files: list[str]):
        self.files = files


def member(record: bytes, level: int = 3) -> bytes:
    """A record as a gzip member with its lengths in the `sl` field."""
    z = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = z.compress(record) + z.flush()
    size = 10 + 2 + 12 + len(body) + 8
    return b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, size, len(record) & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(record), len(record) & 0xFFFFFFFF)


def _clean(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(record_type: str, record_id: str, payload: bytes, digest_hex: str, date: str, target_uri: str | None = None, refers_to: str | None = None) -> bytes:
    """A WARC/1.1 record of an HTTP response, or of a revisit, which has its HTTP headers only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if record_type == "revisit" else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {record_type}",
        f"WARC-Record-ID: <{_clean(record_id)}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest_hex)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if target_uri is not None:
        head.append(f"WARC-Target-URI: {_clean(target_uri)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <{_clean(refers_to)}>", f"WARC-Profile: {PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options):
        self.path = options["path"].rstrip("/")
        self.date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        self.limit = int(options.get("filebytes", 64 << 20))
        self.job = uuid.uuid4().hex

    def write(self, iterator):
        system, base = filesystem(self.path)
        system.create_dir(f"{base}/_{self.job}", recursive=True)
        files, out, size = [], None, 0
        for batch in iterator:
            for r in batch.to_pylist():
                if out is None or size > self.limit:
                    if out is not None:
                        out.close()
                    files.append(f"part-{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{base}/_{self.job}/{files[-1]}", compression=None), 0
                made = member(record(r["record_type"], r["record_id"], r["payload"] or b"", r["payload_digest"], self.date, r["target_uri"], r["refers_to"]))
                out.write(made)
                size += len(made)
        if out is not None:
            out.close()
        return _Wrote(files)

    def commit(self, messages):
        system, base = filesystem(self.path)
        for m in messages:
            for name in m.files if m else ():
                system.move(f"{base}/_{self.job}/{name}", f"{base}/{name}")
        self.abort(messages)

    def abort(self, messages):
        system, base = filesystem(self.path)
        if system.get_file_info(f"{base}/_{self.job}").type != fs.FileType.NotFound:
            system.delete_dir(f"{base}/_{self.job}")


class WarcSource(DataSource):
    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options)

    def writer(self, schema, overwrite):
        return WarcWriter(self.options)


def write(records: DataFrame, path: str) -> None:
    """records (record_type, record_id, target_uri, refers_to, payload, payload_digest) -> WARC files under `path`."""
    records.sparkSession.dataSource.register(WarcSource)
    cols = ["record_type", "record_id", "target_uri", "refers_to", "payload", "payload_digest"]
    records.select(*cols).write.format("warc").mode("append").option("path", path).save()


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """The records of all `.warc` and `.warc.gz` files under `path`, which any Hadoop file system of the cluster may hold."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    listed = root.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(root)
    files = [(s.getPath().toString(), s.getLen()) for s in listed if s.isFile() and s.getPath().getName().endswith((".warc", ".warc.gz"))]
    return spark.read.format("warc").option("files", json.dumps(files)).option("payload", "all" if payload else "none").load()


#: Names of records: this and a colon and the page's id, percent-encoded; this alone for a page without one.
PAGE = "urn:x-page"


def deduplicated(pages: DataFrame, least: int = 1000) -> DataFrame:
    """pages (page_id, url, html) -> records in which equal payloads of at least `least` bytes revisit the largest page_id.

    A null html is an empty payload. Rows with the same id and payload are both
    responses; a row without an id revisits like any other and is never revisited.
    """
    small_batches(pages.sparkSession)
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload")).withColumn("payload_digest", F.sha1("payload"))
    keys = rows.where(F.octet_length("payload") >= least).groupBy("payload_digest").agg(F.max("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    keys = written(keys.where("n > 1 and first_id is not null").select("payload_digest", "first_id"), "payloads")
    rows = join_by_size(rows, keys, "payload_digest", "left", 96 * keys.count())
    again = F.col("first_id").isNotNull() & ~F.col("first_id").eqNullSafe(F.col("page_id"))
    name = lambda c: F.coalesce(F.concat(F.lit(f"{PAGE}:"), F.url_encode(F.col(c).cast("string"))), F.lit(PAGE))
    return rows.select(
        F.when(again, "revisit").otherwise("response").alias("record_type"), name("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.when(again, name("first_id")).alias("refers_to"), "payload", "payload_digest"
    )


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write `pages` as archives, read them back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write(deduplicated(pages, least), path)
    back = read(spark, path)
    kind = dict(pages.dtypes)["page_id"]
    number = lambda c: F.when(F.startswith(F.col(c), F.lit(f"{PAGE}:")), F.url_decode(F.substring(F.col(c), F.lit(len(PAGE) + 2), F.length(c)))).cast(kind)
    return back.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.octet_length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha1("payload"), "payload_digest").alias("payload_digest"),
        "record_type",
        number("refers_to").alias("refers_to"),
    )


ORACLE = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, CAST(octet_length(b) AS BIGINT) AS payload_bytes, sha1(b) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS top FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, d.payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN top <> page_id THEN top END AS refers_to
FROM d LEFT JOIN k USING (payload_digest)
"""
