"""WARC archives as a PySpark Python data source.

Writing: each task writes one archive of gzip members, one a record, under a
temporary name; the commit on the driver renames those of the tasks that counted,
so that lost or repeated tasks leave nothing behind. Every member says in its
header's extra field how long it is, so that a reader can step over it.

Reading: small archives share a partition, and a partition's archives are read
as streams. Predicates on record_type and on the header columns are pushed down.
A record's headers are inflated and parsed first; if they don't match, or if no
payload is asked for, the rest of the member is stepped over (or, in members
of other writers, inflated without being kept) and never decoded.

Options: `payload` (true by default) - whether the column payload is filled and
its digest computed anew; else the digest is the header's. `partition_bytes`
(64 MB) - how much of small archives makes a partition.

Paths may be of any file system that pyarrow opens (file:, hdfs:, s3:, gs:).

Defined cases: a null html is an empty payload; a null url leaves out the
target's header; repeated rows give a record each; an empty table gives archives
without records; among equal payloads all rows of the smallest page_id are
responses; a null page_id comes after all others.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from ..plans.scratch import new_folder, stored
from .common import table, text_batches

#: A fixed date: archives of the same rows are the same bytes.
DATE = "2020-01-01T00:00:00Z"
SCHEMA = "record_id string, record_type string, target_uri string, payload_digest string, payload_bytes long, refers_to string, payload binary"
#: Columns that are known from headers alone, so that predicates on them spare payloads.
HEADER_COLUMNS = ("record_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to")
SMALL_PAYLOAD = 0
_LENGTH_FIELD = b"TL"
_STEP = 1 << 16


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member whose header's extra field holds the member's length."""
    packer = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    head = b"\x1f\x8b\x08\x04" + b"\0" * 5 + b"\xff"
    length = 10 + 2 + 8 + len(body) + 8
    return head + struct.pack("<H2sHI", 8, _LENGTH_FIELD, 4, length & 0xFFFFFFFF) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(record_id: str, record_type: str, target_uri: str | None, digest: str, size: int, refers_to: str | None, payload: bytes) -> bytes:
    """A response or revisit record; a revisit has the HTTP headers only."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload if record_type == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <{record_id}>", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if target_uri is not None:
        lines.append(f"WARC-Target-URI: {quote(target_uri, safe=''.join(map(chr, range(33, 127))).replace('%', ''))}")
    if record_type == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:]) if k}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


class _Member:
    """One gzip member of a stream, inflated as far as it is asked for."""

    def __init__(self, stream, head: bytes):
        self.stream, self.inflater = stream, zlib.decompressobj(31)
        self.known = self.left = 0
        if len(head) >= 20 and head[3] & 4 and head[12:14] == _LENGTH_FIELD:
            self.known = struct.unpack("<I", head[16:20])[0]
        self.got = self.inflater.decompress(head)
        self.read = len(head)

    def more(self) -> bool:
        if self.inflater.eof:
            return False
        data = self.stream.read(min(_STEP, self.known - self.read) if self.known else _STEP)
        if not data:
            return False
        self.read += len(data)
        self.got += self.inflater.decompress(data)
        return True

    def until(self, mark: bytes, begin: int = 0) -> int:
        while (at := self.got.find(mark, begin)) < 0:
            if not self.more():
                raise ValueError("a record ends within its headers")
        return at

    def rest(self) -> bytes:
        parts = [self.got]
        self.got = b""
        while self.more():
            parts.append(self.got)
            self.got = b""
        return b"".join(parts)

    def skip(self) -> None:
        if self.known:
            self.stream.seek(self.known - self.read, 1)
        else:
            while self.more():
                self.got = b""


def _records(stream, wanted: list, payload: bool) -> Iterator[tuple]:
    """Rows of SCHEMA of one archive; wanted: (column, values) that a row has to have."""
    ahead = b""
    while head := ahead or stream.read(20):
        own = _Member(stream, head)
        end = own.until(b"\r\n\r\n")
        fields = _fields(own.got[:end])
        strip = lambda name: fields[name].strip("<>") if name in fields else None
        uri = fields.get("warc-target-uri")
        row = {
            "record_id": strip("warc-record-id"), "record_type": fields.get("warc-type"), "target_uri": None if uri is None else unquote(uri),
            "payload_digest": fields["warc-payload-digest"].removeprefix("sha1:") if "warc-payload-digest" in fields else None, "refers_to": strip("warc-refers-to"),
        }
        fits = all(row[c] in values for c, values in wanted if c in row)
        body, size = None, None
        if fits:
            stop = own.until(b"\r\n\r\n", end + 4)
            http = _fields(own.got[end + 4 : stop])
            size = int(http.get("content-length", int(fields["content-length"]) - (stop - end)))
            fits = all(size in values for c, values in wanted if c == "payload_bytes")
            if fits and payload and row["record_type"] != "revisit":
                body = (own.rest())[stop + 4 : end + 4 + int(fields["content-length"])]
                row["payload_digest"], size = base32_sha1(body), len(body)
        if not own.inflater.eof:
            own.skip()
        ahead = own.inflater.unused_data
        if fits:
            yield (*(row[c] for c in ("record_id", "record_type", "target_uri", "payload_digest")), size, row["refers_to"], body)


@dataclass
class Archives(InputPartition):
    paths: list


class WarcReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.payload = options.get("payload", "true").lower() == "true"
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes equality and IN on header columns; Spark keeps the others."""
        for x in filters:
            if isinstance(x, (EqualTo, In)) and len(x.attribute) == 1 and x.attribute[0] in HEADER_COLUMNS:
                values = [x.value] if isinstance(x, EqualTo) else list(x.value)
                if None not in values:
                    self.wanted.append((x.attribute[0], values))
                    continue
            yield x

    def partitions(self) -> list[Archives]:
        files, root = _open(self.path)
        found = sorted((x for x in files.get_file_info(pafs.FileSelector(root)) if x.base_name.endswith(".warc.gz")), key=lambda x: x.path)
        out, size = [Archives([])], 0
        for x in found:
            if size + x.size > self.most and out[-1].paths:
                out.append(Archives([]))
                size = 0
            out[-1].paths.append(x.path)
            size += x.size
        return out

    def read(self, partition: Archives) -> Iterator[pa.RecordBatch]:
        files, _ = _open(self.path)
        kind = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.string()), ("payload", pa.binary())])
        rows: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

        for path in partition.paths:
            with files.open_input_file(path) as stream:
                for row in _records(stream, self.wanted, self.payload):
                    rows.append(row)
                    size += len(row[-1] or b"")
                    if len(rows) >= 2_000 or size > 4 << 20:
                        yield batch()
                        rows, size = [], 0
        if rows:
            yield batch()


@dataclass
class Written(WriterCommitMessage):
    name: str
    records: int


class WarcWriter(DataSourceWriter):
    """Rows (record_id, record_type, target_uri, payload_digest, payload_bytes, refers_to, payload)."""

    def __init__(self, options: dict):
        self.path = options["path"]
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator) -> Written:
        files, root = _open(self.path)
        files.create_dir(root)
        name, n = f"_{self.job}-{uuid.uuid4().hex}", 0
        with files.open_output_stream(f"{root}/{name}") as out:
            for row in iterator:
                n += 1
                out.write(member(record(row[0], row[1], row[2], row[3], row[4], row[5], bytes(row[6] or b""))))
        return Written(name, n)

    def commit(self, messages: list) -> None:
        files, root = _open(self.path)
        files.create_dir(root)
        kept = {m.name for m in messages if m is not None}
        for i, name in enumerate(sorted(kept)):
            files.move(f"{root}/{name}", f"{root}/part-{i:05d}-{self.job}.warc.gz")
        self._drop(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS") as out:
            out.write(json.dumps({"records": sum(m.records for m in messages if m is not None)}).encode())

    def abort(self, messages: list) -> None:
        self._drop(*_open(self.path))

    def _drop(self, files: pafs.FileSystem, root: str) -> None:
        for x in files.get_file_info(pafs.FileSelector(root, allow_not_found=True)):
            if x.base_name.startswith(f"_{self.job}-"):
                files.delete_file(x.path)


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> WarcReader:
        return WarcReader(self.options)

    def writer(self, schema: StructType, overwrite: bool) -> WarcWriter:
        return WarcWriter(self.options)


def records(pages: DataFrame, smallest: int = SMALL_PAYLOAD) -> DataFrame:
    """Rows of SCHEMA for pages (page_id, url, html): one response for equal payloads, else revisits.

    Who revisits whom is found from ids and digests alone and joined by page_id;
    the payloads are moved once.
    """
    payload = F.coalesce("html", F.lit(""))
    light = pages.select("page_id", F.sha1(payload).alias("sha1"), F.octet_length(payload).cast("long").alias("size")).distinct()
    first = light.groupBy("sha1").agg(F.min("page_id").alias("first_id"))
    known = stored(light.join(first, "sha1").where((F.col("size") >= smallest) & ~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", F.col("sha1").alias("of_sha1"), "first_id"), "revisits")
    rows = pages.select("page_id", "url", payload.alias("html")).withColumn("sha1", F.sha1("html"))
    joined = rows.join(known, rows["page_id"].eqNullSafe(known["page_id"]) & (rows["sha1"] == known["of_sha1"]), "left").select(rows["page_id"], "url", "html", "sha1", "first_id")
    name = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("")))
    again = F.col("first_id").isNotNull()
    return joined.select(
        name("page_id").alias("record_id"), F.when(again, "revisit").otherwise("response").alias("record_type"), F.col("url").alias("target_uri"),
        base32(F.col("sha1")).alias("payload_digest"), F.octet_length("html").cast("long").alias("payload_bytes"), F.when(again, name("first_id")).alias("refers_to"),
        F.when(~again, F.col("html").cast("binary")).alias("payload"),
    )


def base32(sha1_hex) -> Column:
    """A hexadecimal SHA-1 in upper-case base32: each five digits are four characters."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    parts = []
    for i in range(8):
        value = F.conv(F.substring(sha1_hex, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(letters, F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def write(rows: DataFrame, path: str) -> None:
    spark = rows.sparkSession
    text_batches(spark)
    spark.dataSource.register(WarcSource)
    rows.write.format("warc").mode("append").save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record, and read back from the archives."""
    path = new_folder(spark, "warc")
    write(records(table(spark, sf_dir, "pages")), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1)
    ident = lambda c: F.when(page(c) != "", page(c)).cast("long")
    return read(spark, path).select(ident("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", ident("refers_to").alias("refers_to"))


OP7_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
d AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, min(page_id) OVER (PARTITION BY h) AS first_id,
         list_aggregate(list_transform(range(8), lambda i: list_aggregate(list_transform([15, 10, 5, 0],
           lambda s: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(h, 5 * i::INT + 1, 5))::INT >> s) & 31) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""
