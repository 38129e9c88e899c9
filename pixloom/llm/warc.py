"""WARC archives as a Python data source.

Writing: every task writes gzip members, one a record, to files of its own; the
files get their names when the job commits, so lost executors leave nothing.
Each member's gzip header carries the member's length, so a reader can step over
a record.  Reading: a partition a file; record headers are inflated and parsed
first, pushed-down predicates on them are decided, and only the payloads of
records that remain (and only if the schema asks for them) are decoded.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, In, InputPartition, IsNotNull, IsNull, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)

from .common import new_path, small_batches

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_length long, payload binary"
#: Columns that a record's header holds.
HEADERS = {"record_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date", "refers_to": "warc-refers-to", "payload_digest": "warc-payload-digest"}
#: Bytes of an archive file after which a task begins the next one; bytes inflated at a time while headers are sought.
FILE_BYTES, HEAD_BYTES = 128 << 20, 4096


def _clean(value: str) -> str:
    return value.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A") if "\r" in value or "\n" in value else value


def record(row: dict) -> bytes:
    """A WARC/1.1 record; revisits have an HTTP head but no payload."""
    payload = row["payload"] or b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_length']}\r\n\r\n".encode()
    block = http + (payload if row["record_type"] == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: <{row['record_id']}>", f"WARC-Date: {row['date']}"]
    if row["target_uri"] is not None:
        lines.append(f"WARC-Target-URI: {_clean(row['target_uri'])}")
    if row["refers_to"] is not None:
        lines += [f"WARC-Refers-To: <{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha256:{row['payload_digest']}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """A gzip member whose extra field 'sl' has its compressed and plain length."""
    squeeze = zlib.compressobj(1, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    total = 10 + 2 + 12 + len(body) + 8
    head = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"sl", 8, total, len(data) & 0xFFFFFFFF)
    return head + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def parse_head(data: bytes) -> dict[str, str]:
    lines = data.decode("utf-8", "replace").split("\r\n")
    out = {}
    for line in lines[1:]:
        name, _, value = line.partition(":")
        out[name.strip().lower()] = value.strip()
    return out


def _value(head: dict[str, str], column: str) -> str | None:
    value = head.get(HEADERS[column])
    if value is None:
        return None
    if column in ("record_id", "refers_to"):
        return value.strip("<>")
    return value.removeprefix("sha256:") if column == "payload_digest" else value


def decides(f, head: dict[str, str]) -> bool:
    """Whether a pushed-down filter on a header column holds."""
    value = _value(head, f.attribute[0])
    if isinstance(f, IsNull | IsNotNull):
        return (value is None) == isinstance(f, IsNull)
    if isinstance(f, EqualNullSafe):
        return value == f.value
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    return value.startswith(f.value) if isinstance(f, StringStartsWith) else value.endswith(f.value) if isinstance(f, StringEndsWith) else f.value in value


class _Member:
    """A record of an open archive: its header, then, on demand, its block."""

    def __init__(self, source, at: int):
        self.start = at
        source.seek(at)
        fixed = source.read(24)
        self.gz, self.source = fixed[:2] == b"\x1f\x8b", source
        self.size = struct.unpack("<I", fixed[16:20])[0] if self.gz and fixed[3:4] == b"\x04" and fixed[12:14] == b"sl" else None
        source.seek(at)
        self.inflate, self.data, self.read = zlib.decompressobj(31) if self.gz else None, b"", 0
        self.empty = not fixed
        while b"\r\n\r\n" not in self.data and self._more():
            pass
        self.head_size = self.data.find(b"\r\n\r\n") + 4
        self.head = parse_head(self.data[: self.head_size - 4]) if not self.empty else {}
        self.length = int(self.head.get("content-length", 0))

    def _more(self, size: int = HEAD_BYTES) -> bool:
        if self.inflate is not None and self.inflate.eof:
            return False
        raw = self.source.read(size)
        self.read += len(raw)
        self.data += self.inflate.decompress(raw) if self.gz else raw
        return bool(raw)

    def block(self) -> bytes:
        parts, have = [self.data], len(self.data)
        while have < self.head_size + self.length:
            self.data = b""
            if not self._more(1 << 20):
                break
            parts.append(self.data)
            have += len(self.data)
        self.data = b"".join(parts)
        return self.data[self.head_size : self.head_size + self.length]

    def after(self) -> int:
        """Where the next record begins; inflates the rest only where the length isn't told."""
        if not self.gz:
            return self.start + self.head_size + self.length + 4
        if self.size:
            return self.start + self.size
        while not self.inflate.eof and self._more(1 << 20):
            self.data = b""
        return self.start + self.read - len(self.inflate.unused_data)


@dataclass
class _File(InputPartition):
    path: str


def _open_fs(uri: str):
    return fs.FileSystem.from_uri(uri)


class WarcReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str]):
        self.path, self.columns, self.filters = path, columns, []

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo | EqualNullSafe | In | IsNull | IsNotNull | StringStartsWith | StringEndsWith | StringContains) and len(f.attribute) == 1 and f.attribute[0] in HEADERS:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        system, root = _open_fs(self.path)
        info = system.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            return []
        found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(root, recursive=True))
        return [_File(x.path) for x in sorted(found, key=lambda x: x.path) if x.type == fs.FileType.File and x.path.endswith((".warc", ".warc.gz")) and "/_" not in x.path.removeprefix(root)]

    def read(self, partition):
        if partition is None:
            return
        system, _ = _open_fs(self.path)
        kinds = {"payload": pa.binary(), "payload_length": pa.int64()}
        schema = pa.schema([(c, kinds.get(c, pa.string())) for c in self.columns])
        rows, held = [], 0
        with system.open_input_file(partition.path) as source:
            at, end = 0, source.size()
            while at < end:
                m = _Member(source, at)
                if m.head and all(decides(f, m.head) for f in self.filters):
                    row = {c: _value(m.head, c) for c in self.columns if c in HEADERS}
                    if "payload" in self.columns or "payload_length" in self.columns:
                        http, _, payload = m.block().partition(b"\r\n\r\n")
                        told = next((int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")), len(payload))
                        row |= {"payload": payload if row.get("record_type", m.head.get("warc-type")) != "revisit" else None, "payload_length": told}
                    rows.append({c: row.get(c) for c in self.columns})
                    held += len(row.get("payload") or b"")
                at = m.after()
                if len(rows) >= 1024 or held > 16 << 20:
                    yield pa.RecordBatch.from_pylist(rows, schema)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)


@dataclass
class _Written(WriterCommitMessage):
    files: list


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def write(self, iterator):
        system, root = _open_fs(self.path)
        folder, files, out, size = f"{root}/_{self.job}", [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if out is None:
                    system.create_dir(folder, recursive=True)
                    files.append(f"{uuid.uuid4().hex}.warc.gz")
                    out, size = system.open_output_stream(f"{folder}/{files[-1]}", compression=None), 0
                data = member(record(row))
                out.write(data)
                size += len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
        if out is not None:
            out.close()
        return _Written(files)

    def commit(self, messages):
        system, root = _open_fs(self.path)
        system.create_dir(root, recursive=True)
        if self.overwrite:
            for x in system.get_file_info(fs.FileSelector(root)):
                if x.type == fs.FileType.File and x.path.endswith(".warc.gz"):
                    system.delete_file(x.path)
        for m in messages:
            for name in m.files if m else []:
                system.move(f"{root}/_{self.job}/{name}", f"{root}/{name}")
        self._clear(system, root)

    def abort(self, messages):
        self._clear(*_open_fs(self.path))

    def _clear(self, system, root):
        if system.get_file_info(f"{root}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{root}/_{self.job}")


class WarcDataSource(DataSource):
    """spark.read.format("warc").load(path), df.write.format("warc").save(path); a schema of fewer columns decodes less."""

    @classmethod
    def name(cls):
        return "warc"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return WarcReader(self.options["path"], [f.name for f in schema.fields])

    def writer(self, schema, overwrite):
        return WarcWriter(self.options["path"], overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcDataSource)


def records(pages: DataFrame, least: int = 100, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """SCHEMA rows for pages (page_id, url, html).

    Of rows with equal payloads of at least `least` bytes the one with the
    smallest page_id is a response and the others are revisits of it; rows
    that share that page_id and payload are all responses, as are all smaller
    payloads.  A null html is an empty payload; a null page_id has the id
    urn:page:none and never becomes a referent.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    p = p.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_length", F.octet_length("payload").cast("long"))
    first = p.where(F.col("payload_length") >= least).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    # the verdict is found without payloads and joined by page, so that a common payload is nobody's hot key
    revisits = p.select("page_id", "payload_digest", "payload_length").join(first, "payload_digest").where(f"payload_length >= {int(least)} and not (page_id <=> first)")
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "first").distinct()
    same = F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest"))
    p = p.join(revisits, same, "left").withColumn("revisit", F.col("_digest").isNotNull())
    urn = lambda c: F.concat(F.lit("urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("none")))
    return p.select(
        F.when(F.col("revisit"), "revisit").otherwise("response").alias("record_type"), urn("page_id").alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(F.col("revisit"), urn("first")).alias("refers_to"), "payload_digest", "payload_length", F.when(~F.col("revisit"), F.col("payload")).alias("payload"),
    )


def op8_warc(spark, sf_dir: str) -> DataFrame:
    """Writes all pages and reads them back: responses with their payloads, which are digested anew, and revisits by their headers alone.

    The record type is a predicate on headers that the source decides, and
    payloads of the other records are not decoded.  Odd rows as in `records`.
    """
    register(spark)
    small_batches(spark)
    path = new_path(spark, "warc")
    records(spark.read.parquet(f"{sf_dir}/pages.parquet")).write.format("warc").mode("append").save(path)
    read = lambda kind: spark.read.format("warc").load(path).where(F.col("record_type") == kind)  # noqa: E731  (a scan each: a shared one would push both predicates)
    number = lambda c: F.expr(f"try_cast(substring({c}, 10) as bigint)").alias("page_id" if c == "record_id" else c)
    responses = read("response").select(number("record_id"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"))
    revisits = read("revisit").select(number("record_id"), F.col("payload_length").alias("payload_bytes"), "payload_digest", "record_type", number("refers_to"))
    return responses.union(revisits)


OP8_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, n::bigint as payload_bytes, d as payload_digest,
  case when first is not null and first is distinct from page_id then 'revisit' else 'response' end as record_type,
  case when first is not null and first is distinct from page_id then first end as refers_to
from p left join f using (d)
"""
