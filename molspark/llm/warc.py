"""WARC archives as a Spark data source, and pages written with revisit records.

Each record is a gzip member of its own whose extra field tells its packed length,
so a reader can step over a record without unpacking it. Tasks write files under
fresh names; only what the driver commits is listed in the folder's manifest, so a
lost or repeated task leaves nothing that is read. The manifest also holds offsets
at record starts, by which large files are split into read partitions.

A reader first unpacks a record's headers, tests the pushed predicates on them,
and unpacks the payload only of records that pass, if payloads are wanted at all.
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
from datetime import datetime, timezone

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, In, InputPartition, IsNotNull, IsNull, Not, StringStartsWith, WriterCommitMessage,
)

from molspark.staging import broadcast_checked, fresh_path, stage

MANIFEST = "manifest.json"
SPLIT_BYTES = 32 << 20
BATCH_BYTES = 8 << 20
GROUP_ROWS = 100_000  # broadcast the repeated payloads up to so many
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: {}\r\n\r\n"
#: Columns read from headers, by header.
HEADERS = {
    "WARC-Record-ID": "record_id", "WARC-Type": "record_type", "WARC-Target-URI": "target_uri", "WARC-Date": "date",
    "WARC-Payload-Digest": "payload_digest", "WARC-Refers-To": "refers_to",
}
SCHEMA = ", ".join(f"{c} string" for c in HEADERS.values()) + ", payload_length bigint, payload binary"
_NAMES = [*HEADERS.values(), "payload_length", "payload"]
_TYPES = [pa.string()] * len(HEADERS) + [pa.int64(), pa.binary()]


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def pack(headers: dict[str, str | None], block: bytes) -> bytes:
    """One record as a gzip member that knows its length; control characters in values are percent-escaped."""
    lines = ["WARC/1.1"] + [f"{k}: {_escaped(v)}" for k, v in headers.items() if v is not None] + [f"Content-Length: {len(block)}", "", ""]
    raw = "\r\n".join(lines).encode() + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, -zlib.MAX_WBITS)
    body = packer.compress(raw) + packer.flush()
    size = 12 + 8 + len(body) + 8
    extra = b"sl" + struct.pack("<HI", 4, size)
    return b"\x1f\x8b\x08\x04" + b"\0" * 4 + b"\x04\xff" + struct.pack("<H", len(extra)) + extra + body + struct.pack("<II", zlib.crc32(raw), len(raw) & 0xFFFFFFFF)


def _escaped(value: str) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in value)


class Records:
    """Walks over the records of a byte range of a file; the block of a record is unpacked on demand."""

    def __init__(self, file, start: int, end: int) -> None:
        self._file, self._at, self._end = file, start, end

    def __iter__(self) -> Iterator[tuple[dict[str, str], "Records"]]:
        while self._at < self._end:
            self._file.seek(self._at)
            head = self._file.read(20)
            known = head[:4] == b"\x1f\x8b\x08\x04" and head[12:14] == b"sl"
            self._size = struct.unpack("<I", head[16:20])[0] if known else None
            self._file.seek(self._at)
            self._unpacker, self._left, self._raw = zlib.decompressobj(zlib.MAX_WBITS | 16), self._size, b""
            while b"\r\n\r\n" not in self._raw and self._more():
                pass
            text, _, self._rest = self._raw.partition(b"\r\n\r\n")
            headers = dict(line.split(": ", 1) for line in text.decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
            self._length = int(headers.get("Content-Length", 0))
            yield headers, self
            if self._size is None:  # a member without its length has to be unpacked to its end
                while self._more():
                    pass
                self._size = self._file.tell() - len(self._unpacker.unused_data) - self._at
            self._at += self._size

    def _more(self) -> bool:
        if self._unpacker.eof:
            return False
        chunk = self._file.read(min(4096 if not self._raw else 1 << 16, self._left or 1 << 16))
        if not chunk:
            raise ValueError(f"a record at byte {self._at} is cut off")
        if self._left is not None:
            self._left -= len(chunk)
        self._raw += self._unpacker.decompress(chunk)
        return True

    def block(self) -> bytes:
        """The current record's block."""
        parts = [self._rest]
        have = len(self._rest)
        while have < self._length:
            self._raw = b"-"
            if not self._more():
                raise ValueError(f"a record at byte {self._at} is shorter than it says")
            parts.append(self._raw[1:])
            have += len(parts[-1])
        return b"".join(parts)[: self._length]


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@dataclass
class Slice(InputPartition):
    path: str
    start: int
    end: int


class WarcReader(DataSourceReader):
    """Options: ``path``; ``payload`` (default true) unpacks payloads; ``verify`` (default true) checks digests that this module has written.

    A folder without a manifest is read as the ``*.warc.gz`` files below it, one record
    per gzip member, one partition per file. Their payload lengths are known only where
    the payload is unpacked.
    """

    def __init__(self, options: dict) -> None:
        self._path = options["path"].rstrip("/")
        self._payload = options.get("payload", "true").lower() == "true"
        self._verify = options.get("verify", "true").lower() == "true"
        self._tests: list = []

    def pushFilters(self, filters):
        for item in filters:
            inner = item.child if isinstance(item, Not) else item
            usable = isinstance(inner, (EqualTo, In, IsNull, IsNotNull, StringStartsWith)) and inner.attribute[0] in HEADERS.values()
            if usable:
                self._tests.append(item)
            else:
                yield item

    def partitions(self) -> list[Slice]:
        fs, base = _open(self._path)
        if fs.get_file_info(f"{base}/{MANIFEST}").type == pafs.FileType.NotFound:  # archives from elsewhere: a partition per file
            found = fs.get_file_info(pafs.FileSelector(base, recursive=True))
            names = sorted((f.path.removeprefix(base).lstrip("/"), f.size) for f in found if f.is_file and f.path.endswith(".warc.gz") and f.size)
            return [Slice(f"{self._path}/{name}", 0, size) for name, size in names]
        with fs.open_input_stream(f"{base}/{MANIFEST}") as file:
            files = json.loads(file.read())["files"]
        return [Slice(f"{self._path}/{f['name']}", a, b) for f in files for a, b in zip(f["starts"], [*f["starts"][1:], f["size"]])]

    def read(self, partition: Slice) -> Iterator[pa.RecordBatch]:
        if partition is None:  # what a folder without archives is read by
            return
        fs, path = _open(partition.path)
        columns, size = [[] for _ in _NAMES], 0
        with fs.open_input_file(path) as file:
            for headers, record in Records(file, partition.start, partition.end):
                row = [headers.get(h) for h in HEADERS]
                if not all(_holds(t, dict(zip(_NAMES, row))) for t in self._tests):
                    continue
                length, payload = headers.get("X-Payload-Length"), None
                if self._payload and headers.get("WARC-Type") == "response":
                    payload = record.block().partition(b"\r\n\r\n")[2]
                    if self._verify and length is not None and f"sha1:{digest(payload)}" != headers.get("WARC-Payload-Digest"):
                        raise ValueError(f"payload of {row[0]} does not match its digest")
                    length = len(payload)
                for column, value in zip(columns, [*row, None if length is None else int(length), payload]):
                    column.append(value)
                size += len(payload or b"") + 200
                if size > BATCH_BYTES:
                    yield self._batch(columns)
                    columns, size = [[] for _ in _NAMES], 0
        if columns[0]:
            yield self._batch(columns)

    @staticmethod
    def _batch(columns: list[list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, _TYPES)], _NAMES)


def _holds(test, row: dict) -> bool:
    """A pushed predicate on a row; one on a null is not true."""
    if isinstance(test, Not):
        return row[test.child.attribute[0]] is not None and not _holds(test.child, row) if not isinstance(test.child, (IsNull, IsNotNull)) else not _holds(test.child, row)
    value = row[test.attribute[0]]
    if isinstance(test, IsNull):
        return value is None
    if isinstance(test, IsNotNull):
        return value is not None
    if value is None:
        return False
    if isinstance(test, In):
        return value in test.value
    return value.startswith(test.value) if isinstance(test, StringStartsWith) else value == test.value


@dataclass
class Written(WriterCommitMessage):
    name: str
    size: int
    starts: list[int]


class WarcWriter(DataSourceArrowWriter):
    """Writes ``record_id, target_uri, refers_to, payload_digest, payload_length, payload``; a row with ``refers_to`` is a revisit."""

    def __init__(self, options: dict) -> None:
        self._path = options["path"].rstrip("/")
        self._date = options.get("date") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, base = _open(self._path)
        fs.create_dir(base, recursive=True)
        name = f"part-{uuid.uuid4().hex}.warc.gz"
        starts, at = [0], 0
        with fs.open_output_stream(f"{base}/{name}", compression=None) as out:
            out.write(info := pack({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": self._date, "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
            at += len(info)
            for batch in iterator:
                for row in range(batch.num_rows):
                    packed = self._record({n: batch.column(i)[row].as_py() for i, n in enumerate(batch.schema.names)})
                    if at - starts[-1] > SPLIT_BYTES:
                        starts.append(at)
                    out.write(packed)
                    at += len(packed)
        return Written(name, at, starts)

    def _record(self, row: dict) -> bytes:
        revisit = row["refers_to"] is not None
        headers = {
            "WARC-Type": "revisit" if revisit else "response", "WARC-Record-ID": row["record_id"], "WARC-Date": self._date, "WARC-Target-URI": row["target_uri"],
            "Content-Type": "application/http; msgtype=response", "WARC-Payload-Digest": f"sha1:{row['payload_digest']}", "X-Payload-Length": str(row["payload_length"]),
        }
        if revisit:
            headers |= {"WARC-Profile": _PROFILE, "WARC-Refers-To": row["refers_to"]}
        block = _HTTP.format(row["payload_length"]).encode()
        return pack(headers, block if revisit else block + row["payload"])

    def commit(self, messages: list) -> None:
        fs, base = _open(self._path)
        fs.create_dir(base, recursive=True)
        files = [{"name": m.name, "size": m.size, "starts": m.starts} for m in messages if m is not None]
        with fs.open_output_stream(f"{base}/{MANIFEST}") as out:
            out.write(json.dumps({"files": sorted(files, key=lambda f: f["name"])}).encode())

    def abort(self, messages: list) -> None:
        """Nothing to undo: files that no manifest names are never read."""


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder)``, of folders written by the same format or of plain ``*.warc.gz`` files."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options))


def register(spark: SparkSession) -> None:
    """Makes the format known, and lets Spark push predicates to it."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def write_pages(pages: DataFrame, folder: str, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """Writes a record per row of ``pages``; of equal payloads the largest id's is a response, the others revisit it.

    The payload is the text in UTF-8, empty for null. Payloads under ``least_bytes``
    are responses all. A null id is the smallest, and its record has a random name;
    if all ids of a payload are null, or rows repeat the largest id, all these are
    responses. Other columns are not read; an empty table gives archives without pages.
    """
    register(pages.sparkSession)
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("target_uri"), payload.alias("payload"))
    rows = rows.select("*", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("payload_length"))
    groups = rows.where(F.col("payload_length") >= least_bytes).groupBy("sha1").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1 AND last IS NOT NULL")
    groups = broadcast_checked(stage(groups.select(F.col("sha1").alias("same"), "last"), "payloads"), GROUP_ROWS)
    name = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    later = F.col("id").isNull() | (F.col("id") < F.col("last"))
    rows.join(groups, F.col("sha1") == F.col("same"), "left").select(
        F.coalesce(name(F.col("id")), F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))).alias("record_id"),
        "target_uri",
        F.when(F.col("last").isNotNull() & later, name(F.col("last"))).alias("refers_to"),
        F.udf(lambda h: base64.b32encode(bytes.fromhex(h)).decode(), "string", useArrow=True)("sha1").alias("payload_digest"),
        "payload_length",
        F.when(F.col("last").isNotNull() & later, F.lit(b"")).otherwise(F.col("payload")).alias("payload"),
    ).write.format("warc").mode("append").save(folder)


def read_records(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of a folder, with or without payloads; predicates on header columns are tested before unpacking.

    Filter the result once and take a new one for other predicates: Spark 4.1 keeps what
    it has pushed with the relation, so a second filter of the same table sees the first.
    """
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).load(folder)


def archive_round_trip(pages: DataFrame, least_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``id_col, payload_bytes, payload_digest, record_type, refers_to`` from archives written and read back.

    Responses are read with their payloads, whose digests are checked; revisits by
    their headers alone.
    """
    spark, folder = pages.sparkSession, fresh_path(pages.sparkSession, "warc")
    write_pages(pages, folder, least_bytes, id_col, url_col, html_col)
    kind = pages.schema[id_col].dataType
    page = lambda c: F.nullif(F.regexp_extract(c, "^<urn:page:(.*)>$", 1), F.lit("")).cast(kind)
    responses = read_records(spark, folder).where("record_type = 'response'").withColumn("payload_length", F.octet_length("payload").cast("bigint"))
    revisits = read_records(spark, folder, payload=False).where("record_type = 'revisit'")
    return responses.unionByName(revisits).select(
        page(F.col("record_id")).alias(id_col),
        F.col("payload_length").alias("payload_bytes"),
        F.substring("payload_digest", 6, 32).alias("payload_digest"),
        "record_type",
        page(F.col("refers_to")).alias("refers_to"),
    )
