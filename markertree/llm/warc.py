"""WARC archives as a PySpark Python data source, and revisit records for equal payloads.

Every record is a gzip member of its own whose extra field ``SL`` holds the member's length, so a reader steps from
record to record: it inflates a record's headers, tests the pushed predicates on them, and inflates the payload only
if the record is wanted. Writers note offsets to split at; the reader plans its partitions from them.
"""

from __future__ import annotations

import json
import posixpath
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, GreaterThan, GreaterThanOrEqual, In,
    InputPartition, IsNotNull, IsNull, LessThan, LessThanOrEqual, WriterCommitMessage,
)

SCHEMA = ("page_id long, record_type string, target_uri string, payload_digest string, payload_bytes long, "
          "refers_to long, payload binary")
ARROW = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()),
                   ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("refers_to", pa.int64()),
                   ("payload", pa.binary())])
LEAST_REVISIT = 100
"""Payloads of fewer bytes are never revisits."""
SPLIT_BYTES = 8 << 20
BATCH_BYTES = 4 << 20
MANIFEST = "_manifest-"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def place(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path)


def deduplicated(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """One record for each page row, in the data source's columns; ``html`` null is an empty payload.

    Of records with equal payloads of at least ``least`` bytes, the smallest page_id is the response and the others
    refer to it. Rows that repeat that page_id are responses too. A null page_id counts as larger than any; where a
    payload has no other, its rows are all responses. Columns other than page_id, url and html are left behind.
    """
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("target_uri"),
                        payload.alias("payload")).withColumns({
        "payload_digest": F.sha2("payload", 256), "payload_bytes": F.length("payload").cast("long")})
    shared = rows.filter(F.col("payload_bytes") >= least).groupBy(F.col("payload_digest").alias("_digest")).agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return rows.join(shared, F.col("payload_digest") == F.col("_digest"), "left").select(
        "page_id", F.when(revisit, "revisit").otherwise("response").alias("record_type"), "target_uri", "payload_digest",
        "payload_bytes", F.when(revisit, F.col("_first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def _name(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page(name: str | None) -> int | None:
    number = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number.lstrip("-").isdigit() else None


def _uri(text: str) -> str:
    return text.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _from_uri(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(row: dict, date: str) -> bytes:
    """One WARC record, not compressed."""
    body = row["payload"] if row["record_type"] == "response" else b""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {date}",
            f"WARC-Target-URI: {_uri(row['target_uri'])}", f"WARC-Payload-Digest: sha256:{row['payload_digest']}",
            f"WARC-Payload-Length: {row['payload_bytes']}"]
    if row["record_type"] == "revisit":
        head += [f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(http) + len(body)}", "", ""]
    return "\r\n".join(head).encode() + http + body + b"\r\n\r\n"


def member(data: bytes, level: int = 6) -> bytes:
    """A gzip member with its own length in the extra field ``SL``."""
    squeeze = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = squeeze.compress(data) + squeeze.flush()
    length = 10 + 2 + 12 + len(body) + 8
    return (b"\x1f\x8b\x08\x04\0\0\0\0\0\xff" + struct.pack("<H2sHII", 12, b"SL", 8, length, len(data) & 0xFFFFFFFF) + body
            + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF))


class Written(WriterCommitMessage):
    def __init__(self, file: str, size: int, splits: list[int]):
        self.file, self.size, self.splits = file, size, splits


class Writer(DataSourceArrowWriter):
    """Each task writes one file under a name of its own; the manifest names the files of tasks that succeeded."""

    def __init__(self, path: str, date: str):
        self.path, self.date = path, date

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, folder = place(self.path)
        fs.create_dir(folder, recursive=True)
        name, at, splits = f"part-{uuid.uuid4().hex}.warc.gz", 0, [0]
        with fs.open_output_stream(posixpath.join(folder, name), compression=None) as out:
            for batch in iterator:
                for row in batch.to_pylist():
                    data = member(record(row, self.date))
                    if at - splits[-1] >= SPLIT_BYTES:
                        splits.append(at)
                    out.write(data)
                    at += len(data)
        return Written(name, at, splits)

    def commit(self, messages: list[Written | None]) -> None:
        fs, folder = place(self.path)
        fs.create_dir(folder, recursive=True)
        files = [[m.file, m.size, m.splits] for m in messages if m is not None]
        with fs.open_output_stream(posixpath.join(folder, f"{MANIFEST}{uuid.uuid4().hex}.json")) as out:
            out.write(json.dumps(files).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, folder = place(self.path)
        for m in messages:
            if m is not None:
                fs.delete_file(posixpath.join(folder, m.file))


class Part(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


HEADER_TESTS = {
    EqualTo: lambda x, v: x is not None and x == v,
    EqualNullSafe: lambda x, v: x == v,
    In: lambda x, v: x is not None and x in v,
    GreaterThan: lambda x, v: x is not None and x > v,
    GreaterThanOrEqual: lambda x, v: x is not None and x >= v,
    LessThan: lambda x, v: x is not None and x < v,
    LessThanOrEqual: lambda x, v: x is not None and x <= v,
    IsNotNull: lambda x, v: x is not None,
    IsNull: lambda x, v: x is None,
}
HEADERS = {"page_id", "record_type", "target_uri", "payload_digest", "payload_bytes", "refers_to"}


class Reader(DataSourceReader):
    def __init__(self, path: str, payload: bool):
        self.path, self.payload, self.tests = path, payload, []

    def pushFilters(self, filters):
        for f in filters:
            test = HEADER_TESTS.get(type(f))
            if test is None or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
                yield f
            else:
                self.tests.append((type(f), f.attribute[0], getattr(f, "value", None)))

    def partitions(self) -> list[Part]:
        fs, folder = place(self.path)
        infos = fs.get_file_info(pafs.FileSelector(folder))
        manifests = [i.path for i in infos if i.base_name.startswith(MANIFEST)]
        parts = []
        for m in manifests:
            with fs.open_input_stream(m) as f:
                for name, size, splits in json.loads(f.read()):
                    file = posixpath.join(folder, name)
                    parts += [Part(file, a, b) for a, b in zip(splits, [*splits[1:], size]) if b > a]
        if not manifests:  # archives from elsewhere: a file is a partition
            parts = [Part(i.path, 0, i.size) for i in infos if i.is_file and i.base_name.endswith(".warc.gz")]
        return parts or [Part("", 0, 0)]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        if not partition.file:
            return
        fs, _ = place(self.path)
        rows, held = [], 0
        with fs.open_input_file(partition.file) as f:
            at = partition.start
            while at < partition.end:
                row, at = self._record(f, at)
                if row is not None:
                    rows.append(row)
                    held += len(row["payload"] or b"") + 256
                if held >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, ARROW)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, ARROW)

    def _record(self, f, at: int) -> tuple[dict | None, int]:
        """The record at an offset, or None where the headers rule it out; and the offset of the next."""
        first = f.read_at(1024, at)
        length = None
        if first[3] & 4 and first[12:14] == b"SL":
            length = struct.unpack_from("<I", first, 16)[0]
        inflate = zlib.decompressobj(31)
        data = inflate.decompress(first[:length] if length else first, 1 << 16)
        got = at + len(first)
        while b"\r\n\r\n" not in data and not inflate.eof:
            piece = inflate.unconsumed_tail
            if not piece:
                piece = f.read_at(1 << 16, got)
                got += len(piece)
                if not piece:
                    raise ValueError(f"the record at {at} breaks off")
            data += inflate.decompress(piece, 1 << 16)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
        digest = fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None
        row = {"page_id": _page(fields.get("WARC-Record-ID")), "record_type": fields.get("WARC-Type"),
               "target_uri": _from_uri(fields.get("WARC-Target-URI", "")), "payload_digest": digest,
               "payload_bytes": int(fields["WARC-Payload-Length"]) if "WARC-Payload-Length" in fields else None,
               "refers_to": _page(fields.get("WARC-Refers-To")), "payload": None}
        wanted = all(HEADER_TESTS[kind](row[name], value) for kind, name, value in self.tests)
        if length and (not wanted or not self.payload or row["record_type"] == "revisit"):
            return (row if wanted else None), at + length  # the payload stays compressed
        if length:
            whole = zlib.decompress(f.read_at(length, at), 31)
            end = at + length
        else:  # no length given: inflate to the member's end
            inflate, whole, got = zlib.decompressobj(31), b"", at
            while not inflate.eof:
                piece = f.read_at(1 << 16, got)
                if not piece:
                    raise ValueError(f"the record at {at} breaks off")
                whole += inflate.decompress(piece)
                got += len(piece)
            end = got - len(inflate.unused_data)
        if not wanted:
            return None, end
        start = len(head) + 4
        block = whole[start:start + int(fields.get("Content-Length", len(whole) - start - 4))]
        if self.payload and row["record_type"] == "response":
            row["payload"] = block.partition(b"\r\n\r\n")[2]
        return row, end


class WarcSource(DataSource):
    """Format ``warc``: options path, payload (true: decode payloads), date (of written records)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Reader:
        return Reader(self.options["path"], self.options.get("payload", "true") == "true")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options.get("date", "1970-01-01T00:00:00Z"))


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def write_archives(records: DataFrame, path: str) -> None:
    """Append records with the columns of ``SCHEMA`` to the archives in ``path``, a folder all executors share."""
    register(records.sparkSession)
    records.select(*[c.split()[0] for c in SCHEMA.split(", ")]).write.format("warc").mode("append").save(path)


def read_archives(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Records of the archives in ``path``. Comparisons on header columns are tested before a payload is inflated."""
    register(spark)
    return spark.read.format("warc").option("payload", str(payload).lower()).load(path)
