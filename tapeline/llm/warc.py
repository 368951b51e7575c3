"""Web archives: a PySpark data source ``warc`` that reads and writes WARC records, and
revisit records for repeated payloads.

Reading plans a partition for each file. Record headers are parsed first; predicates on
the header columns are pushed down to them, and the payload of a record that is not wanted
(or of any record, if the schema asked for has no ``payload``) is skipped by its length,
neither read nor decoded. Files ending in ``.gz`` are read as a stream of compressed
members; there a skipped payload is still inflated.

Writing makes files of bounded size, named by task attempt. Every write adds a list of the
files of its successful attempts, and readers follow all lists, so a lost executor or a
repeated task leaves no records behind and a second write adds to the first. A write that
overwrites names the lists it replaces; these are followed no more from the moment its own
list is there. Files that are replaced or in no list are left where they are.

Nulls: a null payload is written as an empty one, a null header is left out and read back
as null. Line breaks in header values become blanks. Repeated rows are records of their
own, ties for the largest id too. A folder without records reads as an empty table. A
record is one row, so memory grows with the largest payload. Columns of pages other than the
three that are named are ignored, whatever their names.
"""

from __future__ import annotations

import gzip
import io
import json
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualNullSafe, EqualTo, Filter,
    GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, IsNull, LessThan,
    LessThanOrEqual, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tapeline.llm.shared import fresh, written

SCHEMA = (
    "record_id string, record_type string, target_uri string, date string, "
    "payload_digest string, payload_length bigint, refers_to string, payload binary"
)
# Header names of the format.
HEADERS = {
    "record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI",
    "date": "WARC-Date", "payload_digest": "WARC-Payload-Digest", "refers_to": "WARC-Refers-To",
    "payload_length": "X-Payload-Length",
}
ANGLED = ("record_id", "refers_to")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
LISTING = "_records-"
BATCH_BYTES = 8 << 20


def file_system(path: str):
    """File system and path in it, for a URI or a local path. Usable inside tasks."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        if path.startswith("file:") and not path.startswith("file:///"):
            path = "file://" + path.removeprefix("file:")
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


# --- records -------------------------------------------------------------------------

def record_bytes(row: dict) -> bytes:
    """One record. A revisit has no payload; other records hold an HTTP answer."""
    payload = row.get("payload") or b""
    if row.get("record_type") == "revisit":
        block, kind = b"", "application/http; msgtype=response"
    else:
        head = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                f"Content-Length: {len(payload)}\r\n\r\n")
        block, kind = head.encode() + payload, "application/http; msgtype=response"
    lines = ["WARC/1.0"]
    for column, name in HEADERS.items():
        value = row.get(column)
        if value is not None:
            value = " ".join(str(value).splitlines())
            lines.append(f"{name}: <{value}>" if column in ANGLED else f"{name}: {value}")
    if row.get("record_type") == "revisit":
        lines.append(f"WARC-Profile: {REVISIT_PROFILE}")
    lines += [f"Content-Type: {kind}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def read_header(stream) -> dict[str, str] | None:
    """The next record's header lines, or None at the end of the file."""
    line = stream.readline()
    while line in (b"\r\n", b"\n"):
        line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"not a record: {line[:40]!r}")
    found: dict[str, str] = {}
    last = ""
    while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[:1] in " \t" and last:
            found[last] += " " + text.strip()
            continue
        name, _, value = text.partition(":")
        last = name.strip().lower()
        found[last] = value.strip()
    return found


def header_row(header: dict[str, str]) -> dict:
    row = {}
    for column, name in HEADERS.items():
        value = header.get(name.lower())
        if value is not None and column in ANGLED:
            value = value.removeprefix("<").removesuffix(">")
        if column == "payload_length" and value is not None:
            value = int(value) if value.isdigit() else None
        row[column] = value
    return row


def payload_of(block: bytes, header: dict[str, str]) -> bytes:
    """The block without the head of an HTTP answer."""
    if header.get("content-type", "").startswith("application/http"):
        _, found, rest = block.partition(b"\r\n\r\n")
        return rest if found else b""
    return block


# --- predicates ----------------------------------------------------------------------

def predicate(wanted: Filter) -> Callable[[dict], bool] | None:
    """What a filter means for a header row; None if it cannot be answered there."""
    column = getattr(wanted, "attribute", None)
    if not column or len(column) != 1 or column[0] not in HEADERS:
        return None
    name, value = column[0], getattr(wanted, "value", None)
    known = lambda test: lambda row: row[name] is not None and test(row[name])
    tests = {
        EqualTo: lambda: known(lambda x: x == value),
        EqualNullSafe: lambda: lambda row: row[name] == value,
        In: lambda: known(lambda x: x in value),
        IsNull: lambda: lambda row: row[name] is None,
        IsNotNull: lambda: lambda row: row[name] is not None,
        GreaterThan: lambda: known(lambda x: x > value),
        GreaterThanOrEqual: lambda: known(lambda x: x >= value),
        LessThan: lambda: known(lambda x: x < value),
        LessThanOrEqual: lambda: known(lambda x: x <= value),
        StringStartsWith: lambda: known(lambda x: x.startswith(value)),
        StringEndsWith: lambda: known(lambda x: x.endswith(value)),
        StringContains: lambda: known(lambda x: value in x),
    }
    make = tests.get(type(wanted))
    return make() if make else None


# --- source --------------------------------------------------------------------------

class _Raw(io.RawIOBase):
    """A pyarrow or gzip file as a raw stream, for buffering."""

    def __init__(self, stream) -> None:
        self.stream = stream

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        found = self.stream.read(len(into))
        into[: len(found)] = found
        return len(found)

    def seek(self, offset: int, whence: int = io.SEEK_SET) -> int:
        self.stream.seek(offset, whence)
        return self.stream.tell()

    def tell(self) -> int:
        return self.stream.tell()


@dataclass
class FilePart(InputPartition):
    path: str
    size: int


class WarcReader(DataSourceReader):
    def __init__(self, path: str, schema: StructType) -> None:
        self.path, self.columns = path, schema.fieldNames()
        self.filters: list[Filter] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for wanted in filters:
            if predicate(wanted):
                self.filters.append(wanted)
            else:
                yield wanted

    def partitions(self) -> Sequence[InputPartition]:
        """One for each file, the largest first."""
        from pyarrow import fs

        system, path = file_system(self.path)
        base = self.path.rstrip("/")
        if system.get_file_info(path).type == fs.FileType.File:
            return [FilePart(self.path, 0)]
        there = [i for i in system.get_file_info(fs.FileSelector(path)) if i.type == fs.FileType.File]
        if any(i.base_name.startswith(LISTING) for i in there):
            found = current_files(system, path, [i.base_name for i in there])
        else:
            found = [[i.base_name, i.size] for i in there if i.base_name.endswith((".warc", ".warc.gz"))]
        parts = [FilePart(f"{base}/{name}", size) for name, size in found]
        return sorted(parts, key=lambda p: -p.size) or [FilePart("", 0)]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        tests = [predicate(f) for f in self.filters]
        kinds = pa.schema([(c, pa.binary() if c == "payload" else
                            pa.int64() if c == "payload_length" else pa.string())
                           for c in self.columns])
        system, path = file_system(partition.path)
        with system.open_input_file(path) as raw:
            stream = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
            rows, size = [], 0
            for row in self._records(io.BufferedReader(_Raw(stream), 1 << 18), tests):
                rows.append(row)
                size += len(row.get("payload") or b"") + 512
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, kinds)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, kinds)

    def _records(self, stream: io.BufferedReader, tests: list) -> Iterator[dict]:
        while (header := read_header(stream)) is not None:
            length = int(header.get("content-length", 0))
            row = header_row(header)
            if not all(test(row) for test in tests):
                stream.seek(length, io.SEEK_CUR)
                continue
            if "payload" in self.columns:
                row["payload"] = payload_of(stream.read(length), header)
            else:
                stream.seek(length, io.SEEK_CUR)
            yield {c: row.get(c) for c in self.columns}


def listings(system, path: str, names: list[str]) -> dict[str, dict]:
    """The lists of a folder that no other list replaces."""
    held = {}
    for name in names:
        if name.startswith(LISTING):
            with system.open_input_stream(f"{path}/{name}") as stream:
                held[name] = json.loads(stream.read())
    replaced = {old for own in held.values() for old in own["replaces"]}
    return {name: own for name, own in held.items() if name not in replaced}


def current_files(system, path: str, names: list[str]) -> list[list]:
    return [file for own in listings(system, path, names).values() for file in own["files"]]


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, path: str, file_bytes: int, overwrite: bool = False) -> None:
        self.path, self.file_bytes, self.overwrite = path, file_bytes, overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        made, stream, size = [], None, 0
        for batch in iterator:
            for row in batch.to_pylist():
                if stream is None:
                    made.append([f"part-{uuid.uuid4().hex}.warc", 0])
                    stream, size = system.open_output_stream(f"{path}/{made[-1][0]}"), 0
                record = record_bytes(row)
                stream.write(record)
                size += len(record)
                made[-1][1] = size
                if size >= self.file_bytes:
                    stream.close()
                    stream = None
        if stream is not None:
            stream.close()
        return Written(made)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        from pyarrow import fs

        system, path = file_system(self.path)
        system.create_dir(path, recursive=True)
        names = [i.base_name for i in system.get_file_info(fs.FileSelector(path))]
        own = {"files": [f for m in messages if m for f in m.files],
               "replaces": sorted(listings(system, path, names)) if self.overwrite else []}
        with system.open_output_stream(f"{path}/{LISTING}{uuid.uuid4().hex}.json") as stream:
            stream.write(json.dumps(own).encode())

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        """Files without a list are left; nobody reads them."""


@dataclass
class Written(WriterCommitMessage):
    files: list


class WarcSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return WarcReader(self.options["path"], schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WarcWriter(
            self.options["path"], int(self.options.get("filebytes", 128 << 20)), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known and lets filters reach Python sources."""
    spark.dataSource.register(WarcSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


# --- pages ---------------------------------------------------------------------------

def as_records(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html",
    least: int = 1000, date: str = "2024-01-01T00:00:00Z",
) -> DataFrame:
    """A record for each page. Of equal payloads of at least ``least`` bytes the one with the
    largest id is a response (all rows with that id, if it is repeated), the others revisit
    it. Pages without an id revisit like others; if no page of equal ones has an id, all are
    responses."""
    payload = F.coalesce(F.encode(F.col(html), "UTF-8"), F.lit(b""))
    rows = pages.select(F.col(key).alias("page"), F.col(url).alias("target_uri"),
                        payload.alias("payload")).select(
        "*", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("bytes"))
    # Written, so that the join below is planned by the table's real size: few repeated
    # payloads go to every task, and no payload is shuffled; many are joined by a shuffle.
    repeated = (
        rows.filter(F.col("bytes") >= least).groupBy("digest")
        .agg(F.max("page").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    )
    first = written(repeated, "digests")
    revisit = F.coalesce(~F.col("page").eqNullSafe(F.col("first")) & F.col("first").isNotNull(),
                         F.lit(False))
    name = lambda c: F.concat(F.lit("urn:page:"), F.col(c).cast("string"))
    return rows.join(first, "digest", "left").select(
        name("page").alias("record_id"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        "target_uri", F.lit(date).alias("date"),
        F.concat(F.lit("sha1:"), "digest").alias("payload_digest"),
        F.col("bytes").alias("payload_length"),
        F.when(revisit, name("first")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"))


def archive(records: DataFrame, path: str, mode: str = "append") -> None:
    """Adds records to an archive, or replaces what it holds (``overwrite``)."""
    register(records.sparkSession)
    records.write.format("warc").mode(mode).save(path)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    register(spark)
    schema = SCHEMA if payload else SCHEMA.removesuffix(", payload binary")
    return spark.read.format("warc").schema(schema).load(path)


def page_round_trip(pages: DataFrame) -> DataFrame:
    """Writes the pages' records and reads them back: payloads of responses, and only the
    headers of revisits."""
    spark = pages.sparkSession
    path = fresh(spark, "archive")
    archive(as_records(pages), path)
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?\d+)$", 1).cast("long")
    responses = read(spark, path).filter(F.col("record_type") == "response").select(
        page("record_id").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"), "record_type",
        F.lit(None).cast("long").alias("refers_to"))
    revisits = read(spark, path, payload=False).filter(F.col("record_type") == "revisit").select(
        page("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"),
        F.regexp_replace("payload_digest", "^sha1:", "").alias("payload_digest"), "record_type",
        page("refers_to").alias("refers_to"))
    return responses.union(revisits)
