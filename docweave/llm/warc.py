"""Web archives (WARC) as a Spark data source, and pages as archive records with revisits.

Reading: `register_warc(spark)`, then `spark.read.format("warc").load(folder)`. The files are planned into
partitions of about `partition_bytes`. Of each record the headers are parsed first; comparisons of
header columns (`HEADER_COLUMNS`, record type among them) are pushed down and decided there, and what
they exclude is skipped by its length: in plain files by a seek, in compressed ones without being
kept. Payloads are read only if the schema asked for has `payload`; `.schema(...)` names the columns wanted.
What cannot be parsed gives one row with `error` (record columns null) and ends its file; other files
are read on. Chunked bodies are joined; content codings stay as they are.

Writing: `df.write.format("warc").save(folder)` takes `RECORD_COLUMNS` (others are ignored). Files are closed
at about `file_bytes`, get names of their own and count only once the job's manifest names them, so
a repeated or lost task leaves nothing that is read. `compression` may be `gzip` (a member per record).
A null payload gives a record without a body; control characters in headers are percent-encoded.

Null and empty pages have an empty payload; repeated rows with the least id of their payload are all
responses; rows without an id come last (all are responses if no other has their payload); an empty
table gives an archive without records.
"""

from __future__ import annotations

import gzip
import json
import os
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timezone
from typing import BinaryIO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import datasource as ds
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DocumentationError
from ..operators.requests import hot_keys, join_by_key
from ..sources.files import list_names, local_path, make_folder, read_bytes, write_text
from .common import release_memory, stored

#: Fixed values of the format: versions, field names, the profile of revisits, digests in base 32.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADER_COLUMNS = {
    "record_type": "warc-type",
    "record_id": "warc-record-id",
    "target_uri": "warc-target-uri",
    "date": "warc-date",
    "payload_digest": "warc-payload-digest",
    "refers_to": "warc-refers-to",
    "content_type": "content-type",
    "content_length": "content-length",
}
_LONG, _TEXT = T.LongType(), T.StringType()
#: The columns of an archive that is read.
SCHEMA = (
    T.StructType()
    .add("file", _TEXT)
    .add("offset", _LONG)
    .add("record_type", _TEXT)
    .add("record_id", _TEXT)
    .add("target_uri", _TEXT)
    .add("date", _TEXT)
    .add("payload_digest", _TEXT)
    .add("refers_to", _TEXT)
    .add("content_type", _TEXT)
    .add("content_length", _LONG)
    .add("headers", T.MapType(_TEXT, _TEXT))
    .add("http_status", T.IntegerType())
    .add("payload_length", _LONG)
    .add("payload", T.BinaryType())
    .add("error", _TEXT)
)
RECORD_COLUMNS = "record_type, record_id, target_uri, date, payload_digest, refers_to, payload_length, payload"
_ARROW = {
    "string": pa.string(), "bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(),
    "map<string,string>": pa.map_(pa.string(), pa.string()),
}
PARTITION_BYTES, FILE_BYTES, LEAST_SPLITS = 64 << 20, 64 << 20, 64
#: Rows and bytes that a reading task hands on at a time; bytes skipped at a time; the longest header.
BATCH_ROWS, BATCH_BYTES, STEP, HEAD_BYTES = 1024, 8 << 20, 1 << 20, 1 << 20


class _Broken(Exception):
    """The rest of a file is no record."""


def _open(path: str) -> BinaryIO:
    local = local_path(path)
    if local is not None:
        return open(local, "rb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _create(path: str) -> BinaryIO:
    local = local_path(path)
    if local is not None:
        return open(local, "wb")
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_output_stream(inner)


def _remove(path: str) -> None:
    local = local_path(path)
    if local is not None:
        if os.path.lexists(local):
            os.unlink(local)
        return
    system, inner = fs.FileSystem.from_uri(path)
    if system.get_file_info(inner).type != fs.FileType.NotFound:
        system.delete_file(inner)


def _size(path: str) -> int:
    local = local_path(path)
    if local is not None:
        return os.path.getsize(local)
    system, inner = fs.FileSystem.from_uri(path)
    return system.get_file_info(inner).size


class _Records:
    """Steps over the records of one file; a payload is read or skipped, never both."""

    def __init__(self, path: str) -> None:
        self.raw = _open(path)
        packed = self.raw.read(2) == b"\x1f\x8b"
        self.raw.seek(0)
        self.seekable = not packed
        # Of a compressed file what is there by one step, so that a cut end does not hide what stands before.
        self.more = gzip.GzipFile(fileobj=self.raw).read1 if packed else self.raw.read
        #: Bytes read ahead, how many of them are used, and where in the file the next and the last line begin.
        self.held, self.used, self.at, self.line_at = b"", 0, 0, 0

    def close(self) -> None:
        self.raw.close()

    def line(self) -> bytes | None:
        """The next line without its end; None at the end of the file."""
        while (end := self.held.find(b"\n", self.used)) < 0:
            if len(self.held) - self.used > HEAD_BYTES:
                raise _Broken("a header line has no end")
            more = self.more(1 << 16)
            if not more:
                if self.used < len(self.held):
                    raise _Broken("the file ends within a header")
                return None
            self.held, self.used = self.held[self.used :] + more, 0
        line = self.held[self.used : end]
        self.line_at, self.at, self.used = self.at, self.at + end + 1 - self.used, end + 1
        return line.rstrip(b"\r")

    def _from_held(self, size: int) -> bytes:
        part = self.held[self.used : self.used + size]
        self.used += len(part)
        self.at += size
        return part

    def read(self, size: int) -> bytes:
        parts = [self._from_held(size)]
        left = size - len(parts[0])
        while left:
            part = self.more(min(left, STEP))
            if not part:
                raise _Broken("the file ends within a record")
            parts.append(part)
            left -= len(part)
        return b"".join(parts)

    def skip(self, size: int) -> None:
        left = size - len(self._from_held(size))
        if left and self.seekable:
            # The last byte is read, so that a cut file is noticed.
            self.raw.seek(left - 1, os.SEEK_CUR)
            if not self.raw.read(1):
                raise _Broken("the file ends within a record")
            left = 0
        while left:
            part = self.more(min(left, STEP))
            if not part:
                raise _Broken("the file ends within a record")
            left -= len(part)

    def fields(self) -> list[tuple[str, str]]:
        """Header fields up to the empty line, names in lower case, continued lines joined."""
        found: list[tuple[str, str]] = []
        start = self.at
        while line := self.line():
            if self.at - start > HEAD_BYTES:
                raise _Broken("a header has no end")
            text = line.decode("utf-8", "replace")
            if text[0] in " \t" and found:
                found[-1] = (found[-1][0], f"{found[-1][1]} {text.strip()}")
                continue
            name, _, value = text.partition(":")
            found.append((name.strip().lower(), value.strip()))
        return found


def _joined_chunks(body: bytes) -> bytes:
    """The body of a chunked transfer; as it is if it is not one."""
    parts, at = [], 0
    while (end := body.find(b"\r\n", at)) >= 0:
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return body
        if size == 0:
            return b"".join(parts)
        parts.append(body[end + 2 : end + 2 + size])
        at = end + 2 + size + 2
    return body


def _columns_of(headers: dict[str, str]) -> dict[str, str | int | None]:
    made: dict[str, str | int | None] = {name: headers.get(key) for name, key in HEADER_COLUMNS.items()}
    for name in ("record_id", "refers_to", "target_uri"):
        if made[name]:
            made[name] = str(made[name]).removeprefix("<").removesuffix(">")
    if made["payload_digest"]:
        made["payload_digest"] = str(made["payload_digest"]).removeprefix("sha1:")
    try:
        made["content_length"] = int(headers["content-length"])
    except (KeyError, ValueError):
        raise _Broken("a record without a Content-Length") from None
    if made["content_length"] < 0:
        raise _Broken("a negative Content-Length")
    return made


def matches(one: ds.Filter, row: dict) -> bool | None:
    """SQL's value of a pushed comparison: true, false or unknown."""
    if isinstance(one, ds.Not):
        inner = matches(one.child, row)
        return None if inner is None else not inner
    value = row[one.attribute[0]]
    if isinstance(one, ds.IsNull):
        return value is None
    if isinstance(one, ds.IsNotNull):
        return value is not None
    if isinstance(one, ds.EqualNullSafe):
        return value == one.value
    if isinstance(one, ds.In):
        if value is None:
            return None
        return True if value in [v for v in one.value if v is not None] else (None if None in one.value else False)
    if value is None or one.value is None:
        return None
    return _COMPARED[type(one)](value, one.value)


_COMPARED: dict[type, Callable] = {
    ds.EqualTo: lambda a, b: a == b,
    ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b,
    ds.LessThan: lambda a, b: a < b,
    ds.LessThanOrEqual: lambda a, b: a <= b,
    ds.StringStartsWith: lambda a, b: a.startswith(b),
    ds.StringEndsWith: lambda a, b: a.endswith(b),
    ds.StringContains: lambda a, b: b in a,
}
_DECIDED = (*_COMPARED, ds.In, ds.IsNull, ds.IsNotNull, ds.EqualNullSafe)


def _decided_by_headers(one: ds.Filter) -> bool:
    if isinstance(one, ds.Not):
        return _decided_by_headers(one.child)
    return isinstance(one, _DECIDED) and len(one.attribute) == 1 and one.attribute[0] in HEADER_COLUMNS


@dataclass
class _Files(ds.InputPartition):
    paths: list[str] = field(default_factory=list)

    def __init__(self, paths: list[str]) -> None:
        super().__init__(None)
        self.paths = paths


class WarcReader(ds.DataSourceReader):
    def __init__(self, options: dict, schema: T.StructType) -> None:
        self.folder = options["path"].rstrip("/")
        self.partition_bytes = int(options.get("partition_bytes", PARTITION_BYTES))
        self.names = schema.names
        unknown = set(self.names) - set(SCHEMA.names)
        if unknown:
            raise DocumentationError(f"archives have no columns {sorted(unknown)}")
        self.kinds = [_ARROW[f.dataType.simpleString()] for f in schema]
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters: list[ds.Filter]) -> Iterable[ds.Filter]:
        for one in filters:
            if _decided_by_headers(one):
                self.filters.append(one)
            else:
                yield one

    def partitions(self) -> list[_Files]:
        """Whole files, about `partition_bytes` each; of little data, at most `LEAST_SPLITS` parts."""
        found = archive_files(self.folder)
        bound = min(self.partition_bytes, max(1 << 20, sum(size for _, size in found) // LEAST_SPLITS))
        parts: list[list[str]] = []
        filled = bound
        for path, size in found:
            if filled + size > bound and filled:
                parts.append([])
                filled = 0
            parts[-1].append(path)
            filled += max(size, 1)
        return [_Files(paths) for paths in parts] or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0
        for path in partition.paths:
            for row in self.rows(path):
                held.append(row)
                size += len(row.get("payload") or b"") + 500
                if len(held) >= BATCH_ROWS or size >= BATCH_BYTES:
                    yield self._batch(held)
                    held, size = [], 0
        if held:
            yield self._batch(held)
        release_memory()

    def _batch(self, rows: list[dict]) -> pa.RecordBatch:
        arrays = [pa.array([row.get(name) for row in rows], kind) for name, kind in zip(self.names, self.kinds)]
        return pa.RecordBatch.from_arrays(arrays, self.names)

    def rows(self, path: str) -> Iterator[dict]:
        """The wanted records of one file."""
        records, start = _Records(path), 0
        try:
            while True:
                line = records.line()
                while line == b"":
                    line = records.line()
                if line is None:
                    return
                start = records.line_at
                if not line.startswith(b"WARC/"):
                    raise _Broken("a record does not begin with its version")
                headers = dict(records.fields())
                row = _columns_of(headers)
                left = row["content_length"]
                if not all(matches(one, row) for one in self.filters):
                    records.skip(left)
                    continue
                row |= {"file": path, "offset": start, "headers": list(headers.items())}
                yield self._with_body(records, row, left)
        except (_Broken, EOFError, gzip.BadGzipFile, zlib.error) as exc:
            broken: dict = dict.fromkeys(HEADER_COLUMNS)
            if all(matches(one, broken) for one in self.filters):
                yield {"file": path, "offset": start, "error": str(exc) or type(exc).__name__}
        finally:
            records.close()

    def _with_body(self, records: _Records, row: dict, left: int) -> dict:
        wants = {"payload", "payload_length", "http_status"} & set(self.names)
        if not wants:
            records.skip(left)
            return row
        chunked, said = False, None
        if str(row["content_type"] or "").startswith("application/http") and left:
            start = records.at
            status = (records.line() or b"").split()
            fields = dict(records.fields())
            left -= records.at - start
            if left < 0:
                raise _Broken("an HTTP header goes beyond its record")
            row["http_status"] = int(status[1]) if len(status) > 1 and status[1].isdigit() else None
            chunked = "chunked" in fields.get("transfer-encoding", "").lower()
            said = fields.get("content-length")
        if row["record_type"] == "revisit":
            # Only the headers of the response are there; they tell the length of its body.
            row["payload_length"] = int(said) if said and said.isdigit() else None
            records.skip(left)
        elif "payload" in self.names or chunked:
            body = records.read(left)
            body = _joined_chunks(body) if chunked else body
            row |= {"payload": body, "payload_length": len(body)}
        else:
            row["payload_length"] = left
            records.skip(left)
        return row


def archive_files(folder: str) -> list[tuple[str, int]]:
    """Paths and sizes: those that manifests name, or all archives of a folder without any."""
    if folder.endswith((".warc", ".warc.gz")):
        return [(folder, _size(folder))]
    names = list_names(folder, only_folders=False)
    manifests = sorted(name for name in names if name.startswith("_manifest-"))
    if manifests:
        listed = [entry for name in manifests for entry in json.loads(read_bytes(f"{folder}/{name}"))]
        return [(f"{folder}/{name}", size) for name, size in listed]
    found = sorted(name for name in names if name.endswith((".warc", ".warc.gz")))
    return [(f"{folder}/{name}", _size(f"{folder}/{name}")) for name in found]


@dataclass
class _Written(ds.WriterCommitMessage):
    files: list[tuple[str, int]]


def _escaped(value: object) -> str:
    return "".join(f"%{ord(c):02X}" if c < " " or c == "\x7f" else c for c in str(value))


def record_bytes(row: dict) -> bytes:
    """One record: its header, the head of an HTTP response, and the payload unless it is null."""
    payload, body = row.get("payload"), b""
    fields = [("WARC-Type", row.get("record_type") or "resource")]
    named = [("WARC-Record-ID", "record_id"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date")]
    named += [("WARC-Payload-Digest", "payload_digest"), ("WARC-Refers-To", "refers_to")]
    for name, column in named:
        value = row.get(column)
        if value is not None:
            value = _escaped(value)
            if column in ("record_id", "refers_to"):
                value = f"<{value}>"
            fields.append((name, f"sha1:{value}" if column == "payload_digest" else value))
    if row.get("record_type") == "revisit":
        fields.append(("WARC-Profile", PROFILE))
    if row.get("record_type") in ("response", "revisit"):
        length = row.get("payload_length")
        length = len(payload or b"") if length is None else length
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
        fields.append(("Content-Type", "application/http;msgtype=response"))
    else:
        fields.append(("Content-Type", "application/octet-stream"))
    body += payload or b""
    fields.append(("Content-Length", str(len(body))))
    head = "".join(f"{name}: {value}\r\n" for name, value in fields)
    return b"".join([f"{VERSION}\r\n{head}\r\n".encode(), body, b"\r\n\r\n"])


class WarcWriter(ds.DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.folder = options["path"].rstrip("/")
        self.file_bytes = int(options.get("file_bytes", FILE_BYTES))
        self.packed = options.get("compression", "none") == "gzip"
        self.overwrite = overwrite
        make_folder(self.folder)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        done: list[tuple[str, int]] = []
        now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
        name, file, size = "", None, 0
        for batch in iterator:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if file is None:
                    name = f"part-{uuid.uuid4().hex}.warc{'.gz' if self.packed else ''}"
                    file, size = _create(f"{self.folder}/{name}"), 0
                one = record_bytes({"date": now, **{k: v for k, v in row.items() if k != "date" or v}})
                one = gzip.compress(one, 6) if self.packed else one
                file.write(one)
                size += len(one)
                if size >= self.file_bytes:
                    file.close()
                    done.append((name, size))
                    file = None
        if file is not None:
            file.close()
            done.append((name, size))
        release_memory()
        return _Written(done)

    def commit(self, messages: list[_Written | None]) -> None:
        before = [n for n in list_names(self.folder, only_folders=False) if n.startswith("_manifest-")]
        made = sorted(entry for message in messages if message for entry in message.files)
        write_text(f"{self.folder}/_manifest-{uuid.uuid4().hex}", json.dumps(made))
        if self.overwrite:
            for name in before:
                for old, _ in json.loads(read_bytes(f"{self.folder}/{name}")):
                    _remove(f"{self.folder}/{old}")
                _remove(f"{self.folder}/{name}")

    def abort(self, messages: list[_Written | None]) -> None:
        for message in messages:
            for name, _ in message.files if message else []:
                _remove(f"{self.folder}/{name}")


class Warc(ds.DataSource):
    """Options: `path`; reading `partition_bytes`; writing `file_bytes` and `compression` (none, gzip)."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> T.StructType:
        return SCHEMA

    def reader(self, schema: T.StructType) -> ds.DataSourceReader:
        return WarcReader(dict(self.options), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ds.DataSourceArrowWriter:
        return WarcWriter(dict(self.options), overwrite)


def register_warc(spark: SparkSession) -> None:
    spark.dataSource.register(Warc)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read_warc(spark: SparkSession, folder: str, columns: list[str] | None = None) -> DataFrame:
    """Records of an archive; of `columns` only, and payloads are not read unless they are among them."""
    register_warc(spark)
    wanted = SCHEMA if columns is None else T.StructType([SCHEMA[name] for name in columns])
    return spark.read.format("warc").schema(wanted).load(folder)


def write_warc(records: DataFrame, folder: str, **options) -> None:
    register_warc(records.sparkSession)
    wanted = records.select(*RECORD_COLUMNS.split(", "))
    wanted.write.format("warc").mode("append").options(**options).save(folder)


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in base 32, the usual form of payload digests: 20 bits give four characters."""
    hexed = F.sha1(payload)

    def four(at: Column) -> Column:
        bits = F.conv(F.substring(hexed, at * 5 + 1, F.lit(5)), 16, 10).cast("int")
        picked = [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
        return F.concat(*picked)

    return F.concat(*[four(F.lit(at)) for at in range(8)])


def page_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One record per page: of equal payloads the one with the least key is the response, the others
    revisit it without a payload.

    Digests and keys are aggregated; payloads move once, to the answer for their digest, and the
    digests with more rows than an average task are salted."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).alias("key"), F.col(url).alias("target_uri"), payload.alias("payload"))
    rows = rows.withColumn("cache_key", F.sha2("payload", 256))
    firsts = rows.groupBy("cache_key").agg(F.min("key").alias("first"), F.count("*").alias("uses"))
    firsts = stored(firsts, "payloads")
    total = firsts.agg(F.sum("uses")).first()[0] or 0
    slices = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    repeated = firsts.where("uses > 1")
    answered = join_by_key(rows, repeated, hot_keys(repeated, total, slices), F.col("key"))
    response = F.col("uses").isNull() | F.col("key").eqNullSafe(F.col("first"))

    def named(column: Column) -> Column:
        return F.concat(F.lit("urn:page:"), F.coalesce(column.cast("string"), F.lit("")))

    return answered.select(
        F.when(response, "response").otherwise("revisit").alias("record_type"),
        named(F.col("key")).alias("record_id"),
        "target_uri",
        F.lit(None).cast("string").alias("date"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        F.when(~response, named(F.col("first"))).alias("refers_to"),
        F.octet_length("payload").cast("bigint").alias("payload_length"),
        F.when(response, F.col("payload")).alias("payload"),
    )


def pages_of(spark: SparkSession, folder: str) -> DataFrame:
    """Pages read back: key (a string), payload_bytes, payload_digest, record_type and refers_to.

    The bytes and the digest of a response are counted from its payload; those of a revisit are what its
    headers say, and its payload is not looked at."""

    def key(column: str) -> Column:
        found = F.regexp_extract(column, "^urn:page:(.+)$", 1)
        return F.when(found != "", found)

    responses = read_warc(spark, folder, ["record_type", "record_id", "payload"])
    responses = responses.where("record_type = 'response'").select(
        key("record_id").alias("key"),
        F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.lit(None).cast("string").alias("refers_to"),
    )
    revisits = read_warc(
        spark, folder, ["record_type", "record_id", "payload_length", "payload_digest", "refers_to"]
    )
    revisits = revisits.where("record_type = 'revisit'").select(
        key("record_id").alias("key"),
        F.col("payload_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        key("refers_to").alias("refers_to"),
    )
    return responses.unionByName(revisits)
