"""Source files as rows, and rows as source files.

Spark's own file readers hide names that start with ``_``, hence ``__init__.py``.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from heapq import nsmallest
from itertools import islice
from zlib import crc32

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceReader,
    DataSourceStreamReader,
    DataSourceWriter,
    EqualTo,
    Filter,
    In,
    InputPartition,
    IsNotNull,
    StringStartsWith,
    WriterCommitMessage,
)

from ..config import DocumentationError
from ..functions.text import normalise_code
from .files import change_time, exists, make_folder, read_bytes, replace_text, write_text
from .globs import expand_component, split_rule, spread

_FILE = pa.schema([("path", pa.string()), ("content", pa.binary()), ("error", pa.string())])
_FILE_DDL = "path STRING, content BINARY, error STRING"
_COLUMNS = ("path", "content", "error", "changed")
_DONE = pa.schema([("path", pa.string()), ("written_path", pa.string()), ("error", pa.string())])
_DONE_DDL = "path STRING, written_path STRING, error STRING"
BATCH_BYTES = 32 << 20
REPORTED_ERRORS = 20


def read_file(path: str) -> dict:
    try:
        return {"path": path, "content": read_bytes(path), "error": None}
    except OSError as exc:
        return {"path": path, "content": None, "error": f"{type(exc).__name__}: {exc}"}


def read_sources(paths: DataFrame, placed: bool = False) -> DataFrame:
    """``(path, content, error)``; an unreadable file keeps its row and gets an error.

    Paths are spread over all tasks first, unless the caller has placed them already.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                rows.append(read_file(path))
                size += len(rows[-1]["content"] or b"")
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_FILE)
                    rows, size = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema=_FILE)

    listed = paths.select("path") if placed else spread(paths.select("path"), "path")
    return listed.mapInArrow(read, _FILE_DDL)


def decode_sources(files: DataFrame, digest: bool = False) -> DataFrame:
    """``content`` to ``code``, normalised; NULL where it is not UTF-8. ``digest``: of the bytes as read."""
    text = F.try_validate_utf8(F.col("content").cast("string"))
    decoded = files.withColumn("code", normalise_code(text))
    if digest:
        decoded = decoded.withColumn("digest", F.sha2("content", 256))
    return decoded.drop("content")


def write_error(path: str | None, code: str | None, expected: str | None = None) -> str | None:
    """Write one file; what went wrong, if anything."""
    try:
        if path is None or code is None:
            raise ValueError("a file needs a path and code")
        if expected is None:
            write_text(path, code)
        else:
            replace_text(path, code, expected)
    except (OSError, ValueError) as exc:
        return f"{type(exc).__name__}: {exc}"
    return None


def write_sources(outputs: DataFrame) -> DataFrame:
    """Write ``code`` to ``written_path``: ``(path, written_path, error)`` per row.

    Each evaluation writes the files; a file that cannot be written gets an error. Where a column
    ``digest`` is not NULL, only a file that still has it is replaced.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for row in batch.to_pylist():
                error = write_error(row["written_path"], row["code"], row.get("digest"))
                done.append(
                    {"path": row["path"], "written_path": row["written_path"], "error": error}
                )
            yield pa.RecordBatch.from_pylist(done, schema=_DONE)

    digest = ["digest"] if "digest" in outputs.columns else []
    return outputs.select("path", "written_path", "code", *digest).mapInArrow(write, _DONE_DDL)


class _Split(InputPartition):
    """A folder and what is left of the rule below it; of the names there, one share of ``shares``."""

    def __init__(self, prefix: str, rest: list[str], share: int = 0, shares: int = 1) -> None:
        self.prefix, self.rest, self.share, self.shares = prefix, rest, share, shares


class CodeFilesReader(DataSourceReader):
    """Comparisons of ``path`` are decided here: folders that cannot hold a wanted path are not listed, and
    files that are not wanted are not opened. Contents are read only if the schema has ``content``."""

    def __init__(self, options: dict, names: Sequence[str] = ("path", "content", "error")) -> None:
        if set(names) - set(_COLUMNS):
            raise DocumentationError(f"code files have the columns {', '.join(_COLUMNS)}")
        self.rule, self.names = options["path"], list(names)
        self.recursive = options.get("recursive", "false").lower() == "true"
        self.content = options.get("content", "true").lower() == "true" and "content" in names
        self.splits = int(options.get("splits", "256"))
        #: Paths wanted by equality (None: any), and beginnings that a path must have.
        self.wanted: set[str] | None = None
        self.beginnings: list[str] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for one in filters:
            if isinstance(one, (EqualTo, In)) and one.attribute == ("path",):
                values = {one.value} if isinstance(one, EqualTo) else set(one.value)
                values.discard(None)
                self.wanted = values if self.wanted is None else self.wanted & values
            elif isinstance(one, StringStartsWith) and one.attribute == ("path",):
                self.beginnings.append(one.value)
            elif not (isinstance(one, IsNotNull) and one.attribute == ("path",)):
                yield one

    def _holds(self, path: str) -> bool:
        """Whether a file is wanted."""
        return (self.wanted is None or path in self.wanted) and all(map(path.startswith, self.beginnings))

    def _may_hold(self, folder: str) -> bool:
        """Whether a wanted path can begin with this."""
        near = all(folder.startswith(b) or b.startswith(folder) for b in self.beginnings)
        return near and (self.wanted is None or any(path.startswith(folder) for path in self.wanted))

    def _expanded(self, prefix: str, rest: list[str]) -> Iterator[tuple[str, list[str]]]:
        """One step of the rule, without what no wanted path can come from."""
        if not self._may_hold(prefix):
            return
        for path, left in expand_component(prefix, rest, self.recursive):
            if self._may_hold(path) if left else self._holds(path):
                yield path, left

    def row(self, path: str) -> tuple:
        found: dict = read_file(path) if self.content else {"path": path}
        if "changed" in self.names:
            found["changed"] = change_time(path)
        return tuple(found.get(name) for name in self.names)

    def partitions(self) -> list[_Split]:
        """Expand folders only until there are enough splits; executors do the rest.

        A step of the expansion stops at ``splits`` folders too: what is not expanded then stays a
        split of its own, so the driver never holds more than twice that number. With fewer
        folders than splits, the names in each are dealt to several splits by their hash.
        """
        prefix, rest = split_rule(self.rule)
        if not rest:
            folder, _, name = prefix.rpartition("/")
            prefix, rest = (folder + "/" if "/" in prefix else ""), [name]
        level = [(prefix, rest)]
        while 0 < len(level) < self.splits and len(level[0][1]) > 1 and level[0][1][0] != "**":
            further: list[tuple[str, list[str]]] = []
            for p, r in level:
                found = list(islice(self._expanded(p, r), self.splits + 1))
                if len(further) + len(found) > self.splits:
                    return self._shared(level)
                further += found
            level = further
        return self._shared(level) or [_Split("", [])]

    def _shared(self, level: list[tuple[str, list[str]]]) -> list[_Split]:
        shares = max(1, self.splits // max(len(level), 1))
        return [_Split(p, r, share, shares) for p, r in level for share in range(shares)]

    def read(self, partition: _Split) -> Iterator[tuple]:
        return map(self.row, self.paths(partition))

    def paths(self, partition: _Split) -> Iterator[str]:
        first = (partition.prefix, partition.rest)
        pending = [first] if partition.rest else []
        while pending:
            step = pending.pop()
            for prefix, rest in self._expanded(*step):
                if step is first and crc32(prefix.encode("utf-8", "surrogateescape")) % partition.shares != partition.share:
                    continue
                if rest:
                    pending.append((prefix, rest))
                else:
                    yield prefix


@dataclass
class _Listed(InputPartition):
    paths: list[str]


class CodeFilesStreamReader(DataSourceStreamReader):
    """New and changed files of a rule, in the order of their change times.

    A mark is the change time and path of the last file admitted; a batch is what lies between two
    marks, so it can be read again, and nothing is remembered but the mark. It is kept in the folder
    ``log``, since a reader is not told where its query goes on. Files are admitted ``settle`` seconds after
    their change, when no other with that time can appear; at most ``max_files`` in a batch. A file
    that changes before its batch is read comes in a later one.
    """

    def __init__(self, options: dict, names: Sequence[str]) -> None:
        if "log" not in options:
            raise DocumentationError("a stream of code files needs a folder for its mark: option log")
        self.files = CodeFilesReader(options, names)
        self.log = options["log"].rstrip("/")
        self.max_files = int(options.get("max_files", "10000"))
        self.settle = float(options.get("settle", "1"))
        self.listed: tuple[dict, dict, list[str]] | None = None

    def initialOffset(self) -> dict:
        return {"changed": 0, "path": ""}

    def _between(self, start: dict, end: tuple[int, str]) -> Iterator[tuple[int, str]]:
        after = (start["changed"], start["path"])
        for path in self.files.paths(_Split(*self._rule())):
            changed = change_time(path)
            if changed is not None and after < (changed, path) <= end:
                yield changed, path

    def _rule(self) -> tuple[str, list[str]]:
        prefix, rest = split_rule(self.files.rule)
        if not rest:
            folder, _, name = prefix.rpartition("/")
            prefix, rest = (folder + "/" if "/" in prefix else ""), [name]
        return prefix, rest

    def latestOffset(self) -> dict:
        name = f"{self.log}/mark.json"
        mark = json.loads(read_bytes(name)) if exists(name) else self.initialOffset()
        settled = time.time_ns() - int(self.settle * 1e9)
        found = nsmallest(self.max_files, self._between(mark, (settled, "")))
        if not found:
            return mark
        last = {"changed": found[-1][0], "path": found[-1][1]}
        # Written first: if the query is lost before it has noted this mark, its next batch goes further.
        make_folder(self.log)
        write_text(name, json.dumps(last))
        self.listed = (mark, last, [path for _, path in found])
        return last

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        if self.listed is not None and self.listed[:2] == (start, end):
            paths = self.listed[2]
        else:
            paths = [path for _, path in sorted(self._between(start, (end["changed"], end["path"])))]
        step = max(1, -(-len(paths) // self.files.splits))
        return [_Listed(paths[at : at + step]) for at in range(0, len(paths), step)] or [_Listed([])]

    def read(self, partition: _Listed) -> Iterator[tuple]:
        return map(self.files.row, partition.paths)

    def commit(self, end: dict) -> None:
        """Nothing to forget: the mark is all there is."""


@dataclass
class _Written(WriterCommitMessage):
    errors: list[str]


class CodeFilesWriter(DataSourceWriter):
    """Writes every row it can; the job fails at the end if any could not be written."""

    def __init__(self, overwrite: bool) -> None:
        self.overwrite = overwrite

    def write(self, iterator) -> WriterCommitMessage:
        errors = []
        for row in iterator:
            path = row["written_path"]
            kept = not self.overwrite and path is not None and exists(path)
            error = f"{path} is there already" if kept else write_error(path, row["code"])
            if error and len(errors) < REPORTED_ERRORS:
                errors.append(error)
        return _Written(errors)

    def commit(self, messages) -> None:
        if errors := [error for message in messages if message for error in message.errors]:
            raise DocumentationError(f"not written: {'; '.join(errors[:REPORTED_ERRORS])}")


class CodeFiles(DataSource):
    """``spark.read.format("code_files").load("src/*.py")``, and the matching writer.

    Read options: ``recursive``, ``content`` (false lists paths only), ``splits``; as a stream also
    ``log``, ``max_files`` and ``settle``. A schema without ``content`` lists paths only too; one with ``changed
    BIGINT`` has the time of a file's last change. ``path`` comparisons are pushed down.
    Written rows need ``written_path`` and ``code``; mode ``overwrite`` replaces files, ``append``
    leaves a file that is there alone and reports it.
    """

    @classmethod
    def name(cls) -> str:
        return "code_files"

    def schema(self) -> str:
        return _FILE_DDL

    def reader(self, schema) -> DataSourceReader:
        return CodeFilesReader(dict(self.options), schema.names)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return CodeFilesStreamReader(dict(self.options), schema.names)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return CodeFilesWriter(overwrite)


def register_source(spark: SparkSession) -> None:
    spark.dataSource.register(CodeFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
