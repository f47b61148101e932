"""Include and exclude rules: globs to paths, and the algebra between the two sets."""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DocumentationError
from ..workspace import new_run_folder
from .files import exists, list_names

_MAGIC = frozenset("*?[")
_BELOW = "**/"  # a ** that has gone down a folder; no path component can contain a slash
_STEP = pa.schema([("prefix", pa.string()), ("rest", pa.list_(pa.string()))])
_STEP_DDL = "prefix STRING, rest ARRAY<STRING>"


def split_rule(rule: str) -> tuple[str, list[str]]:
    """The part of a rule before its first wildcard, and the components after it."""
    parts = rule.split("/")
    for index, part in enumerate(parts):
        if _MAGIC & set(part):
            return "/".join(parts[:index]) + ("/" if index else ""), parts[index:]
    return rule, []


def expand_component(prefix: str, rest: list[str], recursive: bool) -> Iterator[tuple[str, list]]:
    """One step of a glob: the next component of ``rest`` matched below ``prefix``.

    Same rules as Python's ``glob``: wildcards never match a leading dot, paths keep the
    rule's own spelling, and ``**`` is a plain ``*`` unless ``recursive``.
    """
    head, tail = rest[0], rest[1:]
    if not _MAGIC & set(head):
        path = prefix + head
        if tail:
            yield path + "/", tail
        elif exists(path):
            yield path, []
        return
    if recursive and head in ("**", _BELOW):
        # No folder at all, or any visible one and the same again below it.
        if tail:
            yield from expand_component(prefix, tail, recursive)
        else:
            if head == "**" and prefix and exists(prefix):
                yield prefix, []
            yield from expand_component(prefix, ["*"], recursive)
        for name in list_names(prefix, only_folders=True):
            if not name.startswith("."):
                yield prefix + name + "/", [_BELOW, *tail]
        return
    names = list_names(prefix, only_folders=bool(tail))
    if not head.startswith("."):
        names = [name for name in names if not name.startswith(".")]
    for name in fnmatch.filter(names, head):
        yield (prefix + name + "/", tail) if tail else (prefix + name, [])


def expand_rules(spark: SparkSession, rules: list[str], recursive: bool = False) -> DataFrame:
    """``(path)`` of everything the rules match, a row per match and rule.

    Folders are listed by the executors, one wildcard component per step, so neither a
    list of files nor one of folders ever passes through the driver.
    """
    steps = [split_rule(rule) for rule in rules]
    for index, (prefix, rest) in enumerate(steps):
        if not rest:  # a plain path: only its last component has to exist
            folder, _, name = prefix.rpartition("/")
            steps[index] = (folder + "/" if "/" in prefix else "", [name])
    found = spark.createDataFrame(steps, _STEP_DDL)

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if not row["rest"]:
                    yield pa.RecordBatch.from_pylist([row], schema=_STEP)
                    continue
                chunk = []
                for prefix, rest in expand_component(row["prefix"], row["rest"], recursive):
                    chunk.append({"prefix": prefix, "rest": rest})
                    if len(chunk) == 10_000:
                        yield pa.RecordBatch.from_pylist(chunk, schema=_STEP)
                        chunk = []
                yield pa.RecordBatch.from_pylist(chunk, schema=_STEP)

    for _ in range(max((len(rest) for _, rest in steps), default=0)):
        found = spread(found, "prefix").mapInArrow(step, _STEP_DDL)
    if recursive and any("**" in rest for _, rest in steps):
        found = _descend(found, step)
    return found.select(F.col("prefix").alias("path"))


def spread(rows: DataFrame, by: str) -> DataFrame:
    """Small rows that stand for work on files, in as many tasks as a shuffle has.

    With a number of their own, and on a key that no other exchange has, so that neither the
    optimizer drops this one nor adaptive execution merges its partitions by their few bytes.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(slices, F.xxhash64(by, F.lit("files")))


def _descend(found: DataFrame, step) -> DataFrame:
    """Go on, one folder level at a time, until no folder is left open."""
    _, folder = new_run_folder(found.sparkSession)
    read, depth = found.sparkSession.read.schema(_STEP_DDL), 0
    found.write.parquet(f"{folder}/depth=0")
    while True:
        level = read.parquet(f"{folder}/depth={depth}")
        opened = level.where(F.size("rest") > 0)
        if opened.isEmpty():
            break
        depth += 1
        stepped = spread(opened, "prefix").mapInArrow(step, _STEP_DDL)
        stepped.write.parquet(f"{folder}/depth={depth}")
    return read.parquet(folder).where(F.size("rest") == 0).drop("depth")


def set_difference(included: DataFrame, excluded: DataFrame) -> DataFrame:
    """Distinct included paths that are not excluded; raw strings are compared."""
    return included.select("path").distinct().join(excluded.select("path"), "path", "left_anti")


def source_paths(
    spark: SparkSession, include: list[str], exclude: list[str], recursive: bool = False
) -> DataFrame:
    """Paths the include rules match and the exclude rules do not."""
    return set_difference(
        expand_rules(spark, include, recursive), expand_rules(spark, exclude, recursive)
    )


def require_paths(paths: DataFrame) -> DataFrame:
    """The same paths; an error if there are none."""
    if paths.isEmpty():
        raise DocumentationError("No paths to process")
    return paths
