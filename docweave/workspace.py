"""Where a job keeps its intermediate tables."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import SparkSession

from .config import DocumentationError


@functools.cache
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="docweave-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints; a local one only on a single machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if master.split("[")[0] != "local":
        raise DocumentationError(
            f"set spark.checkpoint.dir to a folder that all executors of {master} share"
        )
    return _local_folder()


def new_run_folder(spark: SparkSession) -> tuple[str, str]:
    run_id = uuid.uuid4().hex
    return run_id, f"{shared_folder(spark)}/docweave/run-{run_id}"


def _opened(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def drop_folder(spark: SparkSession, folder: str) -> None:
    """Delete a folder of intermediate tables (or a file), wherever it is."""
    system, path = _opened(spark, folder)
    system.delete(path, True)


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder of any file system that Spark reads; none if it is missing."""
    system, path = _opened(spark, folder)
    return [found.getPath().getName() for found in system.listStatus(path)] if system.exists(path) else []


def file_sizes(spark: SparkSession, folder: str) -> dict[str, int]:
    """Names and bytes of what is in a folder."""
    system, path = _opened(spark, folder)
    return {found.getPath().getName(): found.getLen() for found in system.listStatus(path)}


def read_small_file(spark: SparkSession, name: str) -> str:
    system, path = _opened(spark, name)
    stream = system.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_small_file(spark: SparkSession, name: str, text: str, replace: bool = False) -> None:
    """A new file, whole or not at all: written beside it and moved."""
    system, path = _opened(spark, name)
    draft = spark._jvm.org.apache.hadoop.fs.Path(f"{name}.{uuid.uuid4().hex}.part")
    stream = system.create(draft)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    if replace and system.exists(path):
        system.delete(path, False)
    if not system.rename(draft, path):
        system.delete(draft, False)
        raise DocumentationError(f"{name} could not be written")
