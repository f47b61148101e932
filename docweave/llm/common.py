"""What the corpus operators share: reading tables, mapping texts in batches, bounded samples."""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..workspace import new_run_folder

#: Rows turned into Python objects at a time; Spark bounds the bytes of a batch.
SLICE_ROWS = 256

ARROW_TYPES = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(),
}


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class WholeRow(dict):
    """To pass whole rows: all columns in the struct `row`. Their text is then sent once."""

    def __init__(self):
        super().__init__(row=F.struct("*"))


def map_text(
    rows: DataFrame,
    text: str,
    passed: dict[str, Column] | None,
    made: str,
    factory: Callable[[], Callable[[list[str]], list[tuple]]],
) -> DataFrame:
    """The `passed` columns (doc_id if None), and those of schema `made` that Python makes of each text.

    `factory()` runs once per task; what it returns takes a list of texts (never null: a null
    text is given as empty) and returns one tuple for each.
    """
    passed = {"doc_id": F.col("doc_id")} if passed is None else passed
    within = rows.columns.index(text) if isinstance(passed, WholeRow) else None
    fields = T.StructType.fromDDL(made)
    names = [*passed, *fields.names]
    types = [_arrow(field.dataType) for field in fields]
    kept = rows.select(*[column.alias(name) for name, column in passed.items()])
    source = kept
    if within is None:
        source = rows.select(
            *[column.alias(name) for name, column in passed.items()], F.col(text).alias("__text")
        )
    n_kept = len(passed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_texts = factory()
        for batch in batches:
            for start in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(start, SLICE_ROWS)
                texts = part.column(n_kept) if within is None else part.column(0).field(within)
                results = of_texts([one or "" for one in texts.to_pylist()])
                columns = list(zip(*results)) if results else [[] for _ in types]
                arrays = [pa.array(values, kind) for values, kind in zip(columns, types)]
                yield pa.RecordBatch.from_arrays([*part.columns[:n_kept], *arrays], names)
        del of_texts
        release_memory()

    return source.mapInArrow(run, T.StructType([*kept.schema.fields, *fields.fields]))


def release_memory() -> None:
    """Give back what a task has freed: Python workers live on, beside those of later stages."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only glibc has it
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    if isinstance(kind, T.StructType):
        return pa.struct([(field.name, _arrow(field.dataType)) for field in kind])
    return ARROW_TYPES[kind.simpleString()]


def stored(rows: DataFrame, name: str, rows_per_file: int = 0) -> DataFrame:
    """Write rows once to the cluster's shared folder and read them back: lineage ends here."""
    _, folder = new_run_folder(rows.sparkSession)
    path = f"{folder}/{name}"
    writer = rows.write.mode("overwrite")
    if rows_per_file:
        writer = writer.option("maxRecordsPerFile", rows_per_file)
    writer.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def bounded_sample(rows: DataFrame, key: Column, bound: int) -> DataFrame:
    """About `bound` rows at most (by a hash of the key, so the same rows in each run)."""
    total = rows.count()
    if total <= bound:
        return rows
    share = F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 30))
    return rows.where(share < F.lit(int((1 << 30) * (bound / total))))
