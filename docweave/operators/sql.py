"""Functions for SQL: definitions of whole tables of modules, and the generator."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..schema import DEFINITION, DOC_DATA
from .answers import checked_answer
from .extract import as_read, safe_module_facts
from .generate import Generator, call_generator

FOUND_IN = T.StructType(
    [T.StructField("path", T.StringType()), *DEFINITION.fields, T.StructField("error", T.StringType())]
)
ANSWER = f"data {DOC_DATA}, status STRING, error STRING"


class ExtractDefinitionsTable:
    """``extract_definitions_table(TABLE(modules))``, modules with ``path`` and ``code``.

    A row per definition; a module that cannot be parsed gives one row with its ``error``. Whole
    batches come and go as Arrow columns. Other columns of the table are ignored.
    """

    def eval(self, modules: pa.RecordBatch) -> Iterator[pa.Table]:
        paths = modules.column(modules.schema.get_field_index("path")).to_pylist()
        codes = modules.column(modules.schema.get_field_index("code")).to_pylist()
        found: list[dict] = []
        for path, code in zip(paths, codes):
            facts = safe_module_facts(as_read(code))
            if facts["error"] is not None:
                found.append({"path": path, "error": facts["error"]})
            found.extend({"path": path, **item} for item in facts["defs"] or ())
        yield pa.Table.from_pylist(found, schema=to_arrow_schema(FOUND_IN))


def register_definitions_table(spark: SparkSession, name: str = "extract_definitions_table") -> None:
    spark.udtf.register(name, F.arrow_udtf(ExtractDefinitionsTable, returnType=FOUND_IN))


def register_generator(spark: SparkSession, func: Generator, name: str = "generate_docstring") -> None:
    """``name(language, definition, definition_type, temperature)`` as a SQL function.

    It returns ``STRUCT<data, status, error>``, checked like the answers of a job. Equal requests of
    a batch are called once; there is no cache, no limit of rates and no removal of copies beyond
    a batch: a job has them. Marked nondeterministic, so that reading two fields calls once.
    """
    made = T.StructType.fromDDL(ANSWER)
    arrow_type = to_arrow_type(made)

    def answers(
        language: pa.Array, definition: pa.Array, definition_type: pa.Array, temperature: pa.Array
    ) -> pa.Array:
        known: dict[tuple, dict] = {}
        rows = list(zip(*(column.to_pylist() for column in (language, definition, definition_type, temperature))))
        for row in rows:
            if row not in known:
                names = ("language", "definition", "definition_type", "temperature")
                request = {"cache_key": None, **dict(zip(names, row))}
                known[row] = checked_answer(call_generator(func, request))
        return pa.array([known[row] for row in rows], type=arrow_type)

    spark.udf.register(name, F.arrow_udf(answers, made).asNondeterministic())
