"""Data model: nested column types, look-up tables and the reply records."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values: they must equal the documented behaviour for right results.
LANGUAGES = [("python", "Python", ["class", "function"])]
FUNCTION_CALL_NAMES = [
    ("function", "respond_with_structured_docstring_data_for_function"),
    ("class", "respond_with_structured_docstring_data_for_class"),
]
SKIP_CALL_NAME = "skip_function"
MODELS = [("gpt-3.5-turbo-0613", 4096), ("gpt-3.5-turbo-16k-0613", 16384)]
DEFAULT_MODEL = "gpt-3.5-turbo-0613"
QUOTE_STYLES = ('"""', "'''", '"', "'")
TOO_MANY_TOKENS_CODE = "context_length_exceeded"
# What a reply holds and how each field is described to the model.
FUNCTION_FIELDS = [
    ("description", "The overall description of the function in 1 sentence; this should begin with a verb."),
    ("parameters", "An array of descriptions for each of the function's parameters, if it has any."),
    ("return_values", "An array of descriptions for each of the function's return values, if it has any."),
    ("exceptions", "An array of descriptions for each of the exceptions the function may raise, if it has any."),
]
CLASS_FIELDS = [
    ("description", "The overall description of the class in 1 sentence; this should begin with a verb."),
]
ITEM_FIELDS = [
    ("parameters", "name", "The name of the parameter"),
    ("parameters", "description", "The description of the parameter"),
    ("parameters", "assumed_type", "The assumed type(s) of the parameter; example: 'str, int, float'"),
    ("return_values", "name", "The name of the return value"),
    ("return_values", "description", "The description of the return value"),
    ("return_values", "assumed_type", "The assumed type(s) of the return value; example: 'str, int, float'"),
    ("exceptions", "name", "The name of the exception"),
    ("exceptions", "description", "The description of the exception"),
]
# --- End of fixed values.

FUNCTION, CLASS = "function", "class"

TYPED_ITEM = "STRUCT<name: STRING, description: STRING, assumed_type: STRING>"
NAMED_ITEM = "STRUCT<name: STRING, description: STRING>"
DOC_DATA = (
    f"STRUCT<description: STRING, parameters: ARRAY<{TYPED_ITEM}>, "
    f"return_values: ARRAY<{TYPED_ITEM}>, exceptions: ARRAY<{NAMED_ITEM}>>"
)

# One function, async function or class found in a module. Lines count from 1 and
# columns from 0, both in characters of the newline-normalised text.
DEFINITION = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("kind", T.StringType()),
        T.StructField("is_async", T.BooleanType()),
        T.StructField("depth", T.IntegerType()),  # enclosing definitions
        T.StructField("level", T.IntegerType()),  # round it is documented in; -1: not at all
        T.StructField("line", T.IntegerType()),
        T.StructField("end_line", T.IntegerType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("header_end_line", T.IntegerType()),
        T.StructField("body_line", T.IntegerType()),
        T.StructField("body_col", T.IntegerType()),
        T.StructField("suite", T.BooleanType()),  # body shares the header's line
        T.StructField("suite_line", T.IntegerType()),  # line slot holding the suite's body
        T.StructField("suite_offset", T.IntegerType()),  # where the body starts in that slot
        T.StructField("single_line", T.BooleanType()),
        T.StructField("has_docstring", T.BooleanType()),
        T.StructField("text_line", T.IntegerType()),  # with decorators and own comments
        T.StructField("text_end_line", T.IntegerType()),
        T.StructField("def_indent", T.StringType()),
        T.StructField("body_indent", T.StringType()),
    ]
)

MODULE = T.StructType(
    [
        T.StructField("indent", T.StringType()),
        # Lines that one token or a backslash joins; their inner lines are never re-indented.
        T.StructField(
            "spans",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("first", T.IntegerType()),
                        T.StructField("last", T.IntegerType()),
                    ]
                )
            ),
        ),
        T.StructField("defs", T.ArrayType(DEFINITION)),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass(frozen=True)
class ParameterDoc:
    name: str = ""
    description: str = ""
    assumed_type: str = ""


@dataclass(frozen=True)
class ReturnDoc:
    name: str = ""
    description: str = ""
    assumed_type: str = ""


@dataclass(frozen=True)
class ExceptionDoc:
    name: str = ""
    description: str = ""


@dataclass(frozen=True)
class FunctionDoc:
    """What a generator may return for a function."""

    description: str = ""
    parameters: list[ParameterDoc] = field(default_factory=list)
    return_values: list[ReturnDoc] = field(default_factory=list)
    exceptions: list[ExceptionDoc] = field(default_factory=list)


@dataclass(frozen=True)
class ClassDoc:
    """What a generator may return for a class."""

    description: str = ""


def function_declaration(definition_type: str) -> dict:
    """The function a model has to call for a definition: its name and parameter schema."""
    fields = FUNCTION_FIELDS if definition_type == FUNCTION else CLASS_FIELDS
    properties: dict[str, dict] = {}
    for name, description in fields:
        items = {item: {"type": "string", "description": said} for of, item, said in ITEM_FIELDS if of == name}
        kind = {"type": "array", "items": {"type": "object", "properties": items}} if items else {"type": "string"}
        properties[name] = {"description": description, **kind}
    return {
        "name": dict(FUNCTION_CALL_NAMES)[definition_type],
        "parameters": {"type": "object", "properties": properties},
    }


def language_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        LANGUAGES, "language STRING, stylized_name STRING, definition_types ARRAY<STRING>"
    )


def definition_type_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(FUNCTION_CALL_NAMES, "definition_type STRING, call_name STRING")


def empty_items(item: str) -> Column:
    return F.array().cast(f"ARRAY<{item}>")
