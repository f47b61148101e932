"""Chat messages for one definition."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values: the system text, one %s for the language and one for the definition type.
SYSTEM_TEXT = (
    "You are a robot who is an expert at writing docstrings for %s classes and functions, "
    "mainly because you are extremely good at being concise.\n"
    "Help the human write a docstring for the following %s:"
)
# --- End of fixed values.


def build_messages(language_name: Column, definition_type: Column, definition: Column) -> Column:
    """``ARRAY<STRUCT<role, content>>``: the system text, then the definition as user."""
    return F.array(
        F.struct(
            F.lit("system").alias("role"),
            F.format_string(SYSTEM_TEXT, language_name, definition_type).alias("content"),
        ),
        F.struct(F.lit("user").alias("role"), definition.alias("content")),
    )


def prompt_messages(language_name: str, definition_type: str, definition: str) -> list[dict]:
    """The same messages for one request inside a generator."""
    return [
        {"role": "system", "content": SYSTEM_TEXT % (language_name, definition_type)},
        {"role": "user", "content": definition},
    ]
