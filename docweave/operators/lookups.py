"""Look-ups by definition type and language, against tables of a few fixed rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schema import definition_type_table, language_table

UNSUPPORTED_TYPE = "unsupported_definition_type"
UNKNOWN_LANGUAGE = "unknown_language"


def validate_types(rows: DataFrame) -> DataFrame:
    """Add the function-call name of ``definition_type`` and whether the type is known."""
    types = definition_type_table(rows.sparkSession)
    return rows.join(F.broadcast(types), "definition_type", "left").withColumn(
        "type_status", F.when(F.col("call_name").isNull(), UNSUPPORTED_TYPE).otherwise("ok")
    )


def lookup_language(rows: DataFrame) -> DataFrame:
    """Add the printed name of ``language`` and whether the language is known."""
    languages = language_table(rows.sparkSession).select("language", "stylized_name")
    return rows.join(F.broadcast(languages), "language", "left").withColumn(
        "language_status",
        F.when(F.col("stylized_name").isNull(), UNKNOWN_LANGUAGE).otherwise("ok"),
    )
