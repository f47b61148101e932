"""Checks on what a job has written."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def failed_outputs(outputs: DataFrame, listing: DataFrame) -> DataFrame:
    """Outputs that do not exist in ``listing`` (paths) or are empty, with the reason."""
    found = listing.select(F.col("path").alias("written_path"), F.lit(True).alias("exists"))
    reason = F.when(F.col("exists").isNull(), "missing").when(F.length("code") == 0, "empty")
    return (
        outputs.select("path", "written_path", "code")
        .join(found.distinct(), "written_path", "left")
        .select("path", "written_path", reason.alias("reason"))
        .where("reason IS NOT NULL")
    )
