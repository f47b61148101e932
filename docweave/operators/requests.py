"""Requests to the generator: de-duplicated, and answered from a cache table first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cache_key(
    language: Column, definition: Column, definition_type: Column, temperature: Column
) -> Column:
    """Digest of everything the generator is given."""
    parts = [language, definition, definition_type, temperature.cast("string")]
    return F.sha2(F.concat_ws("\u0001", *parts), 256)


def with_request(definitions: DataFrame, language: str, temperature: float) -> DataFrame:
    return (
        definitions.withColumn("language", F.lit(language))
        .withColumn("temperature", F.lit(float(temperature)))
        .withColumn(
            "cache_key",
            cache_key(
                F.col("language"),
                F.col("definition"),
                F.col("definition_type"),
                F.col("temperature"),
            ),
        )
    )


def distinct_keys(rows: DataFrame, row_id: str) -> DataFrame:
    """``(cache_key, pick, uses)``: each key with the hash of one row's name and its number of rows."""
    names = rows.select("cache_key", F.xxhash64(row_id).alias("pick"))
    return names.groupBy("cache_key").agg(F.min("pick").alias("pick"), F.count("*").alias("uses"))


def distinct_requests(rows: DataFrame, row_id: str) -> DataFrame:
    """One row per key with its number of uses. ``row_id`` names each row; store ``rows`` first.

    Only keys, counts and the hash of a row's name are aggregated, combined before the shuffle;
    the text of one row per key is then fetched by that hash, so texts are never sorted and the
    copies of a frequent text do not meet in one task.
    """
    texts = rows.withColumn("pick", F.xxhash64(row_id))
    picked = distinct_keys(rows, row_id)
    kept = ["cache_key", "language", "definition", "definition_type", "temperature"]
    optional = [name for name in ("model",) if name in rows.columns]
    return (
        texts.select(*kept, *optional, "pick")
        .join(picked.hint("shuffle_hash"), ["cache_key", "pick"])
        .drop("pick")
    )


def cache_misses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests whose key the cache does not hold."""
    return requests.join(cache.select("cache_key"), "cache_key", "left_anti")


def hot_keys(requests: DataFrame, total: int, slices: int) -> DataFrame:
    """``(cache_key, salts)`` of the keys with more rows than an average one of ``slices`` tasks.

    There are fewer than ``slices`` of them, and all salts together are fewer than twice that,
    whatever the data: both are safe to broadcast and to replicate.
    """
    share = F.col("uses") * F.lit(slices) / F.lit(max(total, 1))
    return requests.where(share > 1).select("cache_key", F.ceil(share).cast("int").alias("salts"))


def join_by_key(rows: DataFrame, answers: DataFrame, hot: DataFrame, spread: Column) -> DataFrame:
    """Left join of ``rows`` with ``answers`` (distinct keys), hot keys split by salt."""
    salts = F.coalesce(F.col("salts"), F.lit(1))
    left = (
        rows.join(F.broadcast(hot), "cache_key", "left")
        .withColumn("salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
        .drop("salts")
    )
    right = (
        answers.join(F.broadcast(hot), "cache_key", "left")
        .withColumn("salt", F.explode(F.sequence(F.lit(0), salts - 1)))
        .drop("salts")
    )
    return left.join(right, ["cache_key", "salt"], "left").drop("salt")
