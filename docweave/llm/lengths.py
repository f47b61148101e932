"""Token counts: one exact histogram of encoded lengths answers every question about limits.

Each row of the histogram is a length that occurs, with the documents of that length and suffix
sums: how many documents are at least so long, and how many tokens they have. Totals, quantiles
and the total after truncation to any limit follow from one row.

Null texts count as empty and have length 0. Repeated rows count each time. An empty table gives
an empty histogram; `total` is then 0 and `quantile` null.
"""

from __future__ import annotations

import base64

import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_text, stored

#: Lengths are summed within blocks first, then over blocks: no task orders all lengths.
BLOCK = 256


def encoded_lengths(rows: DataFrame, ranks: bytes, pattern: str, text: str = "text") -> DataFrame:
    """doc_id and n_tokens of each whole text. `ranks`: the lines of a byte-level BPE vocabulary."""

    def factory():
        merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines()) if a}
        encoding = tiktoken.Encoding(
            "corpus", pat_str=pattern, mergeable_ranks=merges, special_tokens={}
        )
        return lambda texts: [(len(encoding.encode_ordinary(one)),) for one in texts]

    return map_text(rows, text, None, "n_tokens bigint", factory)


def length_histogram(lengths: DataFrame) -> DataFrame:
    """n_tokens, n_docs; docs_at_least, tokens_at_least (this length or more); truncated_tokens
    (the total if every document is cut to this length); quantile (share of documents up to it)."""
    # Written once: both the blocks and the rows are made of it, and texts are encoded once.
    counts = stored(lengths.groupBy("n_tokens").agg(F.count("*").alias("n_docs")), "lengths")
    counts = counts.withColumn("block", F.floor(F.col("n_tokens") / BLOCK))
    tokens = F.col("n_tokens") * F.col("n_docs")
    within = Window.partitionBy("block").orderBy(F.desc("n_tokens"))
    # One row for each BLOCK lengths: few, whatever the number of documents.
    over = Window.orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    blocks = (
        counts.groupBy("block")
        .agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
        .select(
            "block",
            F.coalesce(F.sum("docs").over(over), F.lit(0)).alias("docs_above"),
            F.coalesce(F.sum("tokens").over(over), F.lit(0)).alias("tokens_above"),
            F.sum("docs").over(Window.partitionBy()).alias("all_docs"),
            F.sum("tokens").over(Window.partitionBy()).alias("all_tokens"),
        )
    )
    docs_from = F.sum("n_docs").over(within) + F.col("docs_above")
    tokens_from = F.sum(tokens).over(within) + F.col("tokens_above")
    return counts.join(blocks, "block").select(
        "n_tokens",
        "n_docs",
        docs_from.alias("docs_at_least"),
        tokens_from.alias("tokens_at_least"),
        (F.col("all_tokens") - tokens_from + F.col("n_tokens") * docs_from).alias("truncated_tokens"),
        ((F.col("all_docs") - docs_from + F.col("n_docs")) / F.col("all_docs")).alias("quantile"),
    )


def total(histogram: DataFrame) -> DataFrame:
    return histogram.agg(F.coalesce(F.max("tokens_at_least"), F.lit(0)).alias("total"))


def quantile(histogram: DataFrame, q: float) -> DataFrame:
    """The least length that has at least the share `q` of documents up to it."""
    return histogram.where(F.col("quantile") >= q).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_total(histogram: DataFrame, limit: int) -> DataFrame:
    """Tokens left if every document is cut to `limit`."""
    longer = F.col("n_tokens") >= limit
    cut = F.coalesce(F.max(F.when(longer, F.col("docs_at_least"))), F.lit(0)) * limit
    return histogram.agg(
        (F.coalesce(F.sum(F.when(~longer, F.col("n_tokens") * F.col("n_docs"))), F.lit(0)) + cut).alias(
            "truncated_tokens"
        )
    )
