"""From raw documents to encoded training text, in five stages.

A stage takes (spark, docs, sf_dir) and returns documents again (the last also their pieces). Each
works on all rows that the one before kept; what is written between them ends the lineage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontamination, pieces, pii, rules, simhash
from docweave.llm.common import WholeRow, read_table, stored

#: Learned rules, near-duplicate classes and pieces have no SQL: tests hold the stages against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the rules learned from the labels reject go.

    The counted statistics are written beside the rows, so that the texts are read once."""
    counted = rules.statistics(docs, passed=WholeRow())
    counted = stored(counted, "counted")
    stats = counted.select(F.col("row")["doc_id"].alias("doc_id"), *rules.COUNTED)
    learned = rules.fit(stats, read_table(spark, sf_dir, "labels"))
    return counted.where(~rules.base_failed() & rules.verdict(learned)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents whose fingerprints are linked, directly or through others, the one with the least id
    stays: the operator's shingle length and bit distance, without a further check of words."""
    return simhash.one_of_each_class(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontamination.clean_rows(docs, read_table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in the texts is replaced by its kind; n_chars is counted again."""
    return _counted(pii.mask_pii(docs))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their piece ids: n_tokens and token_ids (32-bit little-endian)."""
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as file:
        model = file.read()
    encoded = pieces.encode_decode(docs, model, passed=WholeRow())
    return encoded.select(
        "row.*",
        (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"),
        F.col("ids").alias("token_ids"),
    )


def _counted(docs: DataFrame) -> DataFrame:
    count: Column = F.char_length("text").cast("bigint")
    return docs.withColumn("n_chars", count) if "n_chars" in docs.columns else docs


STAGES = [
    ("quality rules", quality),
    ("simhash near-dedup", near_duplicates),
    ("benchmark decontamination", decontaminate),
    ("personal data", personal_data),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over `documents`, each written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = stored(docs, f"stage-{number + 1}")
    return docs
