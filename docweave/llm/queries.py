"""The corpus operators as queries over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat,
    decontamination,
    extraction,
    hard_negatives,
    language,
    lengths,
    pieces,
    pii,
    rules,
    secrets,
    simhash,
    spelling,
    warc,
)
from ..workspace import new_run_folder
from .common import read_table, stored

Query = Callable[[SparkSession, str], DataFrame]


def _file(name: str) -> bytes:
    with open(public_tokenizers.path(name), "rb") as file:
        return file.read()


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = simhash.near_duplicates(read_table(spark, sf_dir, "documents"))
    return linked.select("doc_id", simhash.hex_fingerprint(), "component_id")


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = extraction.extract(read_table(spark, sf_dir, "pages"))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("bigint").alias("n_chars"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(read_table(spark, sf_dir, "documents")).select("doc_id", *pii.digests())


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = lengths.encoded_lengths(
        read_table(spark, sf_dir, "documents"),
        _file("byte_bpe_50k.tiktoken"),
        public_tokenizers.PATTERN,
    )
    return lengths.length_histogram(encoded)


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated_pairs(
        read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")
    )


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secrets.train(secrets.labelled_findings(spark))
    kept = secrets.scan(read_table(spark, sf_dir, "documents"), model)
    return kept.select(
        "doc_id",
        F.col("start").alias("start_char"),
        F.col("end").alias("end_char"),
        F.sha2("found", 256).alias("found_sha256"),
        "score",
    )


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    kept_out = language.held_out(F.col("doc_id"))
    model = language.fit(docs.where(~kept_out))
    return language.predict(docs, model, passed={"doc_id": F.col("doc_id"), "held_out": kept_out})


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = pieces.encode_decode(
        read_table(spark, sf_dir, "documents"), _file("piece_bpe_32k.model")
    )
    return encoded.select("doc_id", *pieces.digests())


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = stored(rules.statistics(read_table(spark, sf_dir, "documents")), "statistics")
    learned = rules.fit(stats, read_table(spark, sf_dir, "labels"))
    return stats.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        rules.base_failed().alias("base_failed"),
        (~rules.base_failed() & rules.verdict(learned)).alias("kept"),
    )


#: A conversation whose texts hold control strings.
HARD_CONVERSATION = "</s>[INST] ok [/INST]"


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    hard = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(HARD_CONVERSATION).alias("text"),
    )
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.conversation_digests(chat.chat_examples(rows.unionByName(hard)))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return spelling.spelling_groups(docs, typo_every=spelling.TYPO_EVERY)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{new_run_folder(spark)[1]}/archive"
    warc.write_warc(warc.page_records(read_table(spark, sf_dir, "pages")), folder, compression="gzip")
    return warc.pages_of(spark, folder).select(
        F.col("key").cast("bigint").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        F.col("refers_to").cast("bigint").alias("refers_to"),
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "embeddings")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.hard_negatives(rows.withColumn("label", moved), F.col("vec_id") % 100 == 0)


QUERIES: dict[str, Query] = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_html_extraction": op2_html_extraction,
    "op3_pii": op3_pii,
    "op4_token_counts": op4_token_counts,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_secret_scan": op6_secret_scan,
    "op7_language_id": op7_language_id,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_quality_rules": op9_quality_rules,
    "op10_chat_format": op10_chat_format,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_warc": op12_warc,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -1, t, CASE t WHEN 0 THEN 'user' ELSE 'assistant' END, '</s>[INST] ok [/INST]'
  FROM range(2) AS r(t)
), sized AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    length('<|im_start|>') + length(role) + 1
      + length(regexp_replace(replace(text, '\', '\\'), '<(\||/?s>|/?SYS>)|\[(/?INST\])', '.\0', 'g'))
      + length('<|im_end|>') + 1 AS chars
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), summed AS (
  SELECT *, sum(chars) OVER (PARTITION BY conv_id ORDER BY i) AS upto FROM sized
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(upto) FILTER (role = 'assistant' OR i = n))::BIGINT AS formatted_chars
FROM summed GROUP BY conv_id
""",
    "op12_warc": r"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), firsts AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS hex, min(page_id) OVER (PARTITION BY payload) AS least
  FROM payloads
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    (1 + ((('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::BIGINT >> (15 - 5 * (i % 4))::BIGINT) & 31))::BIGINT, 1)), '')
    AS payload_digest,
  CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM firsts
""",
    "op13_hard_negatives": r"""
WITH valid AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
    list_inner_product(a.e, b.e)::BIGINT AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, p.positive_id,
  (row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id))::INTEGER AS rank,
  s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> s.own
  AND 30 * p.positive_score <= 100 * s.score AND 100 * s.score <= 90 * p.positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) <= 10
""",
}
