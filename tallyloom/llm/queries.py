"""The registered query of each operator: opN_<name>(spark, sf_dir), over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import conversations, decontam, embedding_join, html_extract, pii, quality, secrets_scan, sentencepiece_codec, sharding, simhash, token_counts, topk, variants
from tallyloom.llm.shared import table

#: The rank file's identifiers end at 50,255, so 50,256 is free to end a document.
RANKS, SEPARATOR = public_tokenizers.path("byte_bpe_50k.tiktoken"), 50_256
PIECES = public_tokenizers.path("piece_bpe_32k.model")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_subspace_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_documents(table(spark, sf_dir, "documents"), PIECES)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


SHARDS = 16


def op4_rendezvous(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.assign(table(spark, sf_dir, "documents"), [1.0] * SHARDS, [1.0] * (SHARDS + 1))
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model).select("doc_id", quality.held_out().alias("held_out"), "score", "predicted")


def op6_separator_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_documents(table(spark, sf_dir, "documents"), RANKS, public_tokenizers.PATTERN, SEPARATOR)


def op7_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = html_extract.fit(html_extract.labelled_pages())
    return html_extract.extract_pages(table(spark, sf_dir, "pages"), model)


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    found = secrets_scan.scan(docs, secrets_scan.default_scanner(docs))
    return found.select("doc_id", "n_candidates", F.size("secrets").cast("long").alias("n_secrets"), pii.listed(F.col("secrets")).alias("spans"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
    base = pii.listed(F.col("base"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base.cast("binary"), 256).alias("base_sha256"), pii.listed(F.col("spans")).alias("spans"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.report(conversations.damaged(table(spark, sf_dir, "conversations")), there="there")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.vocabulary(variants.damaged_runs(table(spark, sf_dir, "documents")))
    return variants.grouped(words).select("word", "form", "root", "n", "n_near", "form_n")


#: Every vec_id that this divides asks.
ASKING = 100


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % ASKING == 0))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_subspace_join": op2_subspace_join,
    "op3_sentencepiece": op3_sentencepiece,
    "op4_rendezvous": op4_rendezvous,
    "op5_quality": op5_quality,
    "op6_separator_scan": op6_separator_scan,
    "op7_main_text": op7_main_text,
    "op8_secrets": op8_secrets,
    "op9_pii": op9_pii,
    "op10_simhash": op10_simhash,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_exact_topk": op13_exact_topk,
}

#: DuckDB SQL for the queries that SQL can express.
ORACLE: dict[str, str] = {}

ORACLE["op13_exact_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS cells FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.cells, c.cells) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
