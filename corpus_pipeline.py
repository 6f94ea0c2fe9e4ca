"""The corpus pipeline: quality, near-duplicates, benchmark leaks, secrets, then token ids.

Each stage takes (spark, docs, sf_dir), with docs as its predecessor wrote them, and returns a DataFrame; all but the
last return the columns of docs, whatever these are. Rows without a doc_id pass the stages that decide by doc_id. Empty
tables pass as they are. No stage keeps part of its input for speed.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import decontam, quality, secrets_scan, sentencepiece_codec, simhash
from tallyloom.llm.shared import Store, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score_documents(docs, model, names=("__score", "__predicted")).where("__predicted = 1").select(*map(_named, docs.columns))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest doc_id stays. Of rows that repeat it with one text,
    one stays, the same in every run; if their texts differ, each text stays, as no other row has it."""
    groups = simhash.near_duplicates(docs)
    first = groups.where("doc_id = component_id").select("doc_id").distinct()
    found = docs.where("doc_id IS NOT NULL").join(first, "doc_id", "left_semi")
    # the partial minima leave one row a task of a row that is repeated often
    one = found.select("doc_id", F.xxhash64("text").alias("__text"), F.struct("*").alias("__row"), F.xxhash64(*map(_named, docs.columns)).alias("__all"))
    one = one.groupBy("doc_id", "__text").agg(F.min_by("__row", "__all").alias("__row")).select("__row.*")
    return one.unionByName(docs.where("doc_id IS NULL")).select(*map(_named, docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go."""
    store = Store(spark, "pipeline-leaks")
    found = store.put(decontam.leaks(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "leaks")
    return docs.join(decontam.sized(found), "doc_id", "left_anti").select(*map(_named, docs.columns))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in texts become a mark; n_chars, where there is one, is counted anew."""
    path = "source" if "source" in docs.columns else None
    rows = docs.select(F.struct("*").alias("row"), "text", *([path] if path else []))
    found = secrets_scan.scan(rows, secrets_scan.default_scanner(docs), path=path)
    text = F.when(F.size("secrets") > 0, secrets_scan.redacted(F.col("text"), F.col("secrets"))).otherwise(F.col("text"))
    changed = found.select("row", text.alias("text"))
    new = {"text": F.col("text")} | ({"n_chars": F.when(F.col("text") != F.col("row.text"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})
    return changed.select(*(new.get(c, F.col(f"row.{_quoted(c)}")).alias(c) for c in docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens and the digests of its ids and of the text decoded from them."""
    return sentencepiece_codec.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _named(name: str):
    return F.col(_quoted(name))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", keep_one_of_each),
    ("benchmark decontamination", drop_leaks),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode),
]

#: Boosted trees, forests and fingerprint graphs have no SQL form; the tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each one's result written to the shared folder and read again."""
    store, docs = Store(spark, "pipeline"), table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = store.put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
