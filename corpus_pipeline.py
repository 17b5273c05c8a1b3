"""A corpus pipeline of five of sheaf.llm's operators; each stage works on what the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sheaf.llm import best_fit, language_id, order_minhash, secrets, string_tiling
from sheaf.session import discard, settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no language model accepts go: null, empty and letterless texts too; repeated rows stay or go together, columns unchanged."""
    return language_id.keep_identified(docs, language_id.train(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each group of near duplicates stays, once where a row of it is repeated; rows without doc_id or words stay."""
    return order_minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a benchmark item leaks go; null and empty texts stay, repeated rows stay or go together."""
    return string_tiling.keep_clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Confirmed secrets are blanked; no row goes, null and empty texts and other columns are as before."""
    return secrets.redact(docs)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes in the training windows; texts without tokens and rows without doc_id take no place."""
    return best_fit.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", decontaminate),
    ("secret_scan", redact_secrets),
    ("pack", pack_windows),
]

#: SQL can express none of the stages; tests/llm/test_pipeline.py holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each but the last written as Parquet in the shared folder and read again; what a stage wrote on its way goes then, and its input too.

    An empty table gives none; very long texts pass through whole.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES[:-1]:
        docs = settle(spark, lambda docs=docs, stage=stage: stage(spark, docs, sf_dir), name)
        if written is not None:
            discard(written)
        written = docs
    return STAGES[-1][1](spark, docs, sf_dir)
