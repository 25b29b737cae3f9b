"""From raw documents to training shards: five stages, each written as Parquet and read again by the next.

Defined results of every stage: an empty table gives an empty result; null and empty texts are scored, kept, mixed and
tokenised like others and are no copies of each other; columns beyond those of documents pass, whatever they are
called (the last stage returns its own columns only).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.llm import decontaminate, mixing, near_dedup, quality, tokens
from lodestrata.llm.queries import MIX
from lodestrata.llm.storage import materialise


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier (op 4) accepts; a null or repeated doc_id changes nothing."""
    return quality.accepted(docs, _table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies (op 9), the one of the least doc_id; repeated rows are copies."""
    return near_dedup.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a benchmark passage (op 5); rows of one doc_id are told apart by their texts."""
    return decontaminate.clean(docs, _table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated to the target weights of their sources (op 6), shuffled; a null source is a source of its own."""
    return mixing.repeated(docs, MIX)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shards in training order (op 2); one row per sequence, also for rows that repeat a doc_id."""
    return tokens.training_order(docs).select("slot", "shard", "pos", "doc_id", "piece", "n_tokens", "sha256")


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("decontaminate", decontamination_stage),
    ("mix", mixing_stage),
    ("tokens", token_stage),
]

#: The trees and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table."""
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
