"""Bounded samples of labelled rows, and the split of rows into learned-from and held out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo ``folds``; null ids have -1."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds, F.lit(-1))


def sample(labels: DataFrame, column: str, folds: int, held_out: int, rows: int | None = None) -> DataFrame:
    """doc_id and label of the labelled documents that are not held out, or of ``rows`` of them drawn by a hash of the id.

    Of contradicting labels of one document the greater counts.
    """
    usable = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & (remainder(F.col("doc_id"), folds) != held_out))
    one = usable.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column).cast("int")).alias("label"))
    return one if rows is None else one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
