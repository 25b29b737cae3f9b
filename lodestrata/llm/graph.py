"""Connected components of a large edge table, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.storage import materialise


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), F.least("a", "m").alias("m"))
    return both.join(least, both["a"] == least["u"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least.withColumnRenamed("a", "u"), F.col("a") == F.col("u")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select("a", F.col("m").alias("b"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, label (the least node reachable) of every node that has an edge; ``edges`` has two long columns.

    The number of rounds grows with the logarithm of the longest chain; each round is a written table.
    A node with very many edges is one key of the joins with ``least``, which has a row a node: the least neighbour is
    aggregated before the shuffle, and AQE splits such a key's partition on the side of the edges.
    """
    first, second = edges.columns
    a, b = F.greatest(first, second), F.least(first, second)
    now = materialise(edges.select(a.alias("a"), b.alias("b")).where("a <> b").distinct(), "edges")
    before, state = None, _state(now)
    while state != before and state[0]:
        now = materialise(_small_star(_large_star(now)), "edges")
        before, state = state, _state(now)
    labels = now.groupBy("a").agg(F.min("b").alias("b"))
    return labels.select(F.col("a").alias("node"), F.col("b").alias("label")).union(labels.select(F.col("b"), F.col("b")).distinct())
