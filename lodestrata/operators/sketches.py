"""Quantile sketches that are stored by batch and merged later, beside the exact quantiles of ``cloud``.

A sketch is a KLL sketch of one column in one group: its size does not depend on the rows, sketches of parts merge into the
sketch of the whole, and a quantile of it is off by a bounded share of the ranks. Rows are read once, when their batch comes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Accuracy of the sketches, and the share of the ranks that a quantile of one is off by at most, in 99 of 100 cases.
ACCURACY = 1600
RANK_ERROR = 2.296 / ACCURACY**0.9021


def quantile_sketches(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """A row per group: for each column its sketch (``sketch_<column>``), its numbers (``n_<column>``) and its least and greatest.

    Nulls and NaN are no numbers; a group without any has a null sketch.
    """
    by = by or ["scene_id"]
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in columns}
    facts = [
        f.alias(f"{k}_{c}")
        for c, v in number.items()
        for k, f in (("sketch", F.kll_sketch_agg_double(v, F.lit(ACCURACY))), ("n", F.count(v)), ("min", F.min(v)), ("max", F.max(v)))
    ]
    rows = df.groupBy(*by).agg(*facts)
    return rows.withColumns({f"sketch_{c}": F.when(F.col(f"n_{c}") > 0, F.col(f"sketch_{c}")) for c in columns})


def _columns(sketches: DataFrame) -> list[str]:
    return [c.removeprefix("sketch_") for c in sketches.columns if c.startswith("sketch_")]


def merge_sketches(sketches: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Sketches of the groups' parts together: one row per group of ``by``."""
    by = by or ["scene_id"]
    facts = [
        f.alias(f"{k}_{c}")
        for c in _columns(sketches)
        for k, f in (("sketch", F.kll_merge_agg_double(f"sketch_{c}", F.lit(ACCURACY))), ("n", F.sum(f"n_{c}")), ("min", F.min(f"min_{c}")), ("max", F.max(f"max_{c}")))
    ]
    rows = sketches.groupBy(*by).agg(*facts)
    return rows.withColumns({f"sketch_{c}": F.when(F.col(f"n_{c}") > 0, F.col(f"sketch_{c}")) for c in _columns(sketches)})


def sketch_quantiles(sketches: DataFrame, wanted: dict[str, list[float]], by: list[str] | None = None) -> DataFrame:
    """group, column, q, value of merged sketches, as ``cloud.quantiles`` gives them exactly; null for a group without numbers."""
    by = by or ["scene_id"]
    value = lambda c, q: F.when(F.col(f"n_{c}") > 0, F.col(f"min_{c}") if q <= 0 else F.col(f"max_{c}") if q >= 1 else F.kll_sketch_get_quantile_double(f"sketch_{c}", F.lit(q)))
    rows = [F.struct(F.lit(c).alias("column"), F.lit(q).alias("q"), value(c, q).alias("value")) for c, qs in wanted.items() for q in qs]
    return sketches.select(*by, F.explode(F.array(*rows)).alias("x")).select(*by, "x.*")


def compare_sketches(a: DataFrame, b: DataFrame, qs: list[float], tolerance: float, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Quantiles of two clouds from their sketches by scene and axis, and whether they agree within a tolerance, as ``audit.compare_quantiles``."""
    of = lambda s, name: sketch_quantiles(s, {c: qs for c in columns}).select("scene_id", F.col("column").alias("axis"), "q", F.col("value").alias(name))
    pair = of(a, "a").join(of(b, "b"), ["scene_id", "axis", "q"], "full_outer")
    return pair.withColumn("equal", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def store_sketches(df: DataFrame, columns: list[str], path: str, batch: str, by: list[str] | None = None) -> None:
    """Write the sketches of a batch; a batch that is written again replaces itself, other batches are not touched."""
    rows = quantile_sketches(df, columns, by).withColumn("batch", F.lit(batch))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)


def stored_sketches(spark: SparkSession, path: str, by: list[str] | None = None) -> DataFrame:
    """The merged sketches of all stored batches."""
    return merge_sketches(spark.read.parquet(path), by)
