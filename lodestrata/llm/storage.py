"""Where operators keep intermediate tables: a folder that driver and executors share."""

from __future__ import annotations

import contextlib
import io
import posixpath
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

from lodestrata.sources.tables import noted


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``; only where that is unset and all runs on this machine, one of our own is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    if "://" not in base:
        base = "file://" + posixpath.abspath(base) if base.startswith("/") else base
    return noted(posixpath.join(base, f"{name}-{uuid.uuid4().hex}"))


def materialise(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage and outlives executors."""
    path = shared_dir(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable(df: DataFrame) -> DataFrame:
    """``df`` with the same rows in the same partitions whenever it is read: written down first if a shuffle makes it."""
    plan = io.StringIO()
    with contextlib.redirect_stdout(plan):
        df.explain()
    return materialise(df, "rows") if "Exchange" in plan.getvalue() else df
