"""Intermediate tables in a folder that driver and executors share."""

from __future__ import annotations

import posixpath
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scopes: list[list[str]] = []


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """A scope for intermediates: what operators write in the shared folder within it is deleted at its end.

    Write a result down inside the scope; a DataFrame that is read later finds its intermediates gone. Scopes nest.
    """
    held: list[str] = []
    _scopes.append(held)
    try:
        yield
    finally:
        _scopes.remove(held)
        for name in held:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def noted(path: str) -> str:
    """``path``, which belongs to the innermost scope from now on."""
    if _scopes:
        _scopes[-1].append(path)
    return path


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder path under ``spark.checkpoint.dir``; where that is unset one of our own is set, if all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", base)
    return noted(posixpath.join("file://" + base if base.startswith("/") else base, f"{name}-{uuid.uuid4().hex}"))


#: Rows of a task that sorts or writes them, about.
TASK_ROWS = 500_000


def tasks_for(df: DataFrame, rows: int | None = None) -> int:
    """As many tasks as hold about ``rows`` (TASK_ROWS) of ``df`` each, and no fewer than can run at once."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (rows or TASK_ROWS)))


def persisted(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` in the shared folder and read it back: cuts lineage without tying rows to an executor."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
