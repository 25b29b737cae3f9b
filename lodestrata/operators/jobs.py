"""Job tables: queue state and summary, output names, re-attached files, orphan runs, progress."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.functions.scalars import stem


def queue_state(changes: DataFrame) -> DataFrame:
    """changes (id, status, previous, has_file, seq) -> the last status of each item as it is restored."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("status", "previous", "has_file"), "seq").alias("x")).select("id", "x.*")
    status = F.when(F.col("status") == "running", "waiting").when(F.col("status") == "editing", F.col("previous")).otherwise(F.col("status"))
    return last.withColumn("status", status).select("id", F.when((F.col("status") == "waiting") & ~F.col("has_file"), "missing").otherwise(F.col("status")).alias("status"))


def queue_summary(items: DataFrame) -> DataFrame:
    """items (status, seconds, bytes) -> counts, and what is left of waiting and running items."""
    left = F.col("status").isin("waiting", "running")
    return items.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") == "done").alias("done"), F.count_if(F.col("status") == "failed").alias("failed"),
        F.coalesce(F.sum(F.when(left, F.col("seconds"))), F.lit(0)).alias("seconds_left"), F.coalesce(F.sum(F.when(left, F.col("bytes"))), F.lit(0)).alias("bytes_left"),
    )


def output_names(items: DataFrame, existing: DataFrame) -> DataFrame:
    """items (id, name, folder), existing (folder, output) -> items with output: stem, then stem-2, -3 ... never one that is taken.

    Names are given in order of id; numbers that ``existing`` takes are left out, so each item's is the n-th free one.
    """
    rows = items.withColumn("base", F.concat(stem(F.col("name")), F.lit("-SSOG")))
    by = Window.partitionBy("folder", "base").orderBy("id")
    rows = rows.withColumn("nth", F.row_number().over(by))
    number = F.regexp_extract("output", "-SSOG(?:-([0-9]+))?\\.zip$", 1)
    taken = existing.where(F.col("output").rlike("-SSOG(-([2-9]|[1-9][0-9]+))?\\.zip$")).distinct()
    taken = taken.select("folder", F.concat(F.regexp_replace("output", "-SSOG(-[0-9]+)?\\.zip$", ""), F.lit("-SSOG")).alias("base"), F.when(number == "", 1).otherwise(number.cast("int")).alias("no"))
    # the n-th free number is n plus the taken numbers below it: the taken number of rank k blocks items from no - k + 1 on
    blocked = taken.withColumn("from_nth", F.col("no") - F.row_number().over(Window.partitionBy("folder", "base").orderBy("no")) + 1)
    both = rows.select("folder", "base", "nth", "id", F.lit(0).alias("add")).unionByName(blocked.select("folder", "base", F.col("from_nth").alias("nth"), F.lit(None).cast(dict(items.dtypes)["id"]).alias("id"), F.lit(1).alias("add")))
    shift = F.sum("add").over(Window.partitionBy("folder", "base").orderBy("nth").rangeBetween(Window.unboundedPreceding, 0))
    both = both.withColumn("no", F.col("nth") + shift).where("id IS NOT NULL")
    output = F.concat("base", F.when(F.col("no") > 1, F.concat(F.lit("-"), F.col("no").cast("string"))).otherwise(""), F.lit(".zip"))
    return both.select("id", "folder", output.alias("output"))


def reattach(items: DataFrame, files: DataFrame) -> DataFrame:
    """Items that lost their file joined with picked files of the same name and size; a file may fit several."""
    return items.where("status = 'missing'").join(files, ["name", "size"])


def orphan_runs(starts: DataFrame, ends: DataFrame, marks: DataFrame) -> DataFrame:
    """Runs that began and never ended, with the last stage they marked (run, stage, ts)."""
    stage = marks.groupBy("run").agg(F.max_by("stage", "ts").alias("stage"))
    return starts.select("run").distinct().join(ends.select("run").distinct(), "run", "left_anti").join(stage, "run", "left")


def progress_of(done: pd.Series, total: pd.Series) -> pd.Series:
    """Progress of pandas series without looking back, 0.995 at most."""
    return (0.005 + 0.99 * (done / total).clip(upper=1.0)).clip(upper=0.995)


def eta_of(progress: pd.Series, done: pd.Series, total: pd.Series, elapsed: pd.Series) -> pd.Series:
    """Seconds to go, of pandas series: what the model has left, from 3 % on halved with what the pace so far makes of it."""
    model = (total - done).clip(lower=0.0)
    return model.where(progress <= 0.03, 0.5 * model + 0.5 * elapsed * (1 - progress) / progress)


def progress_report(log: DataFrame) -> DataFrame:
    """log (job, id, at, done, total, elapsed) -> progress that never moves back (0.995 at most) and seconds to go."""
    by = Window.partitionBy("job").orderBy("at", "id").rowsBetween(Window.unboundedPreceding, 0)
    now = F.least(F.lit(0.995), F.lit(0.005) + F.lit(0.99) * F.least(F.col("done"), F.col("total")) / F.col("total"))
    out = log.withColumn("progress", F.max(now).over(by))
    model = F.greatest(F.lit(0.0), F.col("total") - F.col("done"))
    seen = F.col("elapsed") * (1 - F.col("progress")) / F.col("progress")
    return out.withColumn("eta", F.when(F.col("progress") > 0.03, 0.5 * model + 0.5 * seen).otherwise(model))
