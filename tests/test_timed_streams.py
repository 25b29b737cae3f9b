"""Streams with timers against the batch operators on the same rows."""

import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestrata.operators import folds, telemetry
from lodestrata.streaming import timed


@pytest.fixture(scope="module", autouse=True)
def provider(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    yield
    spark.conf.set(key, before)


def _batches(spark, rows, schema, folder):
    """A stream with a micro-batch for each list of rows."""
    for i, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{folder}/p={i}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(f"{folder}/*")


def _run(out, name, checkpoint):
    q = out.writeStream.outputMode("append").format("parquet").option("path", f"{checkpoint}-out").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    assert q.awaitTermination(180)
    return q


def test_each_day_is_digested_once(spark, tmp_path):
    rng = np.random.default_rng(1)
    start = datetime.datetime(2024, 3, 1)
    rows = [(start + datetime.timedelta(days=int(d), seconds=int(s)), None if v == 0 else int(v)) for d, s, v in zip(rng.choice([0, 1, 3, 4], 400), rng.integers(0, 86_400, 400), rng.integers(0, 9, 400))]
    rows.sort()
    schema, folder, checkpoint = "at timestamp, repeat_of long", str(tmp_path / "in"), str(tmp_path / "cp")
    late = [(start + datetime.timedelta(days=20), 1)]
    _run(timed.daily_digest(_batches(spark, [rows[:150], rows[150:220]], schema, folder), 4, "1 hour"), "digest", checkpoint)
    # a restart: the rest comes to a new query with the same checkpoint
    for i, some in enumerate([rows[220:], late], 2):
        spark.createDataFrame(some, schema).coalesce(1).write.parquet(f"{folder}/p={i}")
    again = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
    _run(timed.daily_digest(again, 4, "1 hour"), "digest", checkpoint)
    got = sorted(tuple(r) for r in spark.read.parquet(f"{checkpoint}-out").select("day", "rank", "repeat_of", "n").collect())
    want = telemetry.error_digest(spark.createDataFrame(rows, schema), 4).select("day", "rank", "repeat_of", "n").collect()
    assert got == sorted(map(tuple, want)) and {r[0] for r in got} == {"2024-03-01", "2024-03-02", "2024-03-04", "2024-03-05"}


def test_joint_limits_of_shuffled_batches_equal_the_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    at = np.sort(rng.integers(0, 40_000, 500)) + 1_700_000_000
    hits = [(f"c{int(c)}", float(t), i) for i, (t, c) in enumerate(zip(at, rng.integers(0, 6, 500)))]
    schema = "client string, at double, id long"
    mixed = [hits[i] for i in rng.permutation(250)], [hits[250 + i] for i in rng.permutation(250)]
    batches = [mixed[0][:90], mixed[0][90:], mixed[1][:120], mixed[1][120:], [("end", 1.8e9, 10_000)], [("end", 1.9e9, 10_001)]]
    out = timed.rate_limits(_batches(spark, batches, schema, str(tmp_path / "in")), "client", 5, 18, 3_600.0, "12 hours")
    _run(out, "limits", str(tmp_path / "cp"))
    got = {r["id"]: r["allowed"] for r in spark.read.parquet(str(tmp_path / "cp-out")).where("id < 10000").collect()}
    want = {r["id"]: r["allowed"] for r in folds.rate_limits(spark.createDataFrame(hits, schema), "client", 5, 18, 3_600.0, "at", ("id",)).collect()}
    assert len(got) == 500 and got == want and 50 < sum(want.values()) < 450
