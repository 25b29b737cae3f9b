"""Steps whose tasks must not grow with a scene, a table or a text."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import audit, cloud, lod
from lodestrata.plans import catalog, views
from lodestrata.sources import tables
from tests.oracle import SF, same


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_splats_are_numbered_without_sorting_a_scene(spark):
    """F16 to F32: a window over a scene was one task's sort."""
    assert "Window" not in _plan(views.splats(spark, SF))
    want = views.view(spark, SF, views.SPLATS, "lineitem")
    got = views.splats(spark, SF)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


@pytest.mark.parametrize("rows", [7, 1_000_000])
def test_number_records(spark, monkeypatch, rows):
    """Ranges that scenes share, groups larger than a range, a null group."""
    monkeypatch.setattr(tables, "TASK_ROWS", rows)
    df = spark.range(500).select(F.when(F.col("id") % 10 < 7, "a").when(F.col("id") % 10 < 9, "b").alias("g"), (F.col("id") * 7919 % 500 - 250).alias("v"), F.lit(1).alias("w"))
    got = {(r["g"], r["v"]): r["record_no"] for r in cloud.number_records(df, ["w", "v"], "g").collect()}
    want = df.withColumn("n", F.row_number().over(Window.partitionBy("g").orderBy("v")) - 1)
    assert got == {(r["g"], r["v"]): r["n"] for r in want.collect()}


def test_numbering_deals_rows_by_their_number(spark, monkeypatch):
    monkeypatch.setattr(tables, "TASK_ROWS", 10)
    seen = []
    monkeypatch.setattr(cloud, "persisted", lambda df, name: seen.append((name, df)) or tables.persisted(df, name))
    cloud.number_records(spark.range(400).select(F.lit("a").alias("g"), "id"), ["id"], "g")
    most = dict(seen)["numbered"].groupBy("__range").count().agg(F.max("count")).first()[0]
    assert most <= 40


@pytest.mark.parametrize("made", [
    lambda s: lod.quantize(s, ["scene_id"]), lambda s: lod.quantize_attributes(s, ["scene_id"]), lambda s: cloud.strided_sample(s, 50), lambda s: cloud.block_sample(s, 4, 16),
    lambda s: cloud.transform_positions(s, s.select("scene_id").distinct().withColumn("rotation", F.array(*[F.lit(5.0)] * 3)).withColumn("translation", F.array(*[F.lit(1.0)] * 3))),
])
def test_rows_are_not_dealt_by_scene(spark, made):
    """F29 to F34: bounds, steps, blocks and turns of a scene are small tables of known size, so no row moves to meet them."""
    plan = made(views.splats(spark, SF))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan and "hashpartitioning(scene_id" not in plan


def test_nesting_is_told_without_walking_down(monkeypatch):
    """a text of endless brackets cost a millisecond of the parser each."""
    parsed = []
    monkeypatch.setattr(S.json, "loads", lambda t: parsed.append(t) or {})
    deep = '{"stage":' + "[" * 20_000
    assert S.scrub_json.func(pd.Series([deep, deep + "]" * 20_000 + "}"])).tolist() == [None, None] and not parsed


def test_brackets_that_do_not_nest_are_read(spark):
    """Brackets in strings, behind escaped quotes, side by side, and one level less than the limit."""
    some = "[" * 20_000
    texts = ['{"stage":"' + some + '"}', '{"stage":"\\"' + some + '\\\\"}', '{"input":[' + ",".join(["[]"] * 12_000) + "]}", '{"stage":' + "[" * 9_000 + "]" * 9_000 + "}", '{"stage":"' + '\\"' * 9_000 + some]
    got = S.scrub_json.func(pd.Series(texts)).tolist()
    assert [g is not None for g in got] == [True, True, True, True, False]
    assert [S._bottomless(t) for t in (*texts, some[:10_000], some[:9_999], some[:6_000] + "]" * 6_000 + some[:6_000])] == [False] * 5 + [True, False, False]


def test_odd_reports_are_spread(spark, monkeypatch):
    """all texts of a file were made and parsed in one task."""
    from lodestrata.plans import telemetry_queries as t

    monkeypatch.setattr(t, "ODD_ROWS", 10)
    assert t.scrub_odd_json(spark, SF).select(F.spark_partition_id().alias("p")).distinct().count() > 10


def test_manifests_of_pages_that_share_addresses(spark, tmp_path):
    """either side took any page of an address, so equal entries counted as changed."""
    url = F.concat(F.lit("h"), F.repeat(F.lit("x"), (F.col("page_id") % 60).cast("int")))
    pages = spark.range(6_000).select(F.col("id").alias("page_id")).select("page_id", url.alias("url"), F.when(F.col("page_id") % 60 != 6, F.col("page_id").cast("string")).alias("html"))
    pages.repartition(16, "page_id").write.parquet(str(tmp_path / "pages.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        same(catalog.QUERIES["compare_manifests"](spark, str(tmp_path)), catalog.ORACLES["compare_manifests"], con)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_entries_without_a_crc(spark):
    of = lambda rows: spark.createDataFrame(rows, "name string, crc long")
    got = audit.compare_manifests(of([("a", None), ("b", None), ("c", 1), ("d", None)]), of([("a", 1), ("b", None), ("c", None), ("e", None)]))
    assert {tuple(r) for r in got.collect()} == {("a", "changed"), ("c", "changed"), ("d", "gone"), ("e", "added")}
