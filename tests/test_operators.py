"""Golden numbers, negative controls, round trips, and streams against batches."""

import itertools
import json
import math
import os
import pathlib
import time

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lodestrata.functions import scalars as S
from lodestrata.operators import audit, cloud, folds, jobs, lod, sketches, telemetry
from lodestrata.plans import levels
from lodestrata.sources import logs, ply
from lodestrata.sources.parts import PartStore, add_up
from lodestrata.streaming import telemetry as streams


def test_plan_levels_golden(spark):
    scenes = spark.createDataFrame([("a", 258_951_032), ("b", 20_000_000), ("c", 2_000_000)], "scene_id string, n long")
    count = lambda stop: {r["scene_id"]: r["count"] for r in levels.plan_levels(scenes, stop=stop).groupBy("scene_id").count().collect()}
    assert count(1_000_000) == {"a": 10, "b": 6, "c": 2}
    assert count(100_000) == {"a": 13, "b": 9, "c": 6}
    last = levels.plan_levels(scenes, stop=1_000_000).where("scene_id = 'a'").agg(F.min("planned_n")).first()[0]
    assert last == 505_764
    assert levels.plan_levels(scenes, stop=1, max_levels=99).groupBy("scene_id").count().agg(F.max("count")).first()[0] == 24


def test_plain_text(spark):
    row = spark.createDataFrame([("a‮b\x00c",), (None,), (" x\ny ",)], "t string").select(S.plain_text(F.col("t"), 10).alias("p"), S.plain_text(F.col("t"), 10, lines=True).alias("l")).collect()
    assert [r["p"] for r in row] == ["abc", "", "xy"]
    assert row[2]["l"] == "x\ny"


def test_crc_vector(spark):
    assert spark.range(1).select(F.crc32(F.lit("123456789").cast("binary"))).first()[0] == 0xCBF43926


def test_rate_limit_golden(spark):
    hits = [("k", i, 0.0) for i in range(11)] + [("k", 20 + i, 5400.0) for i in range(10)] + [("k", 40 + i, 14400.0) for i in range(11)]
    out = folds.rate_limit(spark.createDataFrame(hits, "key string, id long, at double"), ["key"], 10, 3600, "at", ("id",))
    got = {r["at"]: r["n"] for r in out.where("allowed").groupBy("at").agg(F.count("*").alias("n")).collect()}
    assert got == {0.0: 10, 5400.0: 5, 14400.0: 10}


def test_value_cap(spark):
    rows = [(i, f"2024-01-01 00:00:{i:02d}", "preset", f"v{i:02d}") for i in range(40)]
    e = spark.createDataFrame(rows, "event_id long, ts string, name string, value string").withColumn("ts", F.to_timestamp("ts"))
    out = telemetry.count_events(e).where("value IS NOT NULL").collect()
    assert len(out) == 33 and {r["n"] for r in out if r["value"] == "other"} == {8}


def test_conversion_rates_without_starts(spark):
    assert telemetry.conversion_rates(spark.createDataFrame([], "day string, name string, value string, n long")).count() == 0


def test_dedup_window_is_not_extended(spark):
    rows = [("k", 1, 0.0), ("k", 2, 80_000.0), ("k", 3, 86_400.0), ("k", 4, 90_000.0), ("j", 5, 1.0)]
    out = folds.dedup_window(spark.createDataFrame(rows, "key string, id long, at double"), ["key"], 86_400)
    assert {r["id"]: r["repeat_of"] for r in out.collect()} == {1: None, 2: 1, 3: None, 4: 3, 5: None}


def test_view_matrix_is_a_rotation(spark):
    m = cloud.view_matrix(F.lit(20.0), F.lit(-35.0), F.lit(110.0))
    row = spark.range(1).select(*(m[i][j].alias(f"m{i}{j}") for i in range(3) for j in range(3))).first()
    a = np.array(row).reshape(3, 3)
    assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and math.isclose(np.linalg.det(a), 1, abs_tol=1e-9)


def _cloud(spark, n=400):
    return spark.range(n).select(
        F.lit("s").alias("scene_id"), F.col("id").alias("record_no"), (F.col("id") % 20).cast("double").alias("x"), (F.col("id") / 7).alias("y"), (F.col("id") % 3).cast("double").alias("z"),
        *(F.lit(0.1).alias(f"f_dc_{i}") for i in range(3)), F.lit(1.0).alias("opacity"), *(F.lit(-3.0).alias(f"scale_{i}") for i in range(3)), F.lit(1.0).alias("rot_0"), *(F.lit(0.0).alias(f"rot_{i}") for i in range(1, 4)),
    )


def _down(tree, row):
    path = ""
    while tree[path]["axis"] >= 0:
        n, v = tree[path], row["xyz"[tree[path]["axis"]]]
        path += "L" if v is not None and (v < n["split"] or n["ties_left"] and v == n["split"]) else "R"
    return tree[path]["tile"]


def test_levels_are_exact_and_leaves_cover_all(spark):
    c = _cloud(spark)
    nodes = cloud.plan_kd_tiles(c, c.groupBy("scene_id").agg(F.count("*").alias("n")), 120)
    tiled = cloud.assign_tile(c, nodes)
    tree = {r["path"]: r for r in nodes.collect()}
    assert all(r["tile"] == _down(tree, r) for r in tiled.collect())
    for method in ("uniform", "adaptive"):
        built = lod.build_levels(tiled, 3, method=method)
        n = {(r["lod"], r["tile"]): r["count"] for r in built.groupBy("lod", "tile").count().collect()}
        for (level, tile), count in n.items():
            assert level == 0 or count == max(1, math.floor(n[level - 1, tile] * 0.5 + 0.5))
    leaves = lod.lod_leaves(built, 2.0, 10)
    assert leaves.agg(F.sum("n")).first()[0] == sum(n.values())
    with pytest.raises(ValueError):
        lod.decimate(tiled, method="none")


def test_rows_of_one_place_are_one_tile(spark):
    c = _cloud(spark, 50).withColumns({"x": F.lit(1.0), "y": F.lit(1.0), "z": F.lit(1.0)})
    nodes = cloud.plan_kd_tiles(c, c.groupBy("scene_id").agg(F.count("*").alias("n")), 5)
    assert [(r["axis"], r["tile"]) for r in nodes.collect()] == [(-1, 0)]


def test_output_names_skip_taken(spark):
    items = spark.createDataFrame([(i, "my scene.ply", "f") for i in range(4)], "id long, name string, folder string")
    taken = spark.createDataFrame([("f", "my_scene-SSOG-2.zip"), ("f", "my_scene-SSOG-4.zip")], "folder string, output string")
    assert [r["output"] for r in jobs.output_names(items, taken).orderBy("id").collect()] == ["my_scene-SSOG.zip", "my_scene-SSOG-3.zip", "my_scene-SSOG-5.zip", "my_scene-SSOG-6.zip"]


def test_scrub_json_and_client_key(spark):
    rows = spark.createDataFrame([(json.dumps({"stage": "x", "evil": 1, "input": {"File-Name": "a", "rows": 3}}),), ("nope",), (None,)], "d string")
    assert [r[0] for r in rows.select(S.scrub_json("d")).collect()] == ['{"stage":"x","input":{"rows":3}}', None, None]
    rows = spark.createDataFrame([("bad", "9.9.9.9, 2001:db8::1", "1.2.3.4"), (None, None, None), ("::ffff:1.2.3.4", None, None)], "a string, b string, c string")
    assert [r[0] for r in rows.select(S.client_key("a", "b", "c")).collect()] == ["2001:db8::/64", "?", "1.2.3.4"]


HEAD = ["ply", "format binary_little_endian 1.0", "element vertex 2", *(f"property float {p}" for p in ply.REQUIRED), "end_header"]


@pytest.mark.parametrize(
    ("code", "head"),
    [
        ("not-ply", b"no"), ("header-too-long", b"ply\nformat ascii 1.0\n"), ("bad-header", b"ply\nformat binary_little_endian 1.0\nend_header"),
        ("ascii-ply", b"ply\nformat ascii 1.0\nend_header\n"), ("bad-format", b"ply\nformat odd 1.0\nend_header\n"), ("bad-header", b"ply\nelement vertex 1\nend_header\n"),
        ("compressed-ply", b"ply\nformat binary_little_endian 1.0\nelement chunk 1\nend_header\n"), ("no-vertex", b"ply\nformat binary_little_endian 1.0\nelement face 1\nend_header\n"),
        ("unsupported-layout", b"ply\nformat binary_little_endian 1.0\nelement vertex 1\nproperty list uchar int v\nend_header\n"),
        ("empty", b"ply\nformat binary_little_endian 1.0\nelement vertex 0\nend_header\n"), ("not-splat", "\n".join(HEAD).replace("property float rot_3\n", "").encode() + b"\n"),
        ("bad-sh", "\n".join([*HEAD[:-1], *(f"property float f_rest_{i}" for i in range(10)), "end_header"]).encode() + b"\n"),
    ],
)
def test_reject_codes(code, head):
    with pytest.raises(ply.Rejected) as e:
        ply.parse_header(head)
    assert e.value.code == code


def test_truncated_and_big_endian(spark, tmp_path):
    (tmp_path / "short.ply").write_bytes("\n".join(HEAD).encode() + b"\n1234")
    assert ply.triage_inputs(spark, [str(tmp_path / "short.ply")]).first()["code"] == "truncated"
    c = cloud.keep_splat_columns(_cloud(spark, 100)).withColumn("f_rest", F.array_repeat(F.col("x").cast("float"), 9))
    ply.write_splats(c.repartition(2), str(tmp_path / "out"), big_endian=True)
    assert len(ply.committed(str(tmp_path / "out"))) == 2
    back = ply.read_splats(spark, str(tmp_path / "out"), 7)
    assert back.agg(F.count("*"), F.sum("x"), F.sum(F.get("f_rest", 8))).first() == c.agg(F.count("*"), F.sum("x"), F.sum(F.get("f_rest", 8))).first()


def test_audit_is_clean_without_faults(spark):
    leaves = spark.createDataFrame([("s", 0, "0_0", 0, 6), ("s", 0, "0_0", 6, 4), ("s", 1, "1_0", 0, 5)], "scene_id string, lod int, file string, offset long, n long")
    units = spark.createDataFrame([("s", "0_0", 10, ["meta.json"]), ("s", "1_0", 5, ["meta.json"])], "scene_id string, file string, rows long, files array<string>")
    entries = spark.createDataFrame([("s", "lod-meta.json", 1), ("s", "0_0/meta.json", 1), ("s", "1_0/meta.json", 1)], "scene_id string, name string, size long")
    manifest = spark.createDataFrame([("s", 1, 15, [10, 5], 2)], "scene_id string, version int, count long, counts array<long>, lod_levels int")
    expected = spark.createDataFrame([("s", 0, 10), ("s", 1, 5)], "scene_id string, lod int, n long")
    assert audit.audit_manifest(manifest, leaves, units, entries, expected).count() == 0
    rules = lambda **k: {r["rule"] for r in audit.audit_manifest(*(k.get(n, d) for n, d in (("m", manifest), ("l", leaves), ("u", units), ("e", entries), ("x", expected)))).collect()}
    assert rules(e=entries.where("name <> 'lod-meta.json'")) == {"V2"}
    assert rules(m=manifest.withColumn("lod_levels", F.lit(3))) == {"V4"}
    assert rules(x=expected.withColumn("n", F.col("n") + 1)) == {"V8"}
    assert rules(l=leaves.where("offset <> 6")) == {"V9", "V13"}
    assert rules(e=entries.withColumn("size", F.lit(11 << 30))) == {"V14"}
    assert rules(e=entries.union(entries.where("name = '1_0/meta.json'"))) == {"V15"}


def test_daily_totals_add_up_and_parts_are_replaced(spark, tmp_path):
    path = str(tmp_path / "totals")
    one = spark.createDataFrame([("2024-01-01", "a", None, 2), ("2024-01-02", "a", "x", 1)], "day string, name string, value string, n long")
    logs.write_daily_totals(one, path, "0")
    for _ in range(2):  # the second time replaces the first
        logs.write_daily_totals(one.where("day = '2024-01-01'"), path, "1")
    assert sorted((str(r["day"]), r["n"]) for r in logs.daily_totals(spark, path).collect()) == [("2024-01-01", 4), ("2024-01-02", 1)]


def test_read_jsonl_drops_bad_lines(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"id": "R-20240101-0001", "kind": "bug"}\n{broken\n{"id": "X"}\n')
    assert [r["id"] for r in logs.read_jsonl(spark, str(tmp_path / "r.jsonl")).collect()] == ["R-20240101-0001"]


def _stream(spark, df, path, files=3):
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(out, name, tmp_path):
    q = out.writeStream.outputMode("append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return q


def test_streams_equal_batches(spark, tmp_path):
    rows = spark.range(300).select(F.concat(F.lit("k"), (F.col("id") % 5).cast("string")).alias("key"), F.col("id"), (F.col("id") * 700 + 1_700_000_000).cast("double").alias("at"))
    src = _stream(spark, rows.orderBy("at").coalesce(1), str(tmp_path / "in"), 1)
    _run(streams.dedup_errors(src, 20_000), "dedup", tmp_path)
    want = {r["id"]: r["repeat_of"] for r in folds.dedup_window(rows, ["key"], 20_000).collect()}
    assert {r["id"]: r["repeat_of"] for r in spark.table("dedup").collect()} == want
    _run(streams.rate_limit(src, 3, 10_000), "limited", tmp_path)
    want = {r["id"]: r["allowed"] for r in folds.rate_limit(rows, ["key"], 3, 10_000, "at", ("id",)).collect()}
    assert {r["id"]: r["allowed"] for r in spark.table("limited").collect()} == want
    gated = rows.select(F.col("key").alias("visitor"), F.col("at").alias("ts"), F.col("id").alias("event_id"), F.when(F.col("id") % 11 == 0, "granted").when(F.col("id") % 17 == 0, "denied").alias("decision"))
    _run(streams.consent_gate(_stream(spark, gated.coalesce(1), str(tmp_path / "gate"), 1)), "gated", tmp_path)
    want = {r["event_id"] for r in telemetry.consent_gate(gated, "visitor", "ts", "event_id", "decision").collect()}
    assert {r["event_id"] for r in spark.table("gated").collect()} == want


def _finish(q):
    q.awaitTermination(120)
    return q


def test_stored_streams_equal_batches(spark, tmp_path):
    at = lambda p: str(tmp_path / p)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))
    events = spark.range(200).select(stamp.alias("ts"), F.col("id").alias("event_id"), F.concat(F.lit("e"), (F.col("id") % 2).cast("string")).alias("name"), F.when(F.col("id") % 5 > 0, F.concat(F.lit("v"), (F.col("id") % 7).cast("string"))).alias("value"))
    src = _stream(spark, events, at("events"))
    _finish(streams.store_totals(src, at("totals"), at("cp1")))
    assert {tuple(r) for r in streams.stored_totals(spark, at("totals"), 3).collect()} == {tuple(r) for r in telemetry.count_events(events, 3).collect()}
    store = PartStore(spark, at("totals"), streams.TOTALS)
    last = store.state()["batch"]
    store.add(telemetry.partial_counts(spark.read.parquet(at("events")).limit(0)), last)  # a batch that runs again replaces its part
    assert streams.stored_totals(spark, at("totals")).where("value IS NULL").agg(F.sum("n")).first()[0] < 200
    reports = events.select(F.col("ts").alias("at"), F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 9).alias("repeat_of"))
    _finish(streams.store_digest(_stream(spark, reports, at("reports")), at("digest"), at("cp2")))
    assert {tuple(r) for r in streams.stored_digest(spark, at("digest"), 2).collect()} == {tuple(r) for r in telemetry.error_digest(reports, 2).select("day", "repeat_of", "n", "rank").collect()}
    changes = spark.range(120).select((F.col("id") % 11).alias("id"), F.element_at(F.array(*map(F.lit, ("running", "editing", "done"))), (F.col("id") % 3 + 1).cast("int")).alias("status"), F.lit("waiting").alias("previous"), (F.col("id") % 2 == 0).alias("has_file"), F.col("id").alias("seq"))
    _finish(streams.store_queue(_stream(spark, changes, at("changes")), at("queue"), at("cp3")))
    assert {tuple(r) for r in streams.stored_queue(spark, at("queue")).collect()} == {tuple(r) for r in jobs.queue_state(changes).collect()}
    assert streams.stored_totals(spark, at("nothing")).count() == 0


def test_stored_reports_go_on_numbering_under_the_cap(spark, tmp_path):
    at = lambda p: str(tmp_path / p)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(F.col("id") * 20).cast("int"))
    rows = spark.range(120).select("id", stamp.alias("at"), (F.col("id") % 10 == 3).alias("suspect"), F.lit(10).cast("long").alias("bytes"))
    src = _stream(spark, rows.repartitionByRange(3, "at").sortWithinPartitions("at"), at("in"))
    _finish(streams.store_reports(src, at("out"), at("cp"), cap=200))
    out = streams.stored_reports(spark, at("out")).toPandas()
    assert len(out) == out["report_id"].nunique() == 120
    assert {d: sorted(int(i.split("-")[2]) for i in g) for d, g in out.groupby("day")["report_id"]} == {d: list(range(1, len(g) + 1)) for d, g in out.groupby("day")["report_id"]}
    held = out.groupby(["day", "diag_state"])["bytes"].sum()
    assert all(held.get((d, "kept"), 0) <= 200 for d in set(out["day"])) and set(out["diag_state"]) == {"kept", "skipped", "absent"}


def test_progress_stream_equals_batch(spark, tmp_path):
    log = spark.range(90).select((F.col("id") % 4).alias("job"), F.col("id"), (F.col("id") * 50 + 1_700_000_000).cast("double").alias("at"), (F.col("id") * 17 % 101).cast("double").alias("done"), F.lit(100.0).alias("total"), F.col("id").cast("double").alias("elapsed"))
    _run(streams.progress_stream(_stream(spark, log.coalesce(1), str(tmp_path / "in"), 1)), "progressing", tmp_path)
    got = {r["id"]: (round(r["progress"], 9), round(r["eta"], 9)) for r in spark.table("progressing").collect()}
    assert got == {r["id"]: (round(r["progress"], 9), round(r["eta"], 9)) for r in jobs.progress_report(log).collect()}


def test_folds_keep_null_keys_and_whole_longs(spark):
    big = 9_007_199_254_740_993
    rows = [(None, 1, 0, big), (None, 2, 5, big + 2), (None, 3, 9, None), (7.0, 4, 1, big), (float("nan"), 5, 2, big), (float("nan"), 6, 3, big)]
    table = spark.createDataFrame(rows, "key double, id long, at long, `a.b` long").repartition(3)
    out = folds.dedup_window(table, ["key"], 100).collect()
    assert {r["id"]: r["repeat_of"] for r in out} == {1: None, 2: 1, 3: 1, 4: None, 5: None, 6: 5}
    assert {r["id"]: r["a.b"] for r in out} == {r[1]: r[3] for r in rows}
    assert {r["id"]: r["allowed"] for r in folds.rate_limit(table, ["key"], 1, 100).collect()} == {1: True, 2: False, 3: False, 4: True, 5: True, 6: False}
    packed = folds.pack_groups(table.withColumn("w", F.lit(2.0)), ["key"], ["id"], "w", 4).collect()
    assert {r["id"]: r["group_no"] for r in packed} == {1: 0, 2: 0, 3: 1, 4: 0, 5: 0, 6: 0}


def test_joint_limits_use_up_the_client_first(spark):
    hits = [(i, c, float(i)) for i, c in enumerate("aaabbbccc")]
    out = folds.rate_limits(spark.createDataFrame(hits, "id long, client string, at double"), "client", 2, 3, 3600, "at", ("id",))
    assert {r["id"] for r in out.where("allowed").collect()} == {0, 1, 3}


def _splats(spark, rows):
    names = "scene_id string, tile int, record_no long, x double, y double, z double, f_dc_0 double, f_dc_1 double, f_dc_2 double, opacity double, scale_0 double, scale_1 double, scale_2 double, rot_0 double, rot_1 double, rot_2 double, rot_3 double, f_rest array<float>"
    return spark.createDataFrame([("s", 0, i, *r) for i, r in enumerate(rows)], names)


def _moments(scale, q):
    w, x, y, z = np.array(q) / np.linalg.norm(q)
    r = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    return r @ np.diag(np.exp(2 * np.array(scale))) @ r.T


@pytest.mark.parametrize("turns", [([1, 0, 0, 0], [-1, 0, 0, 0]), ([0.6, 0.2, -0.7, 0.1], [-0.6, -0.2, 0.7, -0.1]), ([0, 1, 0, 0], [0, 0.6, 0.8, 0]), ([0.9, 0.1, 0.3, -0.2], [0.1, -0.9, 0.3, 0.2])])
def test_merged_rows_have_the_moments_of_the_whole(spark, turns):
    scales, at = [[-1.0, -2.0, 0.0], [-1.0, -2.0, 0.0]], np.array([[0.0, 1.0, 2.0], [3.0, 1.0, 2.5]])
    rows = [(*map(float, at[i]), 0.1, 0.2, 0.3, 1.0, *scales[i], *map(float, turns[i]), [float(i)] * 9) for i in (0, 1)]
    out = lod.decimate(_splats(spark, rows), 0.5).first()
    assert out["merged"] == 2 and np.allclose([out[a] for a in "xyz"], at.mean(axis=0)) and out["f_rest"] == [0.5] * 9
    off = at - at.mean(axis=0)
    want = sum(_moments(scales[i], turns[i]) + np.outer(off[i], off[i]) for i in (0, 1)) / 2
    assert np.allclose(_moments([out[f"scale_{i}"] for i in range(3)], [out[f"rot_{i}"] for i in range(4)]), want, atol=1e-9)
    built = lod.build_levels(_splats(spark, rows * 3), 2)
    assert {len(r["f_rest"]) for r in built.collect()} == {9}


def test_a_row_alone_keeps_its_scales_and_turn(spark):
    row = (1.0, 2.0, 3.0, 0.1, 0.2, 0.3, 1.5, -1.0, -4.0, -2.0, 0.6, 0.2, -0.7, 0.1, [1.0] * 9)
    out = lod.decimate(_splats(spark, [row]), 0.5).first()
    assert [out[c] for c in ("opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3")] == list(row[6:14])


def test_sh_turns_colour_with_the_directions():
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    m = q * np.sign(np.linalg.det(q))
    d = rng.normal(size=(50, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    c = rng.normal(size=15)
    turn = cloud.sh_turn(m)
    assert np.allclose(cloud.sh_basis(d @ m.T) @ (turn @ c), cloud.sh_basis(d) @ c, atol=1e-8) and np.allclose(turn @ turn.T, np.eye(15), atol=1e-8)


@pytest.mark.parametrize(("up", "euler", "name"), [(1, [180.0, 0.0, 0.0], "+Y"), (-1, [0.0, 0.0, 0.0], "-Y")])
def test_auto_orient_of_a_flat_cloud_and_its_mirror(spark, up, euler, name):
    rng = np.random.default_rng(4)
    n = 4000
    xyz = np.column_stack([rng.uniform(-50, 50, n), up * np.concatenate([rng.normal(0, 0.2, n // 2), rng.exponential(1.5, n - n // 2)]), rng.uniform(-50, 50, n)])
    table = spark.createDataFrame([("s", *map(float, p)) for p in xyz], "scene_id string, x double, y double, z double")
    got = cloud.auto_orient(table).first()
    assert (got["euler"], got["up_axis"], got["confident"]) == (euler, name, True)
    # a tilt of more than the snapping allows is not called sure
    t = np.radians(40)
    tilted = xyz @ np.array([[1, 0, 0], [0, np.cos(t), -np.sin(t)], [0, np.sin(t), np.cos(t)]])
    assert not cloud.auto_orient(spark.createDataFrame([("s", *map(float, p)) for p in tilted], "scene_id string, x double, y double, z double")).first()["confident"]
    assert cloud.auto_orient(table.limit(50)).first()["up_axis"] == "?"


def test_quantiles_of_nulls_ties_and_nan(spark):
    rng = np.random.default_rng(5)
    values = [None] * 3 + [float("nan")] * 4 + [1.5] * 700 + rng.normal(size=2000).tolist() + [float("inf"), float("-inf")]
    table = spark.createDataFrame([(g, v) for g in ("a", None) for v in values] + [("b", None), ("c", 2.0)], "scene_id string, v double").repartition(4)
    order = sorted(values, key=lambda v: (v is not None, v is not None and v != v, 0 if v is None or v != v else v))
    qs = [0.0, 0.0005, 0.25, 0.5, 0.61, 0.9, 0.999, 1.0]
    got = {(r["scene_id"], r["q"]): r["value"] for r in cloud.quantiles(table, {"v": qs}).collect()}
    for g in ("a", None):
        assert [str(got[g, q]) for q in qs] == [str(order[math.floor(q * (len(order) - 1))]) for q in qs]
    assert got["b", 0.5] is None and got["c", 0.5] == 2.0


def test_routing_and_references_find_what_is_wrong(spark):
    c = _cloud(spark, 50).withColumn("tile", F.lit(0))
    totals = c.groupBy("scene_id").agg(F.count("*").alias("n"))
    assert cloud.reconcile_tiles(c, totals).first()["n"] == 50
    with pytest.raises(Exception, match="differ in scene s"):
        cloud.reconcile_tiles(c.limit(49), totals).collect()
    units = spark.createDataFrame([("s", 0, 0, 0, 0, 0)], "scene_id string, tile int, lod int, unit int, unit_no long, file_index long")
    leaves = spark.createDataFrame([("s", 0, 0, 0, 5), ("s", 0, 0, 1, 5)], "scene_id string, tile int, lod int, unit int, n long")
    assert lod.reference_units(leaves.where("unit = 0"), units).first()["file_index"] == 0
    with pytest.raises(Exception, match="unknown unit: s 0 0 1"):
        lod.reference_units(leaves, units).collect()
    for names, said in ((["0_0", "0_0"], "unit twice"), (["0_0", "x_1"], "no unit")):
        with pytest.raises(Exception, match=said):
            lod.parse_units(spark.createDataFrame([("s", 0, n) for n in names], "scene_id string, tile int, name string")).collect()
    nodes = spark.createDataFrame([("s", "", -1, 0)], "scene_id string, path string, axis int, tile int")
    with pytest.raises(Exception, match="no rows were written of scene s"):
        lod.scene_manifest(leaves.where("false").withColumns({a: F.lit(0.0) for k in ("min", "max") for a in (f"{k}_x", f"{k}_y", f"{k}_z")} | {"leaf": F.lit(""), "offset": F.lit(0), "file_index": F.lit(0)}), units, nodes).collect()


def test_archives_of_many_entries_need_a_wide_directory(spark):
    many = spark.range(70_000).select(F.lit("a").alias("path"), F.col("id").alias("seq"), F.col("id").cast("string").alias("name"), F.lit(1).cast("long").alias("size"))
    few = spark.createDataFrame([("b", 0, "123456789", 9)], "path string, seq long, name string, size long")
    flags = {r["path"]: r["w"] for r in audit.running_offsets(many.union(few)).groupBy("path").agg(F.max(F.col("zip64_directory").cast("int")).alias("w")).collect()}
    assert flags == {"a": 1, "b": 0}
    assert audit.running_offsets(few.withColumn("content", F.col("name"))).first()["crc"] == 0xCBF43926


def test_triage_names_what_is_wrong_with_each_file(spark, tmp_path):
    (tmp_path / "odd.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement vertex many\nend_header\n")
    (tmp_path / "bare.ply").write_bytes(b"ply\nformat binary_little_endian 1.0\nelement\nend_header\n")
    got = {r["path"].rsplit("/")[-1]: r["code"] for r in ply.triage_inputs(spark, [str(tmp_path / n) for n in ("odd.ply", "bare.ply", "gone.ply")]).collect()}
    assert got == {"odd.ply": "bad-header", "bare.ply": "bad-header", "gone.ply": "missing"}


def test_written_levels_are_floats_by_unit(spark, tmp_path):
    c = _cloud(spark, 60).withColumns({"lod": F.lit(0), "unit_no": (F.col("record_no") % 3).cast("int"), "f_rest": F.array(F.col("x"))})
    ply.write_levels(c, str(tmp_path / "levels"))
    back = spark.read.parquet(str(tmp_path / "levels"))
    kinds = dict(back.dtypes)
    assert (kinds["x"], kinds["f_rest"], back.select("unit_no").distinct().count(), back.count()) == ("float", "array<float>", 3, 60)


def test_a_shared_folder_is_asked_for_off_this_machine():
    from lodestrata.sources.tables import shared_path

    class Conf:
        def get(self, name, default=None):
            return {"spark.master": "spark://host:7077"}.get(name, default)

    class Session:
        conf = Conf()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_path(Session(), "x")




def test_ten_thousand_leaves_are_one_function_of_the_plan(spark):
    c = spark.range(40_000).select(F.lit("s").alias("scene_id"), F.col("id").alias("record_no"), *((F.xxhash64("id", F.lit(i)) % 100_000).cast("double").alias(a) for i, a in enumerate("xyz")))
    c = c.withColumn("x", F.when(F.col("record_no") == 7, float("nan")).when(F.col("record_no") != 8, F.col("x"))).union(c.limit(5).withColumn("scene_id", F.lit("no tree")))
    nodes = cloud.plan_kd_tiles(c.where("scene_id = 's'").na.fill(0.0), c.where("scene_id = 's'").groupBy("scene_id").agg(F.count("*").alias("n")), 4)
    tiled = cloud.assign_tile(c, nodes)
    plan = tiled._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and len(plan) < 4_000
    tree, rows = {r["path"]: r for r in nodes.collect()}, tiled.collect()
    assert sum(r["axis"] < 0 for r in tree.values()) >= 10_000
    assert all(r["tile"] == (_down(tree, r) if r["scene_id"] == "s" else None) for r in rows)


def test_a_join_of_decimated_tiles_is_planned_at_once(spark):
    c = _cloud(spark)
    nodes = cloud.plan_kd_tiles(c, c.groupBy("scene_id").agg(F.count("*").alias("n")), 6)
    tiled = cloud.assign_tile(c, nodes)
    n = tiled.groupBy("scene_id", "tile").agg(F.count("*").alias("before"))
    joined = lod.decimate(tiled, 0.5, "adaptive").groupBy("scene_id", "tile").agg(F.count("*").alias("after")).join(n, ["scene_id", "tile"])
    began = time.time()
    joined._jdf.queryExecution().executedPlan()
    assert time.time() - began < 4


@pytest.mark.parametrize("faint", [{"opacity": -800.0}, {"scale_0": -260.0, "scale_1": -260.0, "scale_2": -260.0}])
def test_rows_too_faint_for_a_double_weigh_alike(spark, faint):
    c = _cloud(spark, 40).withColumns({"tile": F.lit(0), **{k: F.lit(v) for k, v in faint.items()}})
    for method in ("uniform", "adaptive"):
        out = lod.decimate(c, 0.1, method).collect()
        assert sum(r["merged"] for r in out) == 40 and all(math.isfinite(r[k]) for r in out for k in ("x", "y", "z", "opacity", "scale_0", "rot_0"))
    assert lod.decimate(c, 1e-9).first()["x"] == pytest.approx(9.5)


def test_moments_far_from_the_origin_keep_their_digits(spark):
    rows = [(1e6 + i * 1e-3, -3e6 + i * 2e-3, 5e5, 0.1, 0.1, 0.1, 1.0, -12.0, -12.0, -12.0, 1.0, 0.0, 0.0, 0.0, [0.0] * 9) for i in range(4)]
    near = [(i * 1e-3, i * 2e-3, 0.0, *r[3:]) for i, r in enumerate(rows)]
    far, close = (lod.decimate(_splats(spark, r), 0.25).first() for r in (rows, near))
    assert all(far[k] == pytest.approx(close[k], abs=1e-4) for k in ("scale_0", "scale_1", "scale_2", "opacity"))
    quotas = [[tuple(r) for r in lod.cell_targets(lod._ranked(_splats(spark, [(x + shift, y, z, *rest) for x, y, z, *rest in near * 40])), 0.5).orderBy("cell").collect()] for shift in (0.0, 1e6)]
    assert quotas[0] == quotas[1]


def test_moments_beyond_a_double_stop_nothing(spark):
    c = _cloud(spark, 4).withColumns({"tile": F.lit(0), "scale_0": F.lit(800.0)})
    assert lod.decimate(c, 0.5).count() == 2


def test_scrubbed_json_is_json_whatever_comes_in(spark):
    deep = '{"stage":' + "[" * 100_000 + "]" * 100_000 + "}"
    rows = [('{"stage":"\\ud800x","input":{"\\udfff":1}}',), (deep,), ('{"stage":NaN,"input":[1e999,-Infinity,1.5]}',), ('{"stage":"ok"}',)]
    got = [r[0] for r in spark.createDataFrame(rows, "d string").select(S.scrub_json("d")).collect()]
    assert got == ['{"stage":"\ufffdx","input":{"\ufffd":1}}', None, '{"stage":null,"input":[null,null,1.5]}', '{"stage":"ok"}']


def test_event_values_are_strings_of_their_own_property(spark):
    given = ['{"a":{"count":"1"},"count":7}', '{"count":"7"}', '"12"', "7", '{"count":null}', "{broken", None, '[{"count":"7"}]', '{"count":{"count":"7"}}', '{"x":"\\"count\\":\\"9\\"","count":8}', '{"count":"1234"}']
    raw = spark.createDataFrame([("queue_add", p) for p in given] + [("lead_submit", '"7"'), ("page_view", '{"lang":"en"}'), ("unknown", None)], "e string, p string")
    accepted, rejected = telemetry.clean_events(raw.withColumn("i", F.monotonically_increasing_id()).coalesce(1))
    assert [r["value"] for r in accepted.orderBy("i").collect()] == [None, "7", "12", *[None] * 8, None, "en"] and rejected.count() == 1


def test_reports_without_a_time_repeat_none(spark):
    rows = [("k", 1, 10.0), ("k", 2, None), ("k", 3, 20.0), ("j", 4, None)]
    out = folds.dedup_window(spark.createDataFrame(rows, "key string, id long, at double"), ["key"], 100)
    assert {r["id"]: r["repeat_of"] for r in out.collect()} == {1: None, 2: None, 3: 1, 4: None}


def test_audit_finds_units_and_scenes_that_nothing_names(spark):
    entries = spark.createDataFrame([("a", "lod-meta.json", 1), ("a", "0_0/meta.json", 1), ("b", "0_0/meta.json", 1), ("b", "odd.txt", 1)], "scene_id string, name string, size long")
    units = spark.createDataFrame([("a", "0_0", 5, ["meta.json"])], "scene_id string, file string, rows long, files array<string>")
    leaves = spark.createDataFrame([], "scene_id string, lod int, file string, offset long, n long")
    manifest = spark.createDataFrame([("a", 1, 0, [], 0)], "scene_id string, version int, count long, counts array<long>, lod_levels int")
    found = {(r["scene_id"], r["rule"], r["subject"]) for r in audit.audit_manifest(manifest, leaves, units, entries).collect()}
    assert found == {("a", "V13", "0_0"), ("b", "V2", "lod-meta.json"), ("b", "V1", "odd.txt")}


def test_orientation_of_scenes_with_points_that_are_none(spark):
    rng = np.random.default_rng(4)
    flat = [("s", *map(float, p)) for p in np.column_stack([rng.uniform(-50, 50, 900), rng.exponential(1.5, 900), rng.uniform(-50, 50, 900)])]
    odd = [("s", float("nan"), 0.0, 0.0), ("s", None, 1.0, 2.0), ("s", float("inf"), 1.0, 2.0), ("none", float("nan"), 1.0, 1.0), *(("far", 1e200 * i, 1.0 * i, -1e190 * i) for i in range(200))]
    schema = "scene_id string, x double, y double, z double"
    got = {r["scene_id"]: tuple(r) for r in cloud.auto_orient(spark.createDataFrame(flat + odd, schema)).collect()}
    assert got["s"] == tuple(cloud.auto_orient(spark.createDataFrame(flat, schema)).first()) and got["none"][3] == "?" and got["far"][3] == "?"


def _stored(spark, path, n=30_000, parts=3):
    c = cloud.keep_splat_columns(_cloud(spark, n)).union(cloud.keep_splat_columns(_cloud(spark, 500).withColumn("scene_id", F.lit("t"))))
    ply.write_splats(c.repartitionByRange(parts, "scene_id", "record_no").sortWithinPartitions("scene_id", "record_no"), path)
    return c


class _Counted:
    """A file system whose reads are counted."""

    def __init__(self, fs, seen):
        self.fs, self.seen = fs, seen

    def __getattr__(self, name):
        return getattr(self.fs, name)

    def open_input_file(self, path):
        fs = self

        class File:
            def __init__(self):
                self.file = fs.fs.open_input_file(path)

            def __enter__(self):
                return self

            def __exit__(self, *_):
                self.file.close()

            def seek(self, at):
                self.file.seek(at)

            def read(self, n):
                out = self.file.read(n)
                fs.seen.append((path, len(out)))
                return out

        return File()


def test_a_block_sample_opens_only_its_blocks(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    c = _stored(spark, path, 60_000)
    blocks, size = 5, 20
    want = {(r["scene_id"], r["record_no"], r["block"]) for r in cloud.block_sample(c, blocks, size).collect()}
    got = ply.read_splats(spark, path, blocks=blocks, block_records=size)
    assert {(r["scene_id"], r["record_no"], r["block"]) for r in got.collect()} == want
    seen, plain = [], ply.located
    monkeypatch.setattr(ply, "located", lambda p: (_Counted(plain(p)[0], seen), plain(p)[1]))
    reader = ply.SplatPly({"path": path, "blocks": str(blocks), "block_records": str(size)}).reader(got.schema)
    rows = sum(b.num_rows for part in reader.partitions() for b in reader.read(part))
    total = sum(f.stat().st_size for f in (tmp_path / "out").rglob("*.ply"))
    assert rows == len(want) and sum(n for _, n in seen) < 0.01 * total


def test_filters_leave_out_files_and_ranges(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    c = _stored(spark, path, 9_000, 4)
    seen, plain = [], ply.located
    for where in ("scene_id = 't'", "record_no = 77", "record_no > 8990 AND scene_id = 's'", "record_no IN (1, 8000, 99999, NULL)", "record_no <= 3 AND record_no >= 2", "scene_id IN ('s', 'q') AND record_no < 5", "record_no < 0", "scene_id <=> 't' AND y < 3"):
        df = ply.read_splats(spark, path, 500).where(where)
        assert {(r["scene_id"], r["record_no"]) for r in df.collect()} == {(r["scene_id"], r["record_no"]) for r in c.where(where).collect()}, where
    from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual

    monkeypatch.setattr(ply, "located", lambda p: (_Counted(plain(p)[0], seen), plain(p)[1]))
    reader = ply.SplatPly({"path": path, "push_filters": "true", "records_per_split": "500"}).reader(df.schema)
    given = [EqualTo(("scene_id",), "s"), GreaterThanOrEqual(("record_no",), 8_990)]
    assert list(reader.pushFilters(given)) == given
    parts = reader.partitions()
    assert len(parts) == 1 and sum(b.num_rows for b in reader.read(parts[0])) == 10
    assert not any("-00000-" in p and n > 5000 for p, n in seen)


def test_a_set_of_files_is_seen_whole_or_not_at_all(spark, tmp_path):
    path, c = str(tmp_path / "out"), cloud.keep_splat_columns(_cloud(spark, 300))
    write = lambda df, **k: ply.write_splats(df, path, **k)
    write(c.repartition(3))
    before = ply.committed(path)
    odd = c.withColumn("x", F.when(F.col("record_no") == 250, F.raise_error(F.lit("late"))).otherwise(F.col("x")))
    with pytest.raises(Exception, match="late"):
        write(odd.repartition(3))
    assert ply.committed(path) == before and ply.read_splats(spark, path).count() == 300
    assert len([d for d in (tmp_path / "out").iterdir() if d.is_dir()]) == 1
    # a task that runs twice: only the files of the message that Spark commits count
    sink = ply.SplatPlyWriter(path, c.columns, False, True)
    message = ply.Written(0, [(before[0]["name"].replace("part", "other"), "s", 5)])
    assert message.files and sink.folder not in {f["name"].split("/")[0] for f in before}
    reader = ply.read_splats(spark, path)  # planned before the next set replaces this one
    write(c.limit(10).coalesce(1))
    assert ply.read_splats(spark, path).count() == 10 and len(ply.committed(path)) == 1 and reader.limit(0).count() == 0
    write(c.limit(7).coalesce(1), mode="append")
    assert sorted(r["record_no"] for r in ply.read_splats(spark, path).collect()) == list(range(17))
    assert len([d for d in (tmp_path / "out").iterdir() if d.is_dir()]) == 2
    with pytest.raises(Exception, match="one length"):
        write(c.withColumn("f_rest", F.array_repeat(F.lit(1.0), F.when(F.col("record_no") > 5, 9).otherwise(24))).coalesce(1))


@pytest.mark.parametrize(("n", "k"), [(1, 4), (3, 4), (9, 3), (14, 4), (20, 2), (12, 1), (11, 5)])
def test_palettes_are_the_best_of_all_cuts(n, k):
    rng = np.random.default_rng(n * k)
    v = np.sort(np.round(rng.normal(size=n), 1)) if n % 2 else np.sort(rng.normal(size=n))
    squared = lambda cut: sum(((v[a:b] - v[a:b].mean()) ** 2).sum() for a, b in zip((0, *cut), (*cut, n)))
    want = min(squared(cut) for j in range(min(k, n)) for cut in itertools.combinations(range(1, n), j))
    centres = lod.optimal_palette(rng.permutation(v), k)
    assert len(centres) <= k and np.all(np.diff(centres) > 0) and ((v - centres[np.abs(v[:, None] - centres).argmin(axis=1)]) ** 2).sum() == pytest.approx(want, abs=1e-12)


def test_palettes_leave_no_more_error_than_equal_steps(spark):
    rng = np.random.default_rng(6)
    rows = []
    for unit in range(4):
        scale = [rng.normal(size=3000), rng.exponential(size=3000), rng.uniform(-1e6, 1e6, 3000), np.concatenate([rng.normal(size=2999), [1e5]])][unit]
        rows += [("s", unit, i, *(float(scale[(i + j) % 3000]) for j in range(3)), 0.5, float(i % 7), None if i == 5 else float("nan") if i == 6 else 1.0) for i in range(3000)]
    table = spark.createDataFrame(rows, "scene_id string, unit int, record_no long, scale_0 double, scale_1 double, scale_2 double, f_dc_0 double, f_dc_1 double, f_dc_2 double").repartition(3)
    by = ["scene_id", "unit"]
    for groups in (None, {c: [c] for c in (*lod.SCALES, *lod.COLOUR)}):
        labels, palettes = lod.attribute_palettes(table, by, groups)
        errors = lod.palette_error(table, by, labels, palettes, groups).collect()
        assert len(errors) == 4 * len(groups or lod.SHARED) and all(r["rmse"] <= r["rmse_steps"] + 1e-12 for r in errors)
        assert labels.count() == 12_000 and labels.where("p_f_dc_2 IS NULL").count() == 8 and palettes.groupBy(*by, "name").count().agg(F.max("count")).first()[0] <= 256


def test_pair_merging_hits_its_goal_and_loses_less_than_runs(spark):
    rng = np.random.default_rng(7)
    centre = rng.normal(size=(300, 3)) * 30
    xyz = centre[rng.integers(0, 300, 4000)] + rng.normal(size=(4000, 3)) * rng.exponential(0.5, (4000, 1))
    rows = [(*map(float, p), 0.1, 0.2, 0.3, 1.0, -3.0, -3.0, -3.0, 1.0, 0.0, 0.0, 0.0, [0.0] * 9) for p in xyz]
    rows += [rows[0]] * 50 + [(float("nan"), *rows[0][1:]), (float("inf"), *rows[1][1:])]
    c = _splats(spark, rows)
    psnr = {}
    for method in ("uniform", "adaptive", "pairs"):
        out = lod.decimation_error(c.where("x < 1e9"), 0.5, method).first()
        assert (out["n"], out["groups"]) == (4050, 2025)
        psnr[method] = out["psnr"]
    assert psnr["pairs"] > psnr["adaptive"] + 3 and psnr["pairs"] > psnr["uniform"] + 3
    for ratio in (0.5, 0.1, 1e-9, 1.0):
        merged = lod.decimate(c, ratio, "pairs").collect()
        assert len(merged) == max(1, math.floor(4052 * ratio + 0.5)) and sum(r["merged"] for r in merged) == 4052 and {r["record_no"] for r in merged} == set(range(len(merged)))


def test_pairs_are_merged_as_by_looking_at_all_of_them(monkeypatch):
    monkeypatch.setattr(lod, "NEAR", 10**6)
    rng = np.random.default_rng(8)
    for n, goal in ((2, 1), (7, 3), (30, 15), (25, 24), (12, 12)):
        x, w = rng.integers(0, 5, (n, 4)).astype(float), rng.uniform(0.1, 2, n)
        members, at, weight = [[i] for i in range(n)], [v.copy() for v in x], list(w)
        while len(members) > goal:
            price = lambda i, j: weight[i] * weight[j] / (weight[i] + weight[j]) * ((at[i] - at[j]) ** 2).sum()
            best = [min((price(*sorted((i, j))), j) for j in range(len(members)) if j != i) for i in range(len(members))]
            pairs = sorted((best[i][0], i, best[i][1]) for i in range(len(members)) if i < best[i][1] and best[best[i][1]][1] == i)[: len(members) - goal]
            for _, i, j in pairs:
                at[i] += weight[j] / (weight[i] + weight[j]) * (at[j] - at[i])
                weight[i] += weight[j]
                members[i] += members[j]
            for j in sorted((p[2] for p in pairs), reverse=True):
                del members[j], at[j], weight[j]
        want = {i: k for k, held in enumerate(members) for i in held}
        assert lod.pair_merge(x, w, goal).tolist() == [want[i] for i in range(n)]


def test_long_tiles_are_paired_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(lod, "STRETCH", 70)
    c = _cloud(spark, 1001).withColumn("tile", F.lit(0))
    for ratio in (0.5, 0.013):
        out = lod.decimate(c, ratio, "pairs").collect()
        assert sum(r["merged"] for r in out) == 1001 and len(out) == max(1, math.floor(1001 * ratio + 0.5)) and {r["record_no"] for r in out} == set(range(len(out)))


def _folded(step, stretch, key, columns, size):
    """Values of a fold with and without stretches, and the seconds that each takes."""
    names = [f"c{i}" for i in range(len(columns))]
    table = pa.table([key, *columns], names=["key", *names])
    out = []
    for way in (stretch, None):
        began = time.time()
        kind = {"p": pa.int64(), "l": pa.bool_(), "r": pa.string()}[step[0]]
        values = [v for _, v in folds.fold_batches(iter(table.to_batches(size)), ["key"], names, kind, step[1], way)]
        out.append((pa.concat_arrays(values).to_pylist(), time.time() - began))
    return out


@pytest.mark.parametrize("seed", range(8))
def test_stretches_give_what_steps_give(seed):
    rng = np.random.default_rng(seed)
    n, size = 3000, int(rng.choice([70, 500, 3000]))
    key = pa.array(np.sort(rng.choice([0.5, 1.0, np.nan], n, p=[0.7, 0.2, 0.1])), pa.float64())
    gap = rng.exponential(1.0, n) * (rng.random(n) < 0.8) if seed % 2 else rng.integers(0, 3, n)
    base = np.zeros(n) + (1.7e9 if seed % 3 else 0)
    t = np.cumsum(gap) + base
    for k in (0.5, 1.0):  # times begin anew with each key
        at = np.flatnonzero(np.array([v == k for v in key.to_pylist()]))
        t[at] = np.cumsum(gap[at]) + base[at]
    times = pa.array(t if seed % 2 else t.astype(np.int64))
    ids = pa.array([None if i % 50 == 3 else f"r{i}" for i in range(n)])
    for weights in (rng.integers(0, 30, n), rng.integers(0, 3, n) * 40, rng.random(n), rng.integers(-3, 9, n), np.where(rng.random(n) < 0.01, 1 << 60, 5)):
        weight = pa.array([None if i % 97 == 5 else v for i, v in enumerate(weights.tolist())])
        for budget in (50, 0, 12.5):
            got, want = _folded(("p", folds.packing(budget)), folds.packing_stretch(budget), key, [weight], size)
            assert got[0] == want[0]
    for limit, window in ((3, 10.0), (40, 60.0), (500, 900.0), (1, 0.1), (100, 100), (7, 1e6)):
        got, want = _folded(("l", folds.limiting(limit, window)), folds.limiting_stretch(limit, window), key, [times], size)
        assert got[0] == want[0]
    for seconds in (0.5, 7.0, 200.0, 1e9):
        got, want = _folded(("r", folds.repeating(seconds)), folds.repeating_stretch(seconds), key, [times, ids], size)
        assert got[0] == want[0]


def test_stretches_of_one_key_are_ten_times_faster():
    n = 400_000
    rng = np.random.default_rng(9)
    key, t = pa.array(np.zeros(n, np.int64)), pa.array(np.cumsum(rng.exponential(1.0, n)))
    ways = [(("p", folds.packing(50_000)), folds.packing_stretch(50_000), [pa.array(rng.integers(1, 100, n))]), (("l", folds.limiting(2000, 3600.0)), folds.limiting_stretch(2000, 3600.0), [t]), (("r", folds.repeating(86_400.0)), folds.repeating_stretch(86_400.0), [t, pa.array(np.arange(n).astype(str))])]
    for step, stretch, columns in ways:
        took = [min(x) for x in zip(*([a[1] for a in _timed(step, stretch, key, columns)] for _ in range(3)))]
        assert took[1] > 8 * took[0], (step[0], took)


def _timed(step, stretch, key, columns):
    names = [f"c{i}" for i in range(len(columns))]
    batches = pa.table([key, *columns], names=["key", *names]).to_batches(100_000)
    kind = {"p": pa.int64(), "l": pa.bool_(), "r": pa.string()}[step[0]]
    for way in (stretch, None):
        began = time.time()
        for _ in folds.fold_batches(iter(batches), ["key"], names, kind, step[1], way):
            pass
        yield None, time.time() - began


def test_merged_sketches_are_right_within_their_bound(spark, tmp_path):
    rng = np.random.default_rng(10)
    kinds = {"s": rng.normal(size=60_000), "t": rng.integers(0, 50, 20_000).astype(float), "u": np.sort(rng.exponential(size=30_000))}
    rows = [(g, i % 5, float(v)) for g, held in kinds.items() for i, v in enumerate(held)] + [("s", 0, float("nan")), ("t", 1, None), ("none", 2, None)]
    table = spark.createDataFrame(rows, "scene_id string, batch int, v double").repartition(4)
    path = str(tmp_path / "sketches")
    for batch in (0, 1, 2, 3, 4, 2):  # a batch that is written again replaces itself
        sketches.store_sketches(table.where(F.col("batch") == batch).withColumn("w", -F.col("v")), ["v", "w"], path, str(batch))
    merged = sketches.stored_sketches(spark, path)
    qs = [0.0, 0.001, 0.02, 0.25, 0.5, 0.75, 0.98, 1.0]
    got = {(r["scene_id"], r["column"], r["q"]): r["value"] for r in sketches.sketch_quantiles(merged, {"v": qs, "w": [0.5]}).collect()}
    for g, held in kinds.items():
        for q in qs:
            v = got[g, "v", q]
            assert (held < v).mean() - 2 * sketches.RANK_ERROR <= q <= (held <= v).mean() + 2 * sketches.RANK_ERROR
        assert got[g, "v", 0.0] == held.min() and got[g, "v", 1.0] == held.max()
    assert got["none", "v", 0.5] is None and {r["scene_id"]: r["n_v"] for r in merged.collect()} == {"s": 60_000, "t": 20_000, "u": 30_000, "none": 0}
    sizes = merged.select(F.octet_length("sketch_v").alias("b")).where("b IS NOT NULL").collect()
    assert max(r["b"] for r in sizes) < 60_000
    whole = sketches.quantile_sketches(table.select("scene_id", F.col("v").alias("x"), F.col("v").alias("y"), F.col("v").alias("z")), ["x", "y", "z"])
    assert sketches.compare_sketches(whole, whole, [0.5], 0.0).where("equal").count() == 9


def test_parts_are_pruned_merged_and_swapped_as_a_whole(spark, tmp_path):
    path, schema = str(tmp_path / "store"), "day string, k string, n long"
    store, rows = PartStore(spark, path, schema), lambda *r: spark.createDataFrame(list(r), schema)
    assert store.read().count() == 0 and store.merge() == 0 and store.prune("2024-01-01") == 0
    for batch in range(6):
        store.add(rows(("2024-01-01", "a", 1), (f"2024-01-0{2 + batch % 2}", "b", batch), ("x/y=1", "c", 1)), str(batch), lambda w: {r["day"]: {"n": r["n"]} for r in w.groupBy("day").agg(F.sum("n").alias("n")).collect()})
    total = lambda s=store, **k: {(r["day"], r["k"]): r["n"] for r in s.read(**k).groupBy("day", "k").agg(F.sum("n").alias("n")).collect()}
    want = {("2024-01-01", "a"): 6, ("2024-01-02", "b"): 6, ("2024-01-03", "b"): 9, ("x/y=1", "c"): 6}
    assert total() == want and total(days=["2024-01-03"]) == {("2024-01-03", "b"): 9}
    begun = store.read()  # a reader that has its list before the swap
    assert store.merge(add_up(["day", "k"], ["n"])) == 15 and total() == want
    assert sorted(sum(p["day"] == d for p in store.state()["parts"]) for d in ("2024-01-01", "2024-01-02", "2024-01-03")) == [1, 2, 2]
    assert begun.count() == 18
    store.add(rows(("2024-01-01", "a", 100)), "5", lambda w: {"2024-01-01": {"n": 7}})  # the newest batch runs again
    assert total()["2024-01-01", "a"] == 105 and total()["2024-01-03", "b"] == 4
    assert store.counters("5") == {"2024-01-01": {"n": 1}, "2024-01-02": {"n": 4}, "2024-01-03": {"n": 3}, "x/y=1": {"n": 1}} and store.counters("6")["2024-01-01"] == {"n": 7}
    opened = [r[0] for r in store.read(since="2024-01-03").select(F.input_file_name()).distinct().collect()]
    assert opened and not any("2024-01-01" in f or "2024-01-02" in f for f in opened)
    assert store.prune("2024-01-02") == 2 and ("2024-01-01", "a") not in total()
    # two writers at once: the second one's swap starts from the first one's list
    swapped, other = store.state(), PartStore(spark, path, schema)
    plain, calls = PartStore.state, []

    def stale(self):
        calls.append(1)
        if len(calls) == 1:
            found = plain(self)
            other.add(rows(("2024-01-09", "d", 1)), "77")
            return found
        return plain(self)

    store.state = lambda: stale(store)
    store.add(rows(("2024-01-09", "e", 1)), "78")
    del store.state
    assert {("2024-01-09", "d"), ("2024-01-09", "e")} <= set(total()) and swapped["number"] < store.state()["number"]
    # a list that its writer never finished is passed over
    torn = tmp_path / "store" / "_lists" / f"{store.state()['number'] + 1:012d}"
    torn.write_text('{"parts": [')
    os.utime(torn, (1, 1))
    store.add(rows(("2024-01-10", "f", 1)), "79")
    before = total()
    assert ("2024-01-10", "f") in before and ("2024-01-09", "e") in before
    assert store.vacuum(1) > 0 and total() == before and len(list((tmp_path / "store" / "data").iterdir())) == len({p["name"].split("/")[1] for p in store.state()["parts"]})


def test_stored_streams_are_tidied(spark, tmp_path):
    at = lambda p: str(tmp_path / p)
    stamp = F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))
    events = spark.range(96).select(stamp.alias("ts"), F.col("id").alias("event_id"), F.lit("e").alias("name"), F.concat(F.lit("v"), (F.col("id") % 7).cast("string")).alias("value"))
    _finish(streams.store_totals(_stream(spark, events, at("events"), 4), at("totals"), at("cp")))
    want = {tuple(r) for r in streams.stored_totals(spark, at("totals"), 3).collect()}
    streams.tidy(spark, at("totals"), streams.TOTALS)
    assert {tuple(r) for r in streams.stored_totals(spark, at("totals"), 3).collect()} == want and len(PartStore(spark, at("totals"), streams.TOTALS).state()["parts"]) <= 8
    streams.tidy(spark, at("totals"), streams.TOTALS, "2024-01-03")
    assert {r["day"] for r in streams.stored_totals(spark, at("totals")).collect()} == {"2024-01-03", "2024-01-04"}
    path = at("daily")
    for part in "0123":
        logs.write_daily_totals(spark.createDataFrame([("2024-01-01", "a", None, 2)], "day string, name string, value string, n long"), path, part)
    assert logs.merge_daily_totals(spark, path) == 3 and [r["n"] for r in logs.daily_totals(spark, path).collect()] == [8]
    rows = spark.range(90).select("id", (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("at"))
    _finish(streams.store_reports(_stream(spark, rows, at("reports")), at("out"), at("cp2")))
    assert streams.prune_reports(spark, at("out"), "2024-01-10", 7) > 0
    assert {r["day"] for r in streams.stored_reports(spark, at("out")).collect()} == {"2024-01-03", "2024-01-04"}


def test_a_finished_query_leaves_only_its_result(spark, tmp_path):
    from lodestrata.sources.tables import temporary

    shared = pathlib.Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    held = lambda: {p.name for p in shared.iterdir()} if shared.exists() else set()
    c, before = _cloud(spark), held()
    with temporary(spark):
        nodes = cloud.plan_kd_tiles(c, c.groupBy("scene_id").agg(F.count("*").alias("n")), 100)
        built = lod.build_levels(cloud.assign_tile(c, nodes), 3)
        with temporary(spark):
            cloud.quantiles(c, {"x": [0.5]}).collect()
        assert len(held() - before) == 4
        built.write.parquet(str(tmp_path / "result"))
    assert held() == before and spark.read.parquet(str(tmp_path / "result")).count() == 700
