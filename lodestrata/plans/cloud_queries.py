"""Queries of clouds, levels, audits and sources over the driver's tables, with their oracles."""

from __future__ import annotations

import io
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.operators import audit, cloud, folds, lod, sketches
from lodestrata.plans.views import SPLATS, load, splats, unnumbered_splats
from lodestrata.sources import logs, ply
from lodestrata.sources.files import located
from lodestrata.sources.tables import persisted, shared_path, tasks_for

Q: dict = {}
O: dict[str, str] = {}
AXES = ("x", "y", "z")
SPLAT_SQL = SPLATS.strip()
#: Rows of a tile in the queries, depth that the unrolled oracle of the k-d plan covers.
TILE_ROWS, ORACLE_DEPTH = 4_000, 4


def query(f):
    Q[f.__name__] = f
    return f


def _r(c: str, digits: int = 6):
    return F.round(c, digits).alias(c)


def _bad(spark: SparkSession, d: str) -> DataFrame:
    x = F.when(F.col("suppkey") % 97 == 0, float("nan")).when(F.col("suppkey") % 89 == 0, float("inf")).otherwise(F.col("x"))
    return splats(spark, d).withColumn("x", x)


@query
def filter_finite(spark: SparkSession, d: str) -> DataFrame:
    return cloud.filter_finite(cloud.keep_splat_columns(_bad(spark, d))).groupBy("scene_id").agg(F.count("*").alias("n"), F.min("record_no").alias("first"), F.sum("record_no").alias("records"), F.round(F.sum("x"), 3).alias("x"))


O["filter_finite"] = f"SELECT scene_id, count(*) AS n, min(record_no) AS first, CAST(sum(record_no) AS BIGINT) AS records, round(sum(x), 3) AS x FROM ({SPLAT_SQL}) WHERE suppkey % 97 <> 0 AND suppkey % 89 <> 0 GROUP BY 1"


@query
def filter_bands(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 45).alias("f_rest"))
    return cloud.filter_bands(e, 2).select("vec_id", F.size("f_rest").alias("size"), *(F.round(F.get("f_rest", i).cast("double"), 6).alias(f"c{i}") for i in (0, 7, 8, 16, 23)))


O["filter_bands"] = "SELECT vec_id, 24 AS size, " + ", ".join(f"round(embedding[{j}]::DOUBLE, 6) AS c{i}" for i, j in ((0, 1), (7, 8), (8, 16), (16, 31), (23, 38))) + " FROM embeddings"

_N = f"(SELECT scene_id, max(record_no) + 1 AS n FROM ({SPLAT_SQL}) GROUP BY 1)"
SAMPLE = f"""
SELECT s.*, block FROM ({SPLAT_SQL}) s JOIN (
  SELECT scene_id, block, CAST(floor(block / b::DOUBLE * greatest(0, n - p)) AS BIGINT) AS st, p FROM (
    SELECT *, unnest(range(0, b)) AS block FROM (SELECT scene_id, n, CAST(greatest(1, least(64, ceil(n / 256.0))) AS BIGINT) AS b, least(256, n) AS p FROM {_N}))) k
ON s.scene_id = k.scene_id AND s.record_no >= st AND s.record_no < st + p"""


@query
def block_sample(spark: SparkSession, d: str) -> DataFrame:
    return cloud.block_sample(splats(spark, d), 64, 256).select("scene_id", "record_no", "block")


O["block_sample"] = f"SELECT scene_id, record_no, block FROM ({SAMPLE})"


@query
def preview_sample(spark: SparkSession, d: str) -> DataFrame:
    return cloud.preview_sample(_bad(spark, d), 3_000).select("scene_id", "record_no", "r", "g", "b")


_BYTE = "CAST(least(255, greatest(0, floor((0.5::DOUBLE + 0.28209479::DOUBLE * f_dc_{}) * 255 + 0.5))) AS INT)"
O["preview_sample"] = f"""
WITH k AS (SELECT scene_id, block, CAST(floor(block / b::DOUBLE * greatest(0, n - p)) AS BIGINT) AS st, p FROM (
    SELECT *, unnest(range(0, b)) AS block FROM (SELECT *, CAST(least(n, ceil(9000 / b::DOUBLE)) AS BIGINT) AS p FROM (SELECT scene_id, n, CAST(least(1024, greatest(16, ceil(n / 50000.0))) AS BIGINT) AS b FROM {_N})))),
v AS (SELECT s.*, row_number() OVER (PARTITION BY s.scene_id ORDER BY block, record_no) AS r FROM ({SPLAT_SQL}) s JOIN k ON s.scene_id = k.scene_id AND record_no >= st AND record_no < st + p
      WHERE suppkey % 97 <> 0 AND suppkey % 89 <> 0 AND 1 / (1 + exp(-opacity)) >= 0.35)
SELECT scene_id, record_no, {", ".join(f"{_BYTE.format(i)} AS {c}" for i, c in enumerate("rgb"))} FROM v WHERE r <= 3000"""


@query
def strided_sample(spark: SparkSession, d: str) -> DataFrame:
    s = cloud.strided_sample(splats(spark, d), 500)
    ground = cloud.quantile_at(s, "y", 0.02).withColumnRenamed("value", "ground")
    return s.groupBy("scene_id").agg(F.count("*").alias("n"), *(f(a).alias(f"{k}_{a}") for a in AXES for k, f in (("min", F.min), ("max", F.max)))).join(ground, "scene_id")


_STRIDED = f"SELECT s.* FROM ({SPLAT_SQL}) s JOIN {_N} k ON s.scene_id = k.scene_id WHERE record_no % greatest(1, n // 500) = 0"
O["strided_sample"] = f"""
WITH s AS ({_STRIDED}), q AS (SELECT scene_id, y, row_number() OVER (PARTITION BY scene_id ORDER BY y) AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM s)
SELECT s.scene_id, count(*) AS n, {", ".join(f"{k}(s.{a}) AS {k}_{a}" for a in AXES for k in ("min", "max"))}, any_value(g.y) AS ground
FROM s JOIN q g ON g.scene_id = s.scene_id AND g.r = CAST(floor(0.02 * (g.n - 1)) AS BIGINT) + 1 GROUP BY 1"""


def _nodes(s: DataFrame) -> DataFrame:
    sample = cloud.block_sample(s, 64, 64)
    return persisted(cloud.plan_kd_tiles(sample, s.groupBy("scene_id").agg(F.count("*").alias("n")), TILE_ROWS), "kd")


@query
def plan_kd_tiles(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(splats(spark, d)).select("scene_id", "path", "axis", _r("split"), "ties_left", "tile", "est")


def _kd_sql() -> str:
    """Unrolled levels of the plan: points p<i>, nodes n<i>."""
    parts = [
        f"s AS ({SPLAT_SQL})", f"t AS (SELECT scene_id, count(*) AS n FROM s GROUP BY 1)",
        f"""p0 AS (SELECT s.scene_id, x, y, z, '' AS path FROM s JOIN (SELECT scene_id, CAST(floor(block / b::DOUBLE * greatest(0, n - p)) AS BIGINT) AS st, p FROM (
          SELECT *, unnest(range(0, b)) AS block FROM (SELECT scene_id, n, CAST(greatest(1, least(64, ceil(n / 64.0))) AS BIGINT) AS b, least(64, n) AS p FROM t))) k
          ON s.scene_id = k.scene_id AND record_no >= st AND record_no < st + p)""",
        "f AS (SELECT p0.scene_id, any_value(n) / count(*)::DOUBLE AS scale FROM p0 JOIN t USING (scene_id) GROUP BY 1)",
    ]
    for i in range(ORACLE_DEPTH + 1):
        parts += [
            f"""a{i} AS (SELECT scene_id, path, count(*) AS c, max(x) - min(x) AS ex, max(y) - min(y) AS ey, max(z) - min(z) AS ez FROM p{i} GROUP BY ALL)""",
            f"""b{i} AS (SELECT a.scene_id, path, c, c * scale AS est, CASE WHEN c * scale <= {TILE_ROWS} OR c < 2 OR greatest(ex, ey, ez) <= 0 THEN -1 WHEN ex >= ey AND ex >= ez THEN 0 WHEN ey >= ez THEN 1 ELSE 2 END AS axis FROM a{i} a JOIN f USING (scene_id))""",
            f"""v{i} AS (SELECT p.*, axis, c, CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END AS v FROM p{i} p JOIN b{i} b USING (scene_id, path) WHERE axis >= 0)""",
            f"""r{i} AS (SELECT scene_id, path, v AS split FROM (SELECT *, row_number() OVER (PARTITION BY scene_id, path ORDER BY v) AS r FROM v{i}) WHERE r = c // 2 + 1)""",
            f"""l{i} AS (SELECT scene_id, path, any_value(split) AS split, count(*) FILTER (v < split) AS less, count(*) FILTER (v <= split) AS upto FROM v{i} JOIN r{i} USING (scene_id, path) GROUP BY ALL)""",
            f"""n{i} AS (SELECT b.scene_id, path, CASE WHEN axis >= 0 AND less = 0 AND upto = c THEN -1 ELSE axis END AS axis, CASE WHEN axis >= 0 AND NOT (less = 0 AND upto = c) THEN split END AS split,
              CASE WHEN axis >= 0 AND NOT (less = 0 AND upto = c) THEN less = 0 END AS ties_left, CAST(floor(est + 0.5) AS BIGINT) AS est FROM b{i} b LEFT JOIN l{i} USING (scene_id, path))""",
            f"""p{i + 1} AS (SELECT p.scene_id, x, y, z, path || CASE WHEN (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) < split OR (ties_left AND (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) = split) THEN 'L' ELSE 'R' END AS path
              FROM p{i} p JOIN n{i} n USING (scene_id, path) WHERE axis >= 0)""",
        ]
    every = " UNION ALL ".join(f"SELECT * FROM n{i}" for i in range(ORACLE_DEPTH + 1))
    parts.append(f"kd AS (SELECT *, CASE WHEN axis < 0 THEN row_number() OVER (PARTITION BY scene_id, axis < 0 ORDER BY path) - 1 END AS tile FROM ({every}))")
    # rows to tiles: one step per level
    parts.append("w0 AS (SELECT *, '' AS path FROM s)")
    for i in range(ORACLE_DEPTH):
        parts.append(f"""w{i + 1} AS (SELECT w.* EXCLUDE (path), w.path || CASE WHEN coalesce(axis, -1) < 0 THEN '' WHEN (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) < split OR (ties_left AND (CASE axis WHEN 0 THEN x WHEN 1 THEN y ELSE z END) = split) THEN 'L' ELSE 'R' END AS path
          FROM w{i} w LEFT JOIN kd ON kd.scene_id = w.scene_id AND kd.path = w.path AND length(w.path) = {i})""")
    parts.append(f"g AS (SELECT w.*, tile FROM w{ORACLE_DEPTH} w JOIN kd USING (scene_id, path) WHERE axis < 0)")
    return "WITH " + ",\n".join(parts)


KD = _kd_sql()
O["plan_kd_tiles"] = f"{KD} SELECT scene_id, path, axis, round(split, 6) AS split, ties_left, CAST(tile AS INT) AS tile, est FROM kd"


def _tiled(spark: SparkSession, d: str) -> DataFrame:
    s = splats(spark, d)
    return cloud.assign_tile(s, _nodes(s))


@query
def assign_tile(spark: SparkSession, d: str) -> DataFrame:
    return _tiled(spark, d).select("scene_id", "record_no", "tile")


O["assign_tile"] = f"{KD} SELECT scene_id, record_no, CAST(tile AS INT) AS tile FROM g"


def _spread_sql(v: str) -> str:
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        v = f"(({v} | ({v} << {shift})) & {mask})" if shift == 16 else f"(({v} | ({v} << {shift})) & {mask})"
    return v


def _morton_sql(source: str, by: str = "scene_id, tile") -> str:
    """A chain of subqueries, so that each step of the bit spreading is written once."""
    cells = ", ".join(f"CASE WHEN max({a}) OVER w > min({a}) OVER w THEN CAST(floor(({a} - min({a}) OVER w) * 1023.999::DOUBLE / (max({a}) OVER w - min({a}) OVER w)) AS BIGINT) ELSE 0 END AS i{a}" for a in AXES)
    sql = f"SELECT *, {cells} FROM ({source}) WINDOW w AS (PARTITION BY {by})"
    for shift, mask in ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249)):
        sql = f"SELECT * REPLACE ({', '.join(f'((i{a} | (i{a} << {shift})) & {mask}) AS i{a}' for a in AXES)}) FROM ({sql})"
    return f"SELECT * EXCLUDE (ix, iy, iz), CAST(ix | (iy << 1) | (iz << 2) AS INT) AS code FROM ({sql})"


@query
def morton_code(spark: SparkSession, d: str) -> DataFrame:
    return cloud.morton_code(_tiled(spark, d)).select("scene_id", "tile", "record_no", "code")


MORTON = _morton_sql("SELECT * EXCLUDE (path) FROM g")
O["morton_code"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, record_no, code FROM ({MORTON})"


@query
def zorder_first_rows(spark: SparkSession, d: str) -> DataFrame:
    return cloud.zorder_rows(cloud.morton_code(_tiled(spark, d))).where("rank < 50").select("scene_id", "tile", "record_no", "rank")


RANKED = f"SELECT *, row_number() OVER (PARTITION BY scene_id, tile ORDER BY code, record_no) - 1 AS rank, count(*) OVER (PARTITION BY scene_id, tile) AS n FROM ({MORTON})"
O["zorder_first_rows"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, record_no, rank FROM ({RANKED}) WHERE rank < 50"



@query
def zorder_rows(spark: SparkSession, d: str) -> DataFrame:
    return cloud.zorder_rows(cloud.morton_code(_tiled(spark, d))).select("scene_id", "tile", "record_no", "rank")


O["zorder_rows"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, record_no, rank FROM ({RANKED})"

_W = "(1 / (1 + exp(-opacity))) * vol"
#: Rows with their moments about their own centre and their volume; the view's quaternions are no turn.
_OWN = "SELECT *, exp(scale_0 + scale_1 + scale_2) AS vol, exp(2 * scale_0) AS m_xx, 0.0::DOUBLE AS m_xy, 0.0::DOUBLE AS m_xz, exp(2 * scale_1) AS m_yy, 0.0::DOUBLE AS m_yz, exp(2 * scale_2) AS m_zz FROM ({ranked})"
_MERGED = f"""{KD}, m AS (SELECT *, {_W} AS w, {{grp}} AS grp FROM ({_OWN.format(ranked=RANKED)}))
SELECT scene_id, CAST(tile AS INT) AS tile, grp AS record_no, count(*) AS merged, {", ".join(f"round(sum(w * {a}) / sum(w) + 1e-7, 4) AS {a}" for a in AXES)} FROM m GROUP BY scene_id, tile, grp"""


@query
def decimate_uniform(spark: SparkSession, d: str) -> DataFrame:
    return lod.decimate(_tiled(spark, d)).select("scene_id", "tile", "record_no", "merged", *(F.round(F.col(a) + 1e-7, 4).alias(a) for a in AXES))


O["decimate_uniform"] = _MERGED.format(grp="rank * greatest(1, CAST(floor(n * 0.5 + 0.5) AS BIGINT)) // n")


@query
def decimate_adaptive(spark: SparkSession, d: str) -> DataFrame:
    t = _tiled(spark, d)
    n = t.groupBy("scene_id", "tile").agg(F.count("*").alias("before"))
    return lod.decimate(t, 0.5, "adaptive").groupBy("scene_id", "tile").agg(F.count("*").alias("after"), F.sum("merged").alias("merged")).join(n, ["scene_id", "tile"])


O["decimate_adaptive"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, greatest(1, CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT)) AS after, count(*) AS merged, count(*) AS before FROM g GROUP BY ALL"


@query
def adaptive_quotas(spark: SparkSession, d: str) -> DataFrame:
    """How many rows each cell of 64 keeps."""
    return lod.cell_targets(lod._ranked(_tiled(spark, d)), 0.5)


_ERROR = " + ".join(f"greatest(0, sum(w * {c} * {c}) / sum(w) - pow(sum(w * {c}) / sum(w), 2))" for c in (*AXES, "f_dc_0", "f_dc_1", "f_dc_2"))
O["adaptive_quotas"] = f"""{KD},
c AS (SELECT scene_id, CAST(tile AS INT) AS tile, n, rank // 64 AS cell, count(*) AS size, (round({_ERROR}, 6) + 1e-6::DOUBLE) * count(*) AS share FROM (SELECT *, {_W} AS w FROM ({_OWN.format(ranked=RANKED)})) GROUP BY scene_id, tile, n, rank // 64),
t1 AS (SELECT *, greatest(1, floor(n * 0.5::DOUBLE + 0.5)) AS goal, CASE WHEN count(*) OVER t <= greatest(1, floor(n * 0.5::DOUBLE + 0.5)) THEN 1 ELSE 0 END AS least_one FROM c WINDOW t AS (PARTITION BY scene_id, tile)),
t2 AS (SELECT *, goal - sum(least_one) OVER t AS spare, size - least_one AS room, sum(share) OVER t AS shares FROM t1 WINDOW t AS (PARTITION BY scene_id, tile)),
t3 AS (SELECT *, round(least(room, spare * share / shares), 6) AS given FROM t2),
t4 AS (SELECT *, spare - sum(given) OVER t AS rest, sum(room - given) OVER t AS rooms FROM t3 WINDOW t AS (PARTITION BY scene_id, tile)),
t5 AS (SELECT *, round(given + CASE WHEN rooms > 0 THEN rest * (room - given) / rooms ELSE 0 END, 6) AS exact FROM t4),
t6 AS (SELECT *, floor(exact + 1e-9) AS whole FROM t5),
t7 AS (SELECT *, spare - sum(whole) OVER t AS short, row_number() OVER (PARTITION BY scene_id, tile ORDER BY CASE WHEN whole < room THEN round(exact - whole, 6) ELSE -1.0 END DESC, cell) AS r FROM t6 WINDOW t AS (PARTITION BY scene_id, tile))
SELECT scene_id, tile, cell, size, CAST(least_one + whole + CASE WHEN r <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t7"""


def _levels(spark: SparkSession, d: str) -> DataFrame:
    return lod.build_levels(_tiled(spark, d), 3)


@query
def level_counts(spark: SparkSession, d: str) -> DataFrame:
    c = lod.level_counts(_levels(spark, d))
    return c.select("scene_id", "lod", "tile", "n", *(F.round(f"{k}_{a}", 3).alias(f"{k}_{a}") for a in AXES for k in ("min", "max")))


_PAIRS = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
_SUMS = ", ".join(f"sum(w * {c}) / sum(w) AS {c}" for c in (*AXES, "f_dc_0", "f_dc_1", "f_dc_2"))
_MOMENTS = ", ".join(f"sum(w * (m_{a}{b} + {a} * {b})) / sum(w) - (sum(w * {a}) / sum(w)) * (sum(w * {b}) / sum(w)) AS m_{a}{b}" for a, b in _PAIRS)
_STEP = f"""SELECT scene_id, tile, CAST(grp AS BIGINT) AS record_no, {_SUMS}, {_MOMENTS}, sum(w) AS sw, count(*) AS merged, min(opacity) AS own_opacity, min(vol) AS own_vol FROM (
  SELECT *, {_W} AS w, rank * greatest(1, CAST(floor(n * 0.5 + 0.5) AS BIGINT)) // n AS grp FROM ({{rows}})) GROUP BY scene_id, tile, grp"""
_OPAQUE = """SELECT * EXCLUDE (sw, own_opacity, own_vol, det, p), CASE WHEN merged > 1 THEN sqrt(det) ELSE own_vol END AS vol, CASE WHEN merged > 1 THEN ln(p / (1 - p)) ELSE own_opacity END AS opacity FROM (
  SELECT *, least(1 - 1e-6, greatest(1e-6, sw / sqrt(det))) AS p FROM (SELECT *, greatest(1e-36, m_xx * (m_yy * m_zz - m_yz * m_yz) - m_xy * (m_xy * m_zz - m_yz * m_xz) + m_xz * (m_xy * m_yz - m_yy * m_xz)) AS det FROM ({step})))"""


def _rank_sql(source: str) -> str:
    return f"SELECT *, row_number() OVER (PARTITION BY scene_id, tile ORDER BY code, record_no) - 1 AS rank, count(*) OVER (PARTITION BY scene_id, tile) AS n FROM ({_morton_sql(source)})"


_BOUNDS = ", ".join(f"round({k}({a}), 3) AS {k}_{a}" for a in AXES for k in ("min", "max"))
_LEVELS = f"{KD}, lod1 AS ({_OPAQUE.format(step=_STEP.format(rows=_OWN.format(ranked=RANKED)))}), lod2 AS ({_OPAQUE.format(step=_STEP.format(rows=_rank_sql('SELECT * EXCLUDE (merged) FROM lod1')))})"
O["level_counts"] = _LEVELS + " UNION ALL ".join(f" SELECT scene_id, {i} AS lod, CAST(tile AS INT) AS tile, count(*) AS n, {_BOUNDS} FROM {t} GROUP BY scene_id, tile" for i, t in enumerate(("g", "lod1", "lod2")))


@query
def level_totals(spark: SparkSession, d: str) -> DataFrame:
    return lod.level_totals(_levels(spark, d))


O["level_totals"] = _LEVELS + " SELECT scene_id, lod, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT scene_id, {i} AS lod FROM {t}" for i, t in enumerate(("g", "lod1", "lod2"))) + ") GROUP BY GROUPING SETS ((scene_id, lod), (scene_id))"


@query
def tile_filter(spark: SparkSession, d: str) -> DataFrame:
    return cloud.tile_filter(_tiled(spark, d), [0, 2]).select("scene_id", "record_no", "tile")


O["tile_filter"] = f"{KD} SELECT scene_id, record_no, CAST(tile AS INT) AS tile FROM g WHERE tile IN (0, 2)"


@query
def reconcile_tiles(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene_id"))
    return cloud.reconcile_tiles(cloud.repartition_by_tile(_tiled(spark, d)), s.groupBy("scene_id").agg(F.count("*").alias("n")))


O["reconcile_tiles"] = "SELECT l_returnflag AS scene_id, count(*) AS n FROM lineitem GROUP BY 1"


def _leaves(spark: SparkSession, d: str) -> DataFrame:
    leaves = lod.lod_leaves(_levels(spark, d), 8.0, 60)
    leaf = F.format_string("%012.3f/%08d/%08d/%08d", "edge", "cx", "cy", "cz")
    return persisted(leaves.withColumn("leaf", leaf), "leaves")


@query
def lod_leaves(spark: SparkSession, d: str) -> DataFrame:
    """Leaves of the first level (edge, cell, rows), which the other levels' positions do not disturb."""
    leaves = lod.lod_leaves(lod.build_levels(_tiled(spark, d), 1), 8.0, 60)
    return leaves.select("scene_id", "tile", "edge", "cx", "cy", "cz", "n")


def _leaves_sql() -> str:
    parts = ["c0 AS (SELECT scene_id, tile, " + ", ".join(f"CAST(floor({a} / 8) AS BIGINT) AS c{a}" for a in AXES) + ", count(*) AS n FROM g GROUP BY ALL)"]
    for i in range(12):
        up = "0" if i == 11 else "CAST(floor(c{} / 2.0) AS BIGINT)"
        parts.append(f"c{i + 1} AS (SELECT scene_id, tile, {', '.join((f'CAST(0 AS BIGINT)' if i == 11 else up.format(a)) + f' AS c{a}' for a in AXES)}, CAST(sum(n) AS BIGINT) AS n FROM c{i} WHERE n < 60 GROUP BY ALL)")
    body = " UNION ALL ".join(f"SELECT scene_id, CAST(tile AS INT) AS tile, {8.0 * 2**i}::DOUBLE AS edge, cx, cy, cz, n FROM c{i}" + (" WHERE n >= 60" if i < 12 else "") for i in range(13))
    return f"{KD}, {', '.join(parts)} {body}"


O["lod_leaves"] = _leaves_sql()


@query
def pack_units(spark: SparkSession, d: str) -> DataFrame:
    o = load(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("scene_id"), F.lit(0).alias("tile"), F.lit(0).alias("lod"), F.col("o_orderkey").alias("leaf"), (F.col("o_orderkey") % 100 + 1).alias("n"))
    return lod.pack_units(o, 256).select("scene_id", "leaf", "unit", "offset")


O["pack_units"] = """
WITH RECURSIVE h AS (SELECT o_custkey AS s, o_orderkey AS leaf, o_orderkey % 100 + 1 AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
f AS (SELECT s, leaf, n, i, 0 AS unit, CAST(0 AS BIGINT) AS off FROM h WHERE i = 1
  UNION ALL SELECT h.s, h.leaf, h.n, h.i, CASE WHEN f.off + f.n + h.n > 256 THEN f.unit + 1 ELSE f.unit END, CASE WHEN f.off + f.n + h.n > 256 THEN 0 ELSE f.off + f.n END FROM f JOIN h ON h.s = f.s AND h.i = f.i + 1)
SELECT CAST(s AS VARCHAR) AS scene_id, leaf, CAST(unit AS BIGINT) AS unit, off AS offset FROM f"""


@query
def pack_groups(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").groupBy("l_suppkey", "l_partkey").agg(F.count("*").alias("w"))
    return folds.pack_groups(li, ["l_suppkey"], ["l_partkey"], "w", 7).groupBy("l_suppkey", "group_no").agg(F.sum("w").alias("w"), F.count("*").alias("items"))


O["pack_groups"] = """
WITH RECURSIVE k AS (SELECT l_suppkey, l_partkey, count(*) AS w FROM lineitem GROUP BY ALL), h AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS i FROM k),
f AS (SELECT l_suppkey, i, w, CAST(0 AS BIGINT) AS g, w AS t FROM h WHERE i = 1
  UNION ALL SELECT h.l_suppkey, h.i, h.w, CASE WHEN t + h.w > 7 THEN g + 1 ELSE g END, CASE WHEN t + h.w > 7 THEN h.w ELSE t + h.w END FROM f JOIN h ON h.l_suppkey = f.l_suppkey AND h.i = f.i + 1)
SELECT l_suppkey, g AS group_no, CAST(sum(w) AS BIGINT) AS w, count(*) AS items FROM f GROUP BY ALL"""


@query
def renumber_units(spark: SparkSession, d: str) -> DataFrame:
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene_id"), (F.col("l_suppkey") % 5).alias("tile"), (F.col("l_linenumber") % 3).alias("lod"), (F.col("l_partkey") % 7).alias("unit"), F.lit(1).alias("n"))
    return lod.renumber_units(li)


O["renumber_units"] = """
WITH u AS (SELECT l_returnflag AS scene_id, l_suppkey % 5 AS tile, l_linenumber % 3 AS lod, l_partkey % 7 AS unit, count(*) AS rows FROM lineitem GROUP BY ALL)
SELECT *, row_number() OVER (PARTITION BY scene_id, lod ORDER BY tile, unit) - 1 AS unit_no, row_number() OVER (PARTITION BY scene_id ORDER BY tile, lod, unit) - 1 AS file_index FROM u"""


@query
def leaf_references(spark: SparkSession, d: str) -> DataFrame:
    """Leaves by line item with the numbers of their units, whose tile-local names are parsed."""
    li = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene_id"), (F.col("l_suppkey") % 5).alias("tile"), F.concat_ws("_", F.col("l_linenumber") % 3, F.col("l_partkey") % 7).alias("name"), F.lit(1).alias("n"))
    units = lod.parse_units(li.groupBy("scene_id", "tile", "name").agg(F.sum("n").alias("n")))
    leaves = li.withColumn("lod", F.split("name", "_")[0].cast("int")).withColumn("unit", F.split("name", "_")[1].cast("int"))
    found = lod.reference_units(leaves, lod.renumber_units(units))
    return found.groupBy("scene_id", "lod", "unit_no", "file_index").agg(F.sum("n").alias("n"))


O["leaf_references"] = """
WITH u AS (SELECT l_returnflag AS scene_id, l_suppkey % 5 AS tile, CAST(l_linenumber % 3 AS INT) AS lod, l_partkey % 7 AS unit, count(*) AS n FROM lineitem GROUP BY ALL)
SELECT scene_id, lod, row_number() OVER (PARTITION BY scene_id, lod ORDER BY tile, unit) - 1 AS unit_no, row_number() OVER (PARTITION BY scene_id ORDER BY tile, lod, unit) - 1 AS file_index, n FROM u"""


@query
def scene_manifest(spark: SparkSession, d: str) -> DataFrame:
    """Manifests of two levels, read back from their JSON: counts, numbers of files and leaves, sums over the leaves, root bounds."""
    s = splats(spark, d)
    nodes = _nodes(s)
    levels = lod.build_levels(cloud.assign_tile(s, nodes), 2)
    leaves = lod.lod_leaves(levels, 8.0, 60).withColumn("leaf", F.format_string("%012.3f/%08d/%08d/%08d", "edge", "cx", "cy", "cz"))
    packed = persisted(lod.pack_units(leaves, 1_000), "packed")
    units = lod.renumber_units(packed)
    made = lod.scene_manifest(lod.reference_units(packed, units), units, nodes)
    counts = F.from_json(F.get_json_object("manifest", "$.counts"), "array<long>")
    held = F.aggregate(F.regexp_extract_all("manifest", F.lit('"offset":[0-9]+,"count":([0-9]+)'), 1), F.lit(0).cast("long"), lambda a, b: a + b.cast("long"))
    root = [F.get_json_object("manifest", f"$.tree.bound.{k}[{i}]").cast("double").alias(f"{k}_{a}") for i, a in enumerate(AXES) for k in ("min", "max")]
    files = F.size(F.from_json(F.get_json_object("manifest", "$.filenames"), "array<string>")).cast("long").alias("files")
    facts = made.select("scene_id", F.get_json_object("manifest", "$.count").cast("long").alias("n"), F.array_join(counts.cast("array<string>"), ",").alias("counts"), held.alias("held"), files, *root)
    listed = units.groupBy("scene_id").agg(F.count("*").alias("units"))
    return facts.join(listed, "scene_id").select("*", (F.col("files") == F.col("units")).alias("all_files")).drop("files", "units")


O["scene_manifest"] = f"""{_LEVELS} SELECT scene_id, n0 + n1 AS n, n0 || ',' || n1 AS counts, n0 + n1 AS held, true AS all_files, {", ".join(f"CASE WHEN {k}_{a} = 0 THEN 0 ELSE round({k}_{a}, 6 - CAST(floor(log10(abs(CASE WHEN {k}_{a} = 0 THEN 1 ELSE {k}_{a} END))) AS INT)) END AS {k}_{a}" for a in AXES for k in ("min", "max"))}
FROM (SELECT scene_id, count(*) AS n0, {", ".join(f"{k}({a}) AS {k}_{a}" for a in AXES for k in ("min", "max"))} FROM g GROUP BY 1) JOIN (SELECT scene_id, count(*) AS n1 FROM lod1 GROUP BY 1) USING (scene_id)"""


@query
def rollup_bounds(spark: SparkSession, d: str) -> DataFrame:
    s = splats(spark, d)
    nodes = _nodes(s)
    tiles = lod.level_counts(cloud.assign_tile(s, nodes).withColumn("lod", F.lit(0)))
    return lod.rollup_bounds(tiles, nodes)


O["rollup_bounds"] = f"""{KD},
b AS (SELECT scene_id, path, count(*) AS n, {", ".join(f"{k}({a}) AS {k}_{a}" for a in AXES for k in ("min", "max"))} FROM g GROUP BY ALL),
e AS (SELECT *, unnest(range(0, length(path) + 1)) AS depth FROM b)
SELECT scene_id, substr(path, 1, depth) AS node, CAST(sum(n) AS BIGINT) AS n, max(depth = length(path)) AS leaf, {", ".join(f"{k}({k}_{a}) AS {k}_{a}" for a in AXES for k in ("min", "max"))}
FROM e GROUP BY 1, 2 HAVING max(depth = length(path)) OR count(DISTINCT substr(path, depth + 1, 1)) = 2"""


@query
def quantize_positions(spark: SparkSession, d: str) -> DataFrame:
    return lod.quantize(splats(spark, d), ["scene_id"]).select("scene_id", "record_no", *(f"{a}_{k}" for a in AXES for k in ("low", "high")))


_LOGS = ", ".join(f"sign({a}) * ln(1 + abs({a})) AS l{a}" for a in AXES)
_STEPS = ", ".join(f"CAST(floor((l{a} - min(l{a}) OVER w) / (max(l{a}) OVER w - min(l{a}) OVER w) * 65535 + 0.5) AS INT) AS q{a}" for a in AXES)
O["quantize_positions"] = f"""SELECT scene_id, record_no, {", ".join(f"q{a} & 255 AS {a}_low, q{a} >> 8 AS {a}_high" for a in AXES)}
FROM (SELECT scene_id, record_no, {_STEPS} FROM (SELECT *, {_LOGS} FROM ({SPLAT_SQL})) WINDOW w AS (PARTITION BY scene_id))"""


@query
def dequantize_error(spark: SparkSession, d: str) -> DataFrame:
    return lod.quality(lod.dequantize(lod.quantize(splats(spark, d), ["scene_id"]))).select("scene_id", _r("rmse", 5), _r("span", 3), _r("psnr", 2))


_BACK = ", ".join(f"lo{a} + q{a} / 65535::DOUBLE * (hi{a} - lo{a}) AS back_{a}" for a in AXES)
_ENDS = ", ".join(f"min(l{a}) OVER w AS lo{a}, max(l{a}) OVER w AS hi{a}" for a in AXES)
O["dequantize_error"] = f"""
WITH q AS (SELECT *, {_STEPS}, {_ENDS} FROM (SELECT *, {_LOGS} FROM ({SPLAT_SQL})) WINDOW w AS (PARTITION BY scene_id)), b AS (SELECT *, {_BACK} FROM q),
e AS (SELECT scene_id, sqrt(avg({" + ".join(f"pow(sign(back_{a}) * (exp(abs(back_{a})) - 1) - {a}, 2)" for a in AXES)})) AS rmse, greatest({", ".join(f"max({a}) - min({a})" for a in AXES)}) AS span FROM b GROUP BY 1)
SELECT scene_id, round(rmse, 5) AS rmse, round(span, 3) AS span, round(20 * log10(span / rmse), 2) AS psnr FROM e"""


@query
def quantize_attributes(spark: SparkSession, d: str) -> DataFrame:
    """Bytes of attributes and of turned quaternions, and how far the inverse is off in steps."""
    turned = cloud.transform_splats(splats(spark, d), _turns(spark, d))
    back = lod.dequantize_attributes(lod.quantize_attributes(turned, ["scene_id"]))
    off = F.greatest(*(F.abs(F.col(f"d_{c}") - F.col(c)) for c in ("scale_0", "scale_2", "f_dc_0", "f_dc_2")))
    dot = F.abs(sum((F.col(f"d_rot_{i}") * F.col(f"rot_{i}") for i in range(4)), F.lit(0.0)))
    return back.select("scene_id", "record_no", "b_scale_0", "b_f_dc_2", "b_rot_at", *(f"b_rot_{i}" for i in range(3)), (off < 0.01).alias("near"), (dot > 0.999).alias("same_turn"))


_BYTE_OF = "CAST(floor(({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) * 255 + 0.5) AS INT)"
def _turns(spark: SparkSession, d: str) -> DataFrame:
    s = load(spark, d, "lineitem").select(F.col("l_returnflag").alias("scene_id")).distinct()
    angle = F.ascii("scene_id") % 7 * 15.0
    return s.select("scene_id", F.array(angle, F.lit(30.0), F.when(F.col("scene_id") == "N", float("nan")).otherwise(-20.0)).alias("rotation"), F.array(F.lit(1.0), F.lit(-2.0), F.lit(0.5)).alias("translation"))


@query
def transform_positions(spark: SparkSession, d: str) -> DataFrame:
    return cloud.transform_splats(splats(spark, d), _turns(spark, d)).select("scene_id", "record_no", *(_r(a, 5) for a in AXES), *(_r(f"rot_{i}", 5) for i in range(4)))


_TURNED = f"""
a AS (SELECT *, radians(ascii(scene_id) % 7 * 15.0::DOUBLE) / 2 AS hx, radians(30.0::DOUBLE) / 2 AS hy, radians(CASE WHEN scene_id = 'N' THEN 0.0::DOUBLE ELSE -20.0::DOUBLE END) / 2 AS hz FROM ({SPLAT_SQL})),
q AS (SELECT *, sin(hx) * cos(hy) * cos(hz) - cos(hx) * sin(hy) * sin(hz) AS qx, cos(hx) * sin(hy) * cos(hz) + sin(hx) * cos(hy) * sin(hz) AS qy,
             cos(hx) * cos(hy) * sin(hz) - sin(hx) * sin(hy) * cos(hz) AS qz, cos(hx) * cos(hy) * cos(hz) + sin(hx) * sin(hy) * sin(hz) AS qw FROM a),
t AS (SELECT scene_id, record_no, -qz AS rot_0, qy AS rot_1, -qx AS rot_2, qw AS rot_3,
   -(1 - 2 * (qy * qy + qz * qz)) * x - 2 * (qx * qy - qz * qw) * y + 2 * (qx * qz + qy * qw) * z AS x,
   -2 * (qx * qy + qz * qw) * x - (1 - 2 * (qx * qx + qz * qz)) * y + 2 * (qy * qz - qx * qw) * z AS y,
   -2 * (qx * qz - qy * qw) * x - 2 * (qy * qz + qx * qw) * y + (1 - 2 * (qx * qx + qy * qy)) * z AS z FROM q)"""
O["transform_positions"] = f"WITH {_TURNED} SELECT scene_id, record_no, round(x + 1, 5) AS x, round(y - 2, 5) AS y, round(z + 0.5, 5) AS z, {', '.join(f'round(rot_{i}, 5) AS rot_{i}' for i in range(4))} FROM t"


_TURN = "[-qz, qy, -qx, qw]"
_SMALL = f"list_filter(range(1, 5), lambda i: i <> arg)"
O["quantize_attributes"] = f"""WITH {_TURNED}, b AS (SELECT scene_id, record_no, {_BYTE_OF.format(c="scale_0")} AS b_scale_0, {_BYTE_OF.format(c="f_dc_2")} AS b_f_dc_2, {_TURN} AS r,
  list_position(list_transform({_TURN}, lambda v: abs(v)), list_max(list_transform({_TURN}, lambda v: abs(v)))) AS arg FROM q WINDOW w AS (PARTITION BY scene_id))
SELECT scene_id, record_no, b_scale_0, b_f_dc_2, CAST(arg - 1 AS INT) AS b_rot_at, true AS near, true AS same_turn,
{", ".join(f"CAST(floor((r[({_SMALL})[{i + 1}]] * sign(r[arg]) * sqrt(2) + 1) / 2 * 255 + 0.5) AS INT) AS b_rot_{i}" for i in range(3))} FROM b"""


@query
def covariance3(spark: SparkSession, d: str) -> DataFrame:
    c = cloud.covariance3(unnumbered_splats(spark, d))
    return c.select("scene_id", "n", *(F.round(x, 2).alias(x) for x in c.columns[2:]))


_E = {"x": "(-x)", "y": "(-y)", "z": "z"}
O["covariance3"] = f"SELECT scene_id, count(*) AS n, {', '.join(f'round(avg({_E[a]}), 2) AS mean_{a}' for a in AXES)}, {', '.join(f'round(covar_pop({_E[a]}, {_E[b]}) * count(*), 2) AS c_{a}{b}' for a, b in ('xx', 'xy', 'xz', 'yy', 'yz', 'zz'))} FROM ({SPLAT_SQL}) GROUP BY 1"


@query
def quantile_at(spark: SparkSession, d: str) -> DataFrame:
    found = cloud.quantiles(splats(spark, d), {"x": [0.98], "z": [0.5]})
    return found.select("scene_id", "value", F.col("column").alias("axis"))


def _quantile_sql(source: str, column: str, q: float) -> str:
    return f"SELECT scene_id, {column} AS value FROM (SELECT scene_id, {column}, row_number() OVER (PARTITION BY scene_id ORDER BY {column}) AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM ({source})) WHERE r = CAST(floor({q}::DOUBLE * (n - 1)) AS BIGINT) + 1"


O["quantile_at"] = f"SELECT *, 'x' AS axis FROM ({_quantile_sql(SPLAT_SQL, 'x', 0.98)}) UNION ALL SELECT *, 'z' AS axis FROM ({_quantile_sql(SPLAT_SQL, 'z', 0.5)})"


@query
def histogram_peak(spark: SparkSession, d: str) -> DataFrame:
    return cloud.histogram_peak(splats(spark, d), "x").select("scene_id", "peak", "left", "right")


O["histogram_peak"] = f"""
WITH e AS (SELECT a.scene_id, a.value AS lo, (b.value - a.value) / 200 AS w FROM ({_quantile_sql(SPLAT_SQL, "x", 0.005)}) a JOIN ({_quantile_sql(SPLAT_SQL, "x", 0.995)}) b USING (scene_id)),
h AS (SELECT s.scene_id, CAST(floor((x - lo) / w) AS BIGINT) AS bin, count(*) AS h FROM ({SPLAT_SQL}) s JOIN e USING (scene_id) GROUP BY ALL),
g AS (SELECT scene_id, unnest(range(0, 200)) AS bin FROM e),
m AS (SELECT g.scene_id, g.bin, avg(coalesce(h, 0)) OVER (PARTITION BY g.scene_id ORDER BY g.bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM g LEFT JOIN h ON h.scene_id = g.scene_id AND h.bin = g.bin),
p AS (SELECT scene_id, bin AS peak, s AS height FROM (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY s DESC, bin) AS r FROM m) WHERE r = 1)
SELECT m.scene_id, peak, coalesce(max(bin) FILTER (s <= 0.1 * height AND bin < peak), 0) AS left, coalesce(min(bin) FILTER (s <= 0.1 * height AND bin > peak), 199) AS right FROM m JOIN p USING (scene_id) GROUP BY m.scene_id, peak"""


@query
def centre_translation(spark: SparkSession, d: str) -> DataFrame:
    return cloud.centre_translation(splats(spark, d), _turns(spark, d))


O["centre_translation"] = f"WITH {_TURNED}" + " SELECT scene_id, " + ", ".join(f"floor(-t{a}.value * 1000 + 0.5) / 1000 AS t{a}" for a in AXES) + f" FROM ({_quantile_sql('SELECT * FROM t', 'x', 0.5)}) tx JOIN ({_quantile_sql('SELECT * FROM t', 'y', 0.01)}) ty USING (scene_id) JOIN ({_quantile_sql('SELECT * FROM t', 'z', 0.5)}) tz USING (scene_id)"


def _orientation(sample: DataFrame) -> DataFrame:
    return cloud.auto_orient(sample).select("scene_id", "up_axis", "confident", *(F.get("euler", i).alias(f"turn_{a}") for i, a in enumerate(AXES)))


@query
def auto_orient(spark: SparkSession, d: str) -> DataFrame:
    return _orientation(cloud.block_sample(splats(spark, d), 64, 256))


def _orient_sql(rows: str) -> str:
    """Orientation of rows (scene_id, x, y, z): the least eigenvalue in closed form, its direction as the longest cross product of
    two rows of the shifted matrix, tails by quantile and slopes by smoothed histogram on that axis."""
    quantile = lambda q: f"max(v) FILTER (r = CAST(floor({q}::DOUBLE * (n - 1)) AS BIGINT) + 1)"
    cross = lambda i, j: f"[r{i}[2] * r{j}[3] - r{i}[3] * r{j}[2], r{i}[3] * r{j}[1] - r{i}[1] * r{j}[3], r{i}[1] * r{j}[2] - r{i}[2] * r{j}[1]]"
    size = lambda v: f"({v}[1] * {v}[1] + {v}[2] * {v}[2] + {v}[3] * {v}[3])"
    moments = ", ".join(f"covar_pop({a}, {b}) * count(*) AS {n}" for n, a, b in (("a", "-x", "-x"), ("b", "-x", "-y"), ("c", "-x", "z"), ("d", "-y", "-y"), ("e", "-y", "z"), ("f", "z", "z")))
    return f"""
WITH p AS ({rows}),
m AS (SELECT scene_id, count(*) AS n, {moments} FROM p GROUP BY scene_id),
m1 AS (SELECT *, (a + d + f) / 3 AS q FROM m),
m2 AS (SELECT *, sqrt(((a - q) * (a - q) + (d - q) * (d - q) + (f - q) * (f - q) + 2 * (b * b + c * c + e * e)) / 6) AS s FROM m1),
m3 AS (SELECT *, acos(greatest(-1, least(1, ((a - q) * ((d - q) * (f - q) - e * e) - b * (b * (f - q) - c * e) + c * (b * e - c * (d - q))) / (2 * s * s * s)))) / 3 AS turn FROM m2),
m4 AS (SELECT *, q + 2 * s * cos(turn + 2 * pi() / 3) AS low, q + 2 * s * cos(turn) AS high FROM m3),
m5 AS (SELECT *, 3 * q - low - high AS middle, [a - low, b, c] AS r1, [b, d - low, e] AS r2, [c, e, f - low] AS r3 FROM m4),
m6 AS (SELECT *, {cross(1, 2)} AS c1, {cross(1, 3)} AS c2, {cross(2, 3)} AS c3 FROM m5),
m7 AS (SELECT *, CASE WHEN {size("c1")} >= {size("c2")} AND {size("c1")} >= {size("c3")} THEN c1 WHEN {size("c2")} >= {size("c3")} THEN c2 ELSE c3 END AS way FROM m6),
m8 AS (SELECT *, list_transform(way, lambda v: abs(v) / sqrt({size("way")})) AS share FROM m7),
thin AS (SELECT *, list_position(share, list_max(share)) - 1 AS axis, greatest(low, 0) < {cloud.THIN}::DOUBLE * {cloud.THIN}::DOUBLE * greatest(middle, 1e-12) AND list_max(share) > {cloud.ALIGNED} AS lies FROM m8),
v AS (SELECT scene_id, CASE axis WHEN 0 THEN -x WHEN 1 THEN -y ELSE z END AS v FROM p JOIN thin USING (scene_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY scene_id ORDER BY v) AS r, count(*) OVER (PARTITION BY scene_id) AS n FROM v),
t AS (SELECT scene_id, {quantile(0.98)} + {quantile(0.02)} - 2 * {quantile(0.5)} AS tail, {quantile(0.005)} AS lo, {quantile(0.995)} AS hi FROM o GROUP BY scene_id),
w AS (SELECT *, CASE WHEN hi > lo THEN (hi - lo) / 200 ELSE 1.0::DOUBLE END AS w FROM t),
h AS (SELECT scene_id, CAST(floor((v - lo) / w) AS BIGINT) AS bin, count(*) AS h FROM v JOIN w USING (scene_id) GROUP BY ALL),
g AS (SELECT scene_id, unnest(range(0, 200)) AS bin FROM w),
k AS (SELECT g.scene_id, g.bin, avg(coalesce(h, 0)) OVER (PARTITION BY g.scene_id ORDER BY g.bin ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS s FROM g LEFT JOIN h ON h.scene_id = g.scene_id AND h.bin = g.bin),
top AS (SELECT scene_id, bin AS peak, s AS height FROM k QUALIFY row_number() OVER (PARTITION BY scene_id ORDER BY s DESC, bin) = 1),
fall AS (SELECT k.scene_id, coalesce(max(bin) FILTER (s <= 0.1 * height AND bin < peak), 0) + coalesce(min(bin) FILTER (s <= 0.1 * height AND bin > peak), 199) - 2 * any_value(peak) AS fall FROM k JOIN top USING (scene_id) GROUP BY k.scene_id),
u AS (SELECT scene_id, thin.n < {cloud.ENOUGH} AS few, axis, lies, tail >= 0 AS up, fall > 0 AS slow FROM thin JOIN w USING (scene_id) JOIN fall USING (scene_id))
SELECT scene_id, CASE WHEN few THEN '?' ELSE (CASE WHEN up = (axis = 2) THEN '+' ELSE '-' END) || substr('XYZ', axis + 1, 1) END AS up_axis,
    NOT few AND lies AND up = slow AS confident,
    CASE WHEN few THEN 0.0::DOUBLE WHEN axis = 1 AND NOT up THEN 180.0::DOUBLE WHEN axis = 2 THEN (CASE WHEN up THEN -90.0 ELSE 90.0 END)::DOUBLE ELSE 0.0::DOUBLE END AS turn_x,
    0.0::DOUBLE AS turn_y, CASE WHEN few OR axis > 0 THEN 0.0 WHEN up THEN 90.0 ELSE -90.0 END::DOUBLE AS turn_z
FROM u"""


O["auto_orient"] = _orient_sql(SAMPLE)

# Six placements of a cloud: which of its axes lies where, the last three mirrored; and one whose thin axis is tilted.
_PLACED = ("x, y, z", "y, z, x", "z, x, y", "-x, -y, -z", "-y, -z, -x", "-z, -x, -y", "x, y + z / 25, z / 25 - y")
_PLACED_SQL = " UNION ALL ".join(
    f"SELECT concat(s_nation, '/{k}') AS scene_id, {', '.join(f'{v} AS {a}' for v, a in zip(place.split(', '), AXES, strict=True))} FROM rows WHERE part = {k}" for k, place in enumerate(_PLACED)
)


@query
def auto_orient_placed(spark: SparkSession, d: str) -> DataFrame:
    """A cloud per nation of suppliers and placement, thin where quantities are squared and shrunk, in every direction and tilted; few have too few rows."""
    s = load(spark, d, "supplier").select(F.col("s_suppkey").alias("suppkey"), F.concat(F.lit("n"), F.col("s_nationkey").cast("string")).alias("s_nation"))
    rows = load(spark, d, "lineitem").join(s, F.col("l_suppkey") == F.col("suppkey"))
    thin = F.col("l_quantity") * F.col("l_quantity") / 100
    rows = rows.select("s_nation", (F.col("l_orderkey") % 7).alias("part"), (F.col("l_extendedprice") / 1000).alias("x"), thin.alias("y"), (F.col("l_partkey") % 1000).cast("double").alias("z"))
    return _orientation(spark.sql(_PLACED_SQL.replace("FROM rows", "FROM {rows}"), rows=rows))


O["auto_orient_placed"] = _orient_sql(
    "WITH rows AS (SELECT concat('n', s_nationkey) AS s_nation, l_orderkey % 7 AS part, l_extendedprice / 1000 AS x, l_quantity * l_quantity / 100 AS y, (l_partkey % 1000)::DOUBLE AS z FROM lineitem JOIN supplier ON l_suppkey = s_suppkey) " + _PLACED_SQL
)


def _moment_means(df: DataFrame) -> DataFrame:
    """Means over a tile of the moments that scales and turn stand for."""
    held = df.withColumns(dict(zip(lod.MOMENTS, lod.covariance(df), strict=True)))
    return held.groupBy("scene_id", "tile").agg(F.count("*").alias("n"), *(F.round(F.avg(m), 4).alias(m) for m in lod.MOMENTS))


@query
def merge_moments(spark: SparkSession, d: str) -> DataFrame:
    """What the scales and turns of a merged level stand for, against the moments of the rows that were merged."""
    return _moment_means(lod.decimate(_tiled(spark, d)))


O["merge_moments"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, count(*) AS n, " + ", ".join(f"round(avg(m_{a}{b}), 4) AS m_{a}{b}" for a, b in _PAIRS) + f" FROM ({_STEP.format(rows=_OWN.format(ranked=RANKED))}) GROUP BY scene_id, tile"


@query
def rotate_sh(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients under a half turn about z, which flips some; under any turn each band keeps its size."""
    e = load(spark, d, "embeddings").select("vec_id", F.slice("embedding", 1, 45).alias("f_rest"))
    turned = lambda x, y, z: cloud.rotate_sh(F.col("f_rest").cast("array<float>"), F.array(*(v for row in cloud.view_matrix(F.lit(x), F.lit(y), F.lit(z)) for v in row)))
    out = e.select("vec_id", turned(0.0, 0.0, 0.0).alias("half"), turned(25.0, -70.0, 130.0).alias("any"))
    size = lambda lo, n: F.round(F.aggregate(F.slice("any", lo + 1, n), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")), 3)
    return out.select("vec_id", *(F.round(F.get("half", i).cast("double") + 0.0, 4).alias(f"h{i}") for i in _SH_SEEN), *(size(15 * c + lo, n).alias(f"s{c}_{lo}") for c in range(3) for lo, n in _SH_BANDS))


_SH_SEEN, _SH_BANDS = (0, 1, 2, 3, 4, 7, 8, 9, 14, 15, 31, 44), ((0, 3), (3, 5), (8, 7))
#: Coefficients of a channel that a half turn about z flips: functions odd in x and y together.
_SH_FLIPPED = {0, 2, 4, 6, 8, 10, 12, 14}
O["rotate_sh"] = (
    "SELECT vec_id, " + ", ".join(f"round({'-' if i % 15 in _SH_FLIPPED else ''}embedding[{i + 1}]::DOUBLE + 0.0, 4) AS h{i}" for i in _SH_SEEN)
    + ", " + ", ".join(f"round(list_sum(list_transform(embedding[{15 * c + lo + 1}:{15 * c + lo + n}], lambda v: v::DOUBLE * v::DOUBLE)), 3) AS s{c}_{lo}" for c in range(3) for lo, n in _SH_BANDS) + " FROM embeddings"
)


@query
def kmeans_step(spark: SparkSession, d: str) -> DataFrame:
    labels, _ = lod.kmeans_palette(load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 8, 0, "vec_id")
    return labels.groupBy("label").agg(F.count("*").alias("n"), F.min("vec_id").alias("first"))


O["kmeans_step"] = """
WITH c AS (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS lab, embedding::DOUBLE[] AS c FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 8)),
d AS (SELECT vec_id, lab, list_sum(list_transform(list_zip(embedding::DOUBLE[], c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM embeddings, c)
SELECT CAST(label AS INT) AS label, count(*) AS n, min(vec_id) AS first FROM (SELECT vec_id, arg_min(lab, (d, lab)) AS label FROM d GROUP BY 1) GROUP BY 1"""


@query
def kmeans_palette(spark: SparkSession, d: str) -> DataFrame:
    return lod.kmeans_palette(load(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v")), "v", 8, 5, "vec_id")[1].select("label", "n", F.round(F.get("v", 0), 5).alias("first"))


def _palette_sql(rows: str, k: int, steps: int) -> str:
    """Lloyd's steps by unit: e (rows), c<i> (centres), l<i> (labels)."""
    parts = [f"e AS ({rows})", f"c0 AS (SELECT u, row_number() OVER (PARTITION BY u ORDER BY vec_id) - 1 AS lab, v AS c FROM e QUALIFY lab < {k})"]
    for i in range(steps + 1):
        parts.append(f"l{i} AS MATERIALIZED (SELECT u, vec_id, any_value(v) AS v, arg_min(lab, (d, lab)) AS lab FROM (SELECT e.u, vec_id, v, lab, list_sum(list_transform(list_zip(v, c), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM e JOIN c{i} ON e.u = c{i}.u) GROUP BY u, vec_id)")
        if i < steps:
            parts.append(f"m{i} AS (SELECT u, lab, list(a ORDER BY j) AS c FROM (SELECT u, lab, j, avg(x) AS a FROM (SELECT u, lab, unnest(v) AS x, unnest(range(len(v))) AS j FROM l{i}) GROUP BY ALL) GROUP BY u, lab)")
            parts.append(f"c{i + 1} AS MATERIALIZED (SELECT o.u, o.lab, coalesce(m.c, o.c) AS c FROM c{i} o LEFT JOIN m{i} m ON o.u = m.u AND o.lab = m.lab)")
    return "WITH " + ", ".join(parts) + f" SELECT c.u AS unit, CAST(c.lab AS INT) AS label, count(l.vec_id) AS n, round(any_value(c.c)[1], 5) AS first FROM c{steps} c LEFT JOIN l{steps} l ON c.u = l.u AND c.lab = l.lab GROUP BY c.u, c.lab"


O["kmeans_palette"] = f"SELECT label, n, first FROM ({_palette_sql('SELECT 0 AS u, vec_id, embedding::DOUBLE[] AS v FROM embeddings', 8, 5)})"


@query
def unit_palettes(spark: SparkSession, d: str) -> DataFrame:
    e = load(spark, d, "embeddings").select("vec_id", (F.col("vec_id") % 3).cast("int").alias("unit"), F.col("embedding").cast("array<double>").alias("v"))
    return lod.unit_palettes(e, ["unit"], "v", 6, 3, "vec_id")[1].select("unit", "label", "n", F.round(F.get("v", 0), 5).alias("first"))


O["unit_palettes"] = _palette_sql("SELECT CAST(vec_id % 3 AS INT) AS u, vec_id, embedding::DOUBLE[] AS v FROM embeddings", 6, 3)


def _manifest(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    """A manifest of line items (scene: return flag, level: from the line number), and faults in each scene."""
    li = load(spark, d, "lineitem").withColumn("lod", (F.col("l_linenumber") - 1) % 3)
    file = F.format_string("%d_%d", "lod", F.col("l_suppkey") % 3)
    leaves = li.groupBy(F.col("l_returnflag").alias("scene_id"), "lod", file.alias("file"), (F.col("l_partkey") % 11).alias("leaf")).agg((F.count("*") * F.pow(F.lit(4), 2 - F.col("lod"))).cast("long").alias("n"))
    from pyspark.sql import Window

    offset = F.sum("n").over(Window.partitionBy("scene_id", "file").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    leaves = persisted(leaves.withColumn("offset", offset), "manifest")
    units = leaves.groupBy("scene_id", "file").agg(F.sum("n").alias("rows")).withColumn("files", F.array(F.lit("meta.json"), F.lit("means_l.webp")))
    entries = units.select("scene_id", F.explode(F.transform("files", lambda f: F.concat("file", F.lit("/"), f))).alias("name"), F.col("rows").alias("size"))
    entries = entries.unionByName(units.select("scene_id").distinct().select("scene_id", F.lit("lod-meta.json").alias("name"), F.lit(1).cast("long").alias("size")))
    counts = leaves.groupBy("scene_id", "lod").agg(F.sum("n").alias("n")).groupBy("scene_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("lod", "n"))), lambda x: x["n"]).alias("counts"))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    manifest = counts.select("scene_id", F.lit(1).alias("version"), total.alias("count"), "counts", F.size("counts").alias("lod_levels"))
    # faults
    entries = entries.where("NOT (scene_id = 'A' AND name = '0_1/meta.json')").unionByName(entries.where("scene_id = 'N' AND name = 'lod-meta.json'").withColumn("name", F.lit("stray.txt")))
    units = units.withColumn("rows", F.when((F.col("scene_id") == "R") & (F.col("file") == "1_2"), F.col("rows") + 1).otherwise(F.col("rows"))).where("NOT (scene_id = 'A' AND file = '2_0')")
    leaves = leaves.withColumn("offset", F.when((F.col("scene_id") == "N") & (F.col("file") == "2_1") & (F.col("leaf") == 5), F.col("offset") + 3).otherwise(F.col("offset")))
    manifest = manifest.withColumn("version", F.when(F.col("scene_id") == "R", 2).otherwise(1)).withColumn("count", F.when(F.col("scene_id") == "A", F.col("count") - 1).otherwise(F.col("count")))
    return manifest, leaves, units, entries


@query
def audit_rules(spark: SparkSession, d: str) -> DataFrame:
    return audit.audit_manifest(*_manifest(spark, d)).select("scene_id", "level", "rule", "subject")


_FILES = "meta\\.json|means_[lu]\\.webp|scales\\.webp|quats\\.webp|sh0\\.webp|shN_(centroids|labels)\\.webp"
O["audit_rules"] = f"""
WITH i AS (SELECT l_returnflag AS scene_id, (l_linenumber - 1) % 3 AS lod, l_suppkey % 3 AS f, l_partkey % 11 AS leaf FROM lineitem),
l0 AS (SELECT scene_id, lod, lod || '_' || f AS file, leaf, CAST(count(*) * pow(4, 2 - lod) AS BIGINT) AS n FROM i GROUP BY scene_id, lod, f, leaf),
l1 AS (SELECT *, sum(n) OVER (PARTITION BY scene_id, file ORDER BY leaf) - n AS pos FROM l0),
u0 AS (SELECT scene_id, file, sum(n) AS rows FROM l1 GROUP BY ALL),
e0 AS (SELECT scene_id, file || '/' || part AS name, rows AS size FROM u0, (VALUES ('meta.json'), ('means_l.webp')) AS p(part) UNION ALL SELECT DISTINCT scene_id, 'lod-meta.json', 1 FROM u0),
c AS (SELECT scene_id, lod, sum(n) AS n FROM l1 GROUP BY ALL),
e AS (SELECT * FROM e0 WHERE NOT (scene_id = 'A' AND name = '0_1/meta.json') UNION ALL SELECT scene_id, 'stray.txt', size FROM e0 WHERE scene_id = 'N' AND name = 'lod-meta.json'),
u AS (SELECT scene_id, file, rows + CASE WHEN scene_id = 'R' AND file = '1_2' THEN 1 ELSE 0 END AS rows FROM u0 WHERE NOT (scene_id = 'A' AND file = '2_0')),
l AS (SELECT * REPLACE (pos + CASE WHEN scene_id = 'N' AND file = '2_1' AND leaf = 5 THEN 3 ELSE 0 END AS pos) FROM l1),
m AS (SELECT scene_id, CASE WHEN scene_id = 'R' THEN 2 ELSE 1 END AS version, sum(n) - CASE WHEN scene_id = 'A' THEN 1 ELSE 0 END AS total, sum(n) AS levels_total FROM c GROUP BY scene_id)
SELECT scene_id, 'error' AS level, 'V1' AS rule, name AS subject FROM e WHERE NOT regexp_full_match(name, 'lod-meta\\.json|[^/]+/({_FILES})')
UNION ALL SELECT scene_id, 'error', 'V2', 'lod-meta.json' FROM m WHERE scene_id NOT IN (SELECT scene_id FROM e WHERE name = 'lod-meta.json')
UNION ALL SELECT scene_id, 'error', 'V3', 'version' FROM m WHERE version <> 1
UNION ALL SELECT scene_id, 'error', 'V5', 'count' FROM m WHERE total <> levels_total
UNION ALL SELECT scene_id, 'error', 'V7', CAST(lod AS VARCHAR) FROM c QUALIFY n >= lag(n) OVER (PARTITION BY scene_id ORDER BY lod)
UNION ALL SELECT scene_id, 'error', 'V9', CAST(lod AS VARCHAR) FROM c JOIN (SELECT scene_id, lod, sum(n) AS have FROM l GROUP BY ALL) USING (scene_id, lod) WHERE n <> have
UNION ALL SELECT DISTINCT scene_id, 'error', 'V10', file FROM l ANTI JOIN u USING (scene_id, file)
UNION ALL SELECT scene_id, 'error', 'V11', name FROM (SELECT scene_id, file || '/' || part AS name FROM u, (VALUES ('meta.json'), ('means_l.webp')) AS p(part)) ANTI JOIN e USING (scene_id, name)
UNION ALL SELECT DISTINCT scene_id, 'error', 'V12', file FROM (SELECT *, sum(n) OVER (PARTITION BY scene_id, file ORDER BY pos, n ROWS UNBOUNDED PRECEDING) - n AS due FROM l) WHERE pos <> due
UNION ALL SELECT scene_id, 'error', 'V13', file FROM u JOIN (SELECT scene_id, file, sum(n) AS n FROM l GROUP BY ALL) USING (scene_id, file) WHERE rows <> n
UNION ALL SELECT scene_id, 'warning', 'V14', 'size' FROM e GROUP BY scene_id HAVING sum(size) > 10737418240
UNION ALL SELECT scene_id, 'error', 'V15', name FROM e GROUP BY scene_id, name HAVING count(*) > 1"""


@query
def audit_single_level(spark: SparkSession, d: str) -> DataFrame:
    """Scenes of one level (an error from a million rows on), and scenes whose second level is no smaller than the first."""
    c = load(spark, d, "orders").groupBy(F.col("o_custkey").alias("scene_id")).agg((F.sum("o_orderkey") * 100).alias("n"))
    two = F.col("scene_id") % 3 == 0
    counts = F.when(two, F.array(F.col("n"), F.floor(F.col("n") * (F.col("scene_id") % 2 + 1) / 2))).otherwise(F.array("n")).cast("array<long>")
    manifest = c.select("scene_id", F.lit(1).alias("version"), F.aggregate(counts, F.lit(0).cast("long"), lambda a, b: a + b).alias("count"), counts.alias("counts"), F.size(counts).alias("lod_levels"))
    leaves = manifest.select("scene_id", F.posexplode("counts").alias("lod", "n")).select("scene_id", "lod", F.concat(F.col("lod").cast("string"), F.lit("_0")).alias("file"), F.lit(0).cast("long").alias("offset"), "n")
    units = leaves.select("scene_id", "file", F.col("n").alias("rows"), F.array(F.lit("meta.json")).alias("files"))
    entries = units.select("scene_id", F.concat("file", F.lit("/meta.json")).alias("name"), F.lit(1).alias("size")).unionByName(manifest.select("scene_id", F.lit("lod-meta.json").alias("name"), F.lit(1).alias("size")))
    return audit.audit_manifest(manifest, leaves, units, entries).select("scene_id", "level", "rule", "detail")


O["audit_single_level"] = """
WITH c AS (SELECT o_custkey AS scene_id, sum(o_orderkey) * 100 AS n FROM orders GROUP BY 1)
SELECT scene_id, CASE WHEN n >= 1000000 THEN 'error' ELSE 'warning' END AS level, 'V6' AS rule, CAST(n AS VARCHAR) AS detail FROM c WHERE scene_id % 3 <> 0
UNION ALL SELECT scene_id, 'error', 'V7', CAST(CAST(floor(n * (scene_id % 2 + 1) / 2) AS BIGINT) AS VARCHAR) FROM c WHERE scene_id % 3 = 0 AND scene_id % 2 = 1"""


@query
def running_offsets(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages").select((F.col("page_id") % 7).alias("path"), F.col("page_id").alias("seq"), F.concat(F.lit("d/"), (F.col("page_id") % 90).cast("string"), F.when(F.col("page_id") % 50 == 0, "/../x").otherwise(".txt")).alias("name"), F.length("html").cast("long").alias("size"))
    return audit.running_offsets(p)


O["running_offsets"] = """
WITH p AS (SELECT page_id % 7 AS path, page_id AS seq, 'd/' || (page_id % 90) || CASE WHEN page_id % 50 = 0 THEN '/../x' ELSE '.txt' END AS name, length(html) AS size FROM pages)
SELECT *, CAST(sum(30 + length(name) + size) OVER (PARTITION BY path ORDER BY seq) - (30 + length(name) + size) AS BIGINT) AS "offset", count(*) OVER (PARTITION BY path, name) > 1 AS duplicate, name LIKE '%/../%' AS bad_name, sum(30 + length(name) + size) OVER (PARTITION BY path ORDER BY seq) - (30 + length(name) + size) >= 4294967295 AS zip64,
count(*) OVER (PARTITION BY path) >= 65535 OR sum(30 + length(name) + size) OVER (PARTITION BY path) >= 4294967295 AS zip64_directory FROM p"""


@query
def archive_entries(spark: SparkSession, d: str) -> DataFrame:
    """Pages packed into archives by the tasks, whose directories are read back."""
    folder = shared_path(spark, "archives")
    pages = load(spark, d, "pages").withColumn("archive", F.col("page_id") % 5)

    def pack(table: pa.Table) -> pa.Table:
        fs, inside = located(folder)
        fs.create_dir(inside, recursive=True)
        name = f"{table['archive'][0].as_py()}.zip"
        held = io.BytesIO()
        with zipfile.ZipFile(held, "w") as z:
            for page, html in sorted(zip(table["page_id"].to_pylist(), table["html"].to_pylist(), strict=True)):
                z.writestr(f"p/{page}.html", (html or "").encode())
        with fs.open_output_stream(f"{inside}/{name}") as out:
            out.write(held.getvalue())
        return pa.table({"path": [f"{folder}/{name}"]})

    made = pages.select("archive", "page_id", "html").groupBy("archive").applyInArrow(pack, "path string")
    entries = logs.archive_entries(spark, [r["path"] for r in made.collect()])  # a path per archive
    return entries.select(F.regexp_extract("path", "([0-9]+)\\.zip$", 1).cast("int").alias("archive"), "seq", "name", "size", "offset", "zip64")


O["archive_entries"] = """
WITH p AS (SELECT CAST(page_id % 5 AS INT) AS archive, row_number() OVER (PARTITION BY page_id % 5 ORDER BY page_id) - 1 AS seq, 'p/' || page_id || '.html' AS name, strlen(coalesce(html, '')) AS size FROM pages)
SELECT archive, seq, name, size, CAST(sum(30 + length(name) + size) OVER (PARTITION BY archive ORDER BY seq) - (30 + length(name) + size) AS BIGINT) AS "offset", false AS zip64 FROM p"""


@query
def safe_members(spark: SparkSession, d: str) -> DataFrame:
    p = load(spark, d, "pages")
    name = F.when(F.col("page_id") % 4 == 0, F.format_string("reports/R-20240101-%04d.json", "page_id")).when(F.col("page_id") % 4 == 1, "reports.jsonl").when(F.col("page_id") % 4 == 2, "events-2024-01-01.json").otherwise(F.concat(F.lit("../"), F.col("url")))
    entries = p.select(name.alias("name"), (F.length("html") * 1000).cast("long").alias("size"))
    return logs.safe_members(entries).groupBy("kept").agg(F.count("*").alias("n"))


O["safe_members"] = """SELECT CASE page_id % 4 WHEN 0 THEN length(html) * 1000 <= 3145728 WHEN 1 THEN length(html) * 1000 <= 268435456 WHEN 2 THEN length(html) * 1000 <= 4194304 ELSE false END AS kept, count(*) AS n FROM pages GROUP BY 1"""


@query
def compare_quantiles(spark: SparkSession, d: str) -> DataFrame:
    s = splats(spark, d)
    moved = s.withColumn("x", F.col("x") + F.when(F.col("scene_id") == "A", 5.0).otherwise(0.001))
    return audit.compare_quantiles(s, moved, [0.1, 0.9], 0.01).select("scene_id", "axis", "q", _r("a"), _r("b"), "equal")


_SHIFT = {"x": "CASE WHEN scene_id = 'A' THEN 5.0::DOUBLE ELSE 0.001::DOUBLE END", "y": "0.0::DOUBLE", "z": "0.0::DOUBLE"}
_PAIR = " UNION ALL ".join(f"SELECT scene_id, '{a}' AS axis, {q}::DOUBLE AS q, value AS a, value + {_SHIFT[a]} AS b FROM ({_quantile_sql(SPLAT_SQL, a, q)})" for a in AXES for q in (0.1, 0.9))
O["compare_quantiles"] = f"SELECT scene_id, axis, q, round(a, 6) AS a, round(b, 6) AS b, scene_id <> 'A' OR axis <> 'x' AS equal FROM ({_PAIR})"


@query
def compare_manifests(spark: SparkSession, d: str) -> DataFrame:
    # of pages of one address the least CRC counts: the entries are worked out once for either side, and any page may come first
    crc = F.crc32(F.coalesce("html", F.lit("")).cast("binary"))
    p = load(spark, d, "pages").groupBy(F.col("url").alias("name")).agg(F.min(crc).alias("crc"))
    b = p.where("length(name) % 10 <> 4").withColumn("crc", F.when(F.length("name") % 7 == 0, F.col("crc") + 1).otherwise(F.col("crc")))
    return audit.compare_manifests(p.where("length(name) % 10 <> 3"), b)


O["compare_manifests"] = """SELECT DISTINCT url AS name, CASE WHEN length(url) % 10 = 3 THEN 'added' WHEN length(url) % 10 = 4 THEN 'gone' ELSE 'changed' END AS change FROM pages WHERE length(url) % 10 IN (3, 4) OR length(url) % 7 = 0"""


@query
def ply_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """The splat view written as PLY parts, triaged and read back; counts and sums must agree with the view."""
    folder = shared_path(spark, "ply")
    ply.write_splats(cloud.keep_splat_columns(splats(spark, d)).repartition(4, "record_no").drop("scene_id"), folder)
    paths = [f"{folder}/{f['name']}" for f in ply.committed(folder)]
    back = ply.read_splats(spark, folder, 20_000)
    checked = ply.triage_inputs(spark, paths).agg(F.count_if("ok").alias("files"), F.sum("n").alias("declared"))
    return back.agg(F.count("*").alias("n"), F.round(F.sum(F.col("y").cast("double")), 1).alias("y"), F.round(F.sum(F.col("z").cast("double")), 1).alias("z")).crossJoin(checked)


O["ply_round_trip"] = "SELECT count(*) AS n, round(sum(l_quantity), 1) AS y, round(sum(l_partkey % 1000)::DOUBLE, 1) AS z, CAST(4 AS BIGINT) AS files, count(*) AS declared FROM lineitem"


def _stored_splats(spark: SparkSession, d: str) -> str:
    """The splat view as a committed set of PLY files, in record order, large scenes in several files."""
    folder = shared_path(spark, "splats")
    rows = cloud.keep_splat_columns(splats(spark, d))
    ply.write_splats(rows.repartitionByRange(max(6, tasks_for(rows)), "scene_id", "record_no").sortWithinPartitions("scene_id", "record_no"), folder)
    return folder


@query
def ply_block_sample(spark: SparkSession, d: str) -> DataFrame:
    """The block sample, read from files of which only the blocks are opened."""
    return ply.read_splats(spark, _stored_splats(spark, d), blocks=64, block_records=256).select("scene_id", "record_no", "block")


O["ply_block_sample"] = O["block_sample"]


@query
def ply_record_range(spark: SparkSession, d: str) -> DataFrame:
    """Rows of one scene and range of records: the filters reach the files."""
    rows = ply.read_splats(spark, _stored_splats(spark, d), 500).where("scene_id = 'N' AND record_no >= 1000 AND record_no < 3000")
    return rows.select("scene_id", "record_no", F.round(F.col("x").cast("double"), 3).alias("x"), F.col("y").cast("double").alias("y"))


O["ply_record_range"] = f"SELECT scene_id, record_no, round(CAST(x AS FLOAT)::DOUBLE, 3) AS x, y FROM ({SPLAT_SQL}) WHERE scene_id = 'N' AND record_no BETWEEN 1000 AND 2999"


def _in_units(spark: SparkSession, d: str) -> DataFrame:
    """The splat view in units of 500 records."""
    return splats(spark, d).withColumn("unit", F.floor(F.col("record_no") / 500))


@query
def attribute_palettes(spark: SparkSession, d: str) -> DataFrame:
    """The error that the best palettes of four leave in scales and colours, and how many values each has."""
    units = _in_units(spark, d)
    labels, palettes = lod.attribute_palettes(units, ["scene_id", "unit"], k=4)
    error = lod.palette_error(units, ["scene_id", "unit"], labels, palettes)
    size = palettes.groupBy("scene_id", "unit", "name").agg(F.sum("n").alias("labelled"))
    return error.join(size, ["scene_id", "unit", "name"]).select("scene_id", "unit", "name", "n", "labelled", F.round("rmse", 5).alias("rmse"))


def _codebook_sql(k: int) -> str:
    """The dynamic programme over distinct values, a layer at a time."""
    values = " UNION ALL ".join(f"SELECT scene_id, record_no // 500 AS unit, '{name}' AS name, {c}::DOUBLE AS v FROM ({SPLAT_SQL})" for name, held in lod.SHARED.items() for c in held)
    parts = [
        f"x AS MATERIALIZED (SELECT scene_id, unit, name, v, count(*) AS c FROM ({values}) GROUP BY ALL)",
        """d AS MATERIALIZED (SELECT scene_id, unit, name, row_number() OVER w AS i, sum(c) OVER w AS c, sum(c * (v - m)) OVER w AS t, sum(c * (v - m) * (v - m)) OVER w AS s
           FROM (SELECT *, avg(v) OVER (PARTITION BY scene_id, unit, name) AS m FROM x) WINDOW w AS (PARTITION BY scene_id, unit, name ORDER BY v))""",
        "z AS MATERIALIZED (SELECT * FROM d UNION ALL SELECT DISTINCT scene_id, unit, name, 0, 0, 0, 0 FROM d)",
        """e AS MATERIALIZED (SELECT a.scene_id, a.unit, a.name, a.i AS i, b.i AS j, (b.s - a.s) - (b.t - a.t) * (b.t - a.t) / (b.c - a.c) AS e
           FROM z AS a JOIN z AS b ON a.scene_id = b.scene_id AND a.unit = b.unit AND a.name = b.name AND a.i < b.i)""",
        "l1 AS MATERIALIZED (SELECT scene_id, unit, name, j, e FROM e WHERE i = 0)",
    ]
    for n in range(2, k + 1):
        parts.append(f"l{n} AS MATERIALIZED (SELECT scene_id, unit, name, j, min(e) AS e FROM (SELECT * FROM l{n - 1} UNION ALL SELECT e.scene_id, e.unit, e.name, e.j, l.e + e.e FROM l{n - 1} AS l JOIN e ON l.scene_id = e.scene_id AND l.unit = e.unit AND l.name = e.name AND l.j = e.i) GROUP BY ALL)")
    return f"WITH {', '.join(parts)} SELECT scene_id, unit, name, CAST(c AS BIGINT) AS n, CAST(c AS BIGINT) AS labelled, round(sqrt(greatest(0, e) / c), 5) AS rmse FROM l{k} JOIN d USING (scene_id, unit, name) WHERE d.i = l{k}.j QUALIFY row_number() OVER (PARTITION BY scene_id, unit, name ORDER BY d.i DESC) = 1"


O["attribute_palettes"] = _codebook_sql(4)


@query
def decimate_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Rows that pair merging leaves of each tile, those that went into them, and their greatest number."""
    return lod.decimate(_tiled(spark, d), 0.5, "pairs").groupBy("scene_id", "tile").agg(F.count("*").alias("after"), F.sum("merged").alias("merged"), F.max("record_no").alias("last"))


O["decimate_pairs"] = f"{KD} SELECT scene_id, CAST(tile AS INT) AS tile, greatest(1, CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT)) AS after, count(*) AS merged, greatest(1, CAST(floor(count(*) * 0.5 + 0.5) AS BIGINT)) - 1 AS last FROM g GROUP BY ALL"


@query
def decimation_error(spark: SparkSession, d: str) -> DataFrame:
    """What merging along the curve costs: rows, groups and the distance of rows from what they merge into, by scene."""
    return lod.decimation_error(_tiled(spark, d)).select("scene_id", "n", "groups", F.round("rmse", 4).alias("rmse"), F.round("psnr", 3).alias("psnr"))


_APART = " + ".join(f"greatest(0, sum(w * {a} * {a}) - sum(w * {a}) * sum(w * {a}) / sum(w))" for a in AXES)
O["decimation_error"] = f"""{KD}, q1 AS (SELECT *, {_W} AS w, rank * greatest(1, CAST(floor(n * 0.5 + 0.5) AS BIGINT)) // n AS grp FROM ({_OWN.format(ranked=RANKED)})),
q2 AS (SELECT scene_id, tile, grp, count(*) AS n, sum(w) AS w, {_APART} AS e, {", ".join(f"{k}({a}) AS {k}_{a}" for a in AXES for k in ("min", "max"))} FROM q1 GROUP BY scene_id, tile, grp),
q3 AS (SELECT scene_id, CAST(sum(n) AS BIGINT) AS n, count(*) AS groups, sqrt(sum(e) / sum(w)) AS rmse, greatest({", ".join(f"max(max_{a}) - min(min_{a})" for a in AXES)}) AS span FROM q2 GROUP BY scene_id)
SELECT scene_id, n, groups, round(rmse, 4) AS rmse, round(20 * log10(span / rmse), 3) AS psnr FROM q3"""


@query
def sketch_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Quantiles from sketches of eight stored batches: the rows that each covers, and whether its rank is right within the bound."""
    rows, path, qs = splats(spark, d), shared_path(spark, "sketches"), [0.01, 0.5, 0.98]
    for batch in range(8):
        sketches.store_sketches(rows.where(F.col("record_no") % 8 == batch), list(AXES), path, str(batch))
    merged = sketches.stored_sketches(spark, path)
    found = sketches.sketch_quantiles(merged, {a: qs for a in AXES})
    values = rows.select("scene_id", F.explode(F.array(*(F.struct(F.lit(a).alias("column"), F.col(a).alias("v")) for a in AXES))).alias("r")).select("scene_id", "r.*")
    ranks = values.join(F.broadcast(found), ["scene_id", "column"]).groupBy("scene_id", "column", "q").agg(F.count("*").alias("n"), F.avg((F.col("v") < F.col("value")).cast("int")).alias("below"), F.avg((F.col("v") <= F.col("value")).cast("int")).alias("upto"))
    fits = (F.col("below") <= F.col("q") + 2 * sketches.RANK_ERROR) & (F.col("upto") >= F.col("q") - 2 * sketches.RANK_ERROR)
    return ranks.select("scene_id", F.col("column").alias("axis"), "q", "n", fits.alias("fits"))


O["sketch_quantiles"] = f"SELECT scene_id, axis, q, count(*) AS n, true AS fits FROM ({SPLAT_SQL}), (SELECT unnest(['x', 'y', 'z']) AS axis), (SELECT unnest([0.01::DOUBLE, 0.5::DOUBLE, 0.98::DOUBLE]) AS q) GROUP BY ALL"


@query
def decimate_adaptive_rows(spark: SparkSession, d: str) -> DataFrame:
    """Where the rows of adaptive decimation lie, and how many went into each."""
    return lod.decimate(_tiled(spark, d), 0.5, "adaptive").select("scene_id", "tile", "record_no", "merged", *(F.round(F.col(a) + 1e-7, 4).alias(a) for a in AXES))


_QUOTAS, _, _ = O["adaptive_quotas"].rpartition("\nSELECT scene_id, tile, cell")
O["decimate_adaptive_rows"] = f"""{_QUOTAS},
u1 AS (SELECT scene_id, tile, cell, size, CAST(least_one + whole + CASE WHEN r <= short THEN 1 ELSE 0 END AS BIGINT) AS quota FROM t7),
u2 AS (SELECT *, CAST(sum(quota) OVER (PARTITION BY scene_id, tile ORDER BY cell) - quota AS BIGINT) AS start FROM u1),
u3 AS (SELECT h.*, {_W} AS w, CASE WHEN quota > 0 THEN start + (rank - cell * 64) * quota // size ELSE greatest(0, start - 1) END AS grp
       FROM (SELECT * FROM ({_OWN.format(ranked=RANKED)})) AS h JOIN u2 ON u2.scene_id = h.scene_id AND u2.tile = h.tile AND u2.cell = h.rank // 64)
SELECT scene_id, CAST(tile AS INT) AS tile, grp AS record_no, count(*) AS merged, {", ".join(f"round(sum(w * {a}) / sum(w) + 1e-7, 4) AS {a}" for a in AXES)} FROM u3 GROUP BY scene_id, tile, grp"""


@query
def written_levels(spark: SparkSession, d: str) -> DataFrame:
    """Levels written as 32-bit floats by scene, level and tile, and read back: rows and their last number."""
    path = shared_path(spark, "levels")
    ply.write_levels(lod.build_levels(_tiled(spark, d), 2), path)
    back = spark.read.parquet(path)
    if dict(back.dtypes)["x"] != "float":
        raise ValueError("positions are not 32-bit floats")
    return back.groupBy("scene_id", F.col("lod").cast("int").alias("lod"), F.col("tile").cast("int").alias("tile")).agg(F.count("*").alias("n"), F.max("record_no").alias("last"))


O["written_levels"] = _LEVELS + " UNION ALL ".join(f" SELECT scene_id, {i} AS lod, CAST(tile AS INT) AS tile, count(*) AS n, max(record_no) AS last FROM {t} GROUP BY scene_id, tile" for i, t in enumerate(("g", "lod1")))


@query
def audit_odd_scenes(spark: SparkSession, d: str) -> DataFrame:
    """A scene per supplier, each with the fault of its number: no root and no manifest, a unit that nothing names, and others."""
    k = F.col("k")
    base = load(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("scene_id"), (F.col("s_suppkey") % 8).alias("k"))
    of = lambda rows, names: base.select("scene_id", "k", F.inline(F.array(*(F.struct(*(v.alias(n) for v, n in zip(map(lambda v: v if not isinstance(v, (int, str)) else F.lit(v), r), names, strict=True))) for r in rows))))
    manifest = base.where(k != 1).select("scene_id", F.lit(1).alias("version"), F.lit(15).cast("long").alias("count"), F.array(F.lit(10), F.lit(5)).cast("array<long>").alias("counts"), F.when(k == 3, 3).otherwise(2).alias("lod_levels"))
    second = F.when(k == 5, 4).otherwise(5).cast("long")
    leaves = of([(0, "0_0", 0, F.lit(10).cast("long")), (1, "1_0", 0, second)], ["lod", "file", "offset", "n"]).drop("k")
    units = of([("0_0", F.lit(10).cast("long"), F.array(F.lit("meta.json"))), ("1_0", second, F.array(F.lit("meta.json"))), ("1_1", F.lit(7).cast("long"), F.array().cast("array<string>"))], ["file", "rows", "files"])
    units = units.where((k == 2) | (F.col("file") != "1_1")).drop("k")
    entries = of([("lod-meta.json", F.lit(1).cast("long")), ("0_0/meta.json", F.when(k == 6, 11 << 30).otherwise(1).cast("long")), ("1_0/meta.json", F.lit(1).cast("long"))], ["name", "size"])
    entries = entries.where((k != 1) | (F.col("name") != "lod-meta.json"))
    entries = entries.unionByName(entries.where((k == 7) & (F.col("name") == "1_0/meta.json"))).drop("k")
    expected = of([(0, F.lit(10) + (k == 4).cast("int")), (1, F.lit(5) + (k == 4).cast("int"))], ["lod", "n"]).drop("k")
    return audit.audit_manifest(manifest, leaves, units, entries, expected).select("scene_id", "level", "rule", "subject")


O["audit_odd_scenes"] = """
WITH s AS (SELECT CAST(s_suppkey AS VARCHAR) AS scene_id, s_suppkey % 8 AS k FROM supplier)
SELECT scene_id, CASE WHEN k = 6 THEN 'warning' ELSE 'error' END AS level, CASE k WHEN 1 THEN 'V2' WHEN 2 THEN 'V13' WHEN 3 THEN 'V4' WHEN 4 THEN 'V8' WHEN 5 THEN 'V9' WHEN 6 THEN 'V14' ELSE 'V15' END AS rule,
       unnest(CASE k WHEN 1 THEN ['lod-meta.json'] WHEN 2 THEN ['1_1'] WHEN 3 THEN ['counts'] WHEN 4 THEN ['0', '1'] WHEN 5 THEN ['1'] WHEN 6 THEN ['size'] ELSE ['1_0/meta.json'] END) AS subject
FROM s WHERE k > 0"""
