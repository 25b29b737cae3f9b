"""Levels of detail: exact-count merging, leaves, units, manifest tables, palettes, quantisation."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lodestrata.functions import scalars as S
from lodestrata.operators.cloud import POSITION, finite, morton_code, zorder_rows
from lodestrata.operators.folds import pack_groups
from lodestrata.sources.tables import persisted

COLOUR = ["f_dc_0", "f_dc_1", "f_dc_2"]
SCALES = ["scale_0", "scale_1", "scale_2"]
QUATERNION = [f"rot_{i}" for i in range(4)]
BY = ["scene_id", "tile"]
PAIRS = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
MOMENTS = [f"m_{POSITION[a]}{POSITION[b]}" for a, b in PAIRS]
#: Most coefficients of f_rest; least variance along an axis of a merged row; weights beyond these bounds count as the bound.
REST, THINNEST = 45, 1e-12
LIGHTEST, HEAVIEST = 1e-200, 1e100


def weight(df: DataFrame) -> Column:
    """Visible volume: opacity times the product of the axes, above 0: rows too faint for a double weigh alike."""
    scales = [F.col(c) for c in ("scale_0", "scale_1", "scale_2") if c in df.columns]
    w = S.decode_opacity(F.col("opacity")) * F.exp(sum(scales[1:], scales[0]))
    return F.when(w > LIGHTEST, F.least(w, F.lit(HEAVIEST))).otherwise(F.lit(LIGHTEST))


def origin(df: DataFrame) -> DataFrame:
    """``df`` with a place of each tile (o_x, o_y, o_z) from which distances are counted, so that their squares keep their digits."""
    low = lambda a: F.min(F.when(finite(F.col(a)), F.col(a).cast("double"))).over(Window.partitionBy(*BY))
    return df.withColumns({f"o_{a}": F.coalesce(low(a), F.lit(0.0)) for a in POSITION})


def target(n: Column, ratio: float) -> Column:
    return F.greatest(F.lit(1).cast("long"), S.nearest(n * F.lit(ratio)))


def covariance(df: DataFrame) -> list[Column]:
    """The six moments of a row about its centre, R S^2 R^T: from its quaternion (zero: no turn) and scales (2D: none along z)."""
    q = [F.col(c) for c in QUATERNION]
    size = F.nullif(sum((v * v for v in q[1:]), q[0] * q[0]), F.lit(0.0))
    w, x, y, z = (F.coalesce(v / F.sqrt(size), F.lit(float(i == 0))) for i, v in enumerate(q))
    r = [
        [w * w + x * x - y * y - z * z, 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), w * w - x * x + y * y - z * z, 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), w * w - x * x - y * y + z * z],
    ]
    s = [F.exp(2 * F.col(c)) for c in SCALES if c in df.columns]
    return [sum((r[a][k] * r[b][k] * s[k] for k in range(1, len(s))), r[a][0] * r[b][0] * s[0]) for a, b in PAIRS]


def merge_groups(df: DataFrame, group: list[str]) -> DataFrame:
    """Rows of a group become one: weighted means of position, colour and f_rest, and the second moments of the whole.

    ``merged`` counts the rows, ``moments`` (m_xx ... m_zz) are the mean of the rows' own moments and of their distances from
    the mean. Opacity is the summed weight over the volume of those moments. A row alone keeps its scales, turn and opacity;
    for others ``merge_moments`` finds scales and turn.
    """
    scales = [c for c in SCALES if c in df.columns]
    rows = origin(df).withColumn("__w", weight(df)).withColumns({f"__{m}": c for m, c in zip(MOMENTS, covariance(df), strict=True)})
    w = F.col("__w")
    mean = lambda c: F.sum(w * c) / F.sum(w)
    axis = [F.col(a) - F.col(f"o_{a}") for a in POSITION]
    places = [(F.min(f"o_{a}") + mean(axis[i])).alias(a) for i, a in enumerate(POSITION)]
    spread = [(mean(F.col(f"__{m}")) + mean(axis[a] * axis[b]) - mean(axis[a]) * mean(axis[b])).alias(m) for m, (a, b) in zip(MOMENTS, PAIRS, strict=True)]
    rest = [F.array_compact(F.array(*(mean(F.get("f_rest", F.lit(i))) for i in range(REST)))).cast("array<float>").alias("f_rest")] if "f_rest" in df.columns else []
    own = [F.min(c).alias(c) for c in (*scales, *QUATERNION, "opacity")]  # of use where one row is a group
    out = rows.groupBy(*group).agg(*places, *(mean(F.col(c)).alias(c) for c in COLOUR), *rest, *own, *spread, F.sum(w).alias("__w"), F.count(F.lit(1)).alias("merged"))
    xx, xy, xz, yy, yz, zz = (F.col(m) for m in MOMENTS)
    volume = F.sqrt(F.greatest(xx * (yy * zz - yz * yz) - xy * (xy * zz - yz * xz) + xz * (xy * yz - yy * xz), F.lit(THINNEST**3)))
    p = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), w / volume))
    return out.withColumn("opacity", F.when(F.col("merged") > 1, F.log(p / (1 - p))).otherwise(F.col("opacity"))).drop("__w")


def _ranked(df: DataFrame) -> DataFrame:
    ranked = zorder_rows(morton_code(df, BY), BY)
    return ranked.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*BY)))


def decimate(df: DataFrame, ratio: float = 0.5, method: str = "uniform") -> DataFrame:
    """Exactly max(1, round(n * ratio)) rows per tile, neighbours on the Z-order curve merged.

    uniform: groups of equal size along the curve. adaptive: cells of about 64 rows get rows by their local error
    (weighted variance of position and colour) with largest remainders, then groups of equal size inside a cell.
    pairs: neighbours are merged two by two, each time those whose merging adds least to the square error.
    """
    merged = _decimated(df, ratio, method)
    return merged if method == "uniform" else persisted(merged, "decimated")  # else plans of joins with it take long


def _decimated(df: DataFrame, ratio: float, method: str) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"unknown method {method!r}; known: {', '.join(METHODS)}")
    grouped = METHODS[method](_ranked(df), ratio)
    merged = merge_moments(merge_groups(grouped, [*BY, "grp"]))
    return merged.withColumn("record_no", F.col("grp")).drop("grp")


def _uniform(ranked: DataFrame, ratio: float) -> DataFrame:
    return ranked.withColumn("grp", F.floor(F.col("rank") * target(F.col("n"), ratio) / F.col("n")))


def cell_targets(ranked: DataFrame, ratio: float) -> DataFrame:
    """scene_id, tile, cell, size, quota: quotas sum to the tile's target, each between one and the cell's size where that fits."""
    cells = origin(ranked).withColumn("cell", F.floor(F.col("rank") / 64))
    w = weight(ranked)
    var = lambda c: F.sum(w * c * c) / F.sum(w) - F.pow(F.sum(w * c) / F.sum(w), 2)
    error = sum((F.greatest(F.lit(0.0), var(c)) for c in (*(F.col(a) - F.col(f"o_{a}") for a in POSITION), *map(F.col, COLOUR))), F.lit(0.0))
    stat = cells.groupBy(*BY, "n", "cell").agg(F.count(F.lit(1)).alias("size"), F.round(error, 6).alias("error"))
    by, tile = Window.partitionBy(*BY), target(F.col("n"), ratio)
    share = (F.col("error") + F.lit(1e-6)) * F.col("size")
    want = F.count(F.lit(1)).over(by)
    stat = stat.withColumn("goal", tile).withColumn("floor", F.when(want <= tile, 1).otherwise(0))
    spare = F.col("goal") - F.sum("floor").over(by)
    room = F.col("size") - F.col("floor")
    # water-filling in one step: proportional shares cut at the room, the cut-off rest dealt by room
    first = F.least(room.cast("double"), spare * share / F.sum(share).over(by))
    stat = stat.withColumn("__spare", spare).withColumn("__room", room).withColumn("__first", F.round(first, 6))
    rest = F.col("__spare") - F.sum("__first").over(by)
    left = F.col("__room") - F.col("__first")
    exact = F.col("__first") + F.when(F.sum(left).over(by) > 0, rest * left / F.sum(left).over(by)).otherwise(0.0)
    stat = stat.withColumn("__exact", F.round(exact, 6)).withColumn("__base", F.floor(F.col("__exact") + 1e-9))
    short = F.col("__spare") - F.sum("__base").over(by)
    order = F.row_number().over(by.orderBy(F.desc(F.when(F.col("__base") < F.col("__room"), F.round(F.col("__exact") - F.col("__base"), 6)).otherwise(-1.0)), "cell"))
    quota = F.col("floor") + F.col("__base") + F.when(order <= short, 1).otherwise(0)
    return stat.select(*BY, "cell", "size", quota.cast("long").alias("quota"))


def _adaptive(ranked: DataFrame, ratio: float) -> DataFrame:
    ranked = persisted(ranked, "ranked")  # for the quotas and for the rows
    quotas = persisted(cell_targets(ranked, ratio), "quotas")  # their long expressions stay out of the plans of what is joined later
    start = F.sum("quota").over(Window.partitionBy(*BY).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("quota")
    quotas = quotas.withColumn("start", start)
    cells = ranked.withColumn("cell", F.floor(F.col("rank") / 64)).join(quotas, [*BY, "cell"])
    # a cell without quota joins the group before it (or the first)
    inside = F.floor((F.col("rank") - F.col("cell") * 64) * F.col("quota") / F.col("size"))
    group = F.when(F.col("quota") > 0, F.col("start") + inside).otherwise(F.greatest(F.lit(0).cast("long"), F.col("start") - 1))
    return cells.withColumn("grp", group)


#: Rows of a tile that one task pairs at most: longer tiles are paired in stretches of the Z-order curve.
STRETCH = 200_000
#: Neighbours along a curve that a row may be paired with, and the shifts (in cells) of the curves that are looked at.
NEAR, SHIFTS = 8, (0, 341)


def _curve(p: np.ndarray, shift: int) -> np.ndarray:
    """The order of points along a Z-order curve over their bounds, moved by some of its 1024 cells."""
    low, extent = p.min(axis=0), np.ptp(p, axis=0)
    cell = ((p - low) * (1023.0 / np.where(extent > 0, extent, 1.0))).astype(np.int64) + shift
    code = np.zeros(len(p), dtype=np.int64)
    for i in range(3):
        for bit in range(11):
            code |= (cell[:, i] >> bit & 1) << (3 * bit + i)
    return np.argsort(code, kind="stable")


def pair_merge(features: np.ndarray, weights: np.ndarray, goal: int) -> np.ndarray:
    """Cluster numbers (0 .. goal - 1, in order of their first row) of rows merged pair by pair.

    Merging two clusters costs w1 w2 / (w1 + w2) times the square of their distance, which is what the weighted square error
    grows by. In a round each cluster looks at its neighbours along shifted curves through the first three features; pairs that
    are each other's cheapest merge, the cheapest of them only where the goal is near. Ties go to the lower rows.
    """
    n = len(features)
    label, x, w = np.arange(n), features.astype(float).copy(), weights.astype(float).copy()
    while len(x) > goal:
        m = len(x)
        best, price = np.full(m, m), np.full(m, np.inf)
        for shift in SHIFTS:
            order = _curve(x[:, :3], shift)
            for step in range(1, min(NEAR, m - 1) + 1):
                i, j = order[:-step], order[step:]
                cost = w[i] * w[j] / (w[i] + w[j]) * ((x[i] - x[j]) ** 2).sum(axis=1)
                for own, other in ((i, j), (j, i)):  # no row twice among them
                    less = (cost < price[own]) | (cost == price[own]) & (other < best[own])
                    price[own[less]], best[own[less]] = cost[less], other[less]
        mutual = np.flatnonzero((best[best] == np.arange(m)) & (np.arange(m) < best))
        if not len(mutual):  # equal costs in a ring: the cheapest pair of all
            mutual = np.array([np.lexsort((best, np.arange(m), price))[0]])
        mutual = mutual[np.lexsort((mutual, price[mutual]))][: m - goal]
        a, b = np.minimum(mutual, best[mutual]), np.maximum(mutual, best[mutual])
        share = (w[b] / (w[a] + w[b]))[:, None]
        x[a] += share * (x[b] - x[a])
        w[a] += w[b]
        keep = np.ones(m, dtype=bool)
        keep[b] = False
        new = np.cumsum(keep) - 1
        new[b] = new[a]
        label, x, w = new[label], x[keep], w[keep]
    return label


def _pairs(ranked: DataFrame, ratio: float) -> DataFrame:
    """Groups of rows that are merged pair by pair: see ``pair_merge``. The cost counts position (in parts of the tile's extent)
    and colour. A tile is one task's work up to STRETCH rows; of longer ones each stretch gets its share of the target."""
    goal = target(F.col("n"), ratio)
    stretch = F.floor(F.col("rank") / STRETCH)
    upto = lambda r: F.floor(F.least(r, F.col("n")) * goal / F.col("n"))
    begin = upto(stretch * STRETCH)
    rows = ranked.withColumns({"__stretch": stretch, "__w": weight(ranked), "__begin": begin, "__goal": upto((stretch + 1) * STRETCH) - begin})
    schema = StructType([*ranked.schema.fields, StructField("grp", LongType())])
    names = ranked.columns

    def merge(table: pa.Table) -> pa.Table:
        table = table.sort_by("rank")
        p = np.column_stack([table[c].to_numpy() for c in POSITION]).astype(float)
        colour = np.column_stack([table[c].to_numpy() for c in COLOUR]).astype(float)
        p, colour = np.nan_to_num(p, posinf=0.0, neginf=0.0), np.nan_to_num(colour, posinf=0.0, neginf=0.0)
        scale = max(float(np.ptp(p, axis=0).max()), 1e-30)
        label = pair_merge(np.hstack([(p - p.min(axis=0)) / scale, colour / 16]), table["__w"].to_numpy(), max(1, table["__goal"][0].as_py()))
        return pa.Table.from_arrays([*(table[c] for c in names), pa.array(label + table["__begin"][0].as_py(), pa.int64())], [*names, "grp"])

    return rows.groupBy(*BY, "__stretch").applyInArrow(merge, schema)


METHODS = {"uniform": _uniform, "adaptive": _adaptive, "pairs": _pairs}


def decimation_error(df: DataFrame, ratio: float = 0.5, method: str = "uniform") -> DataFrame:
    """Per scene: rows, groups, weighted root mean square distance of the rows from what they merge into, and its PSNR over the
    largest extent, in dB."""
    grouped = origin(METHODS[method](_ranked(df), ratio)).withColumn("__w", weight(df))
    w = F.col("__w")
    place = [F.col(a) - F.col(f"o_{a}") for a in POSITION]
    spread = sum((F.sum(w * v * v) - F.sum(w * v) * F.sum(w * v) / F.sum(w) for v in place), F.lit(0.0))
    ends = [f(a).alias(f"{k}_{a}") for a in POSITION for k, f in (("lo", F.min), ("hi", F.max))]
    groups = grouped.groupBy(*BY, "grp").agg(F.greatest(spread, F.lit(0.0)).alias("e"), F.sum(w).alias("w"), F.count(F.lit(1)).alias("n"), *ends)
    extent = F.greatest(*(F.max(f"hi_{a}") - F.min(f"lo_{a}") for a in POSITION))
    out = groups.groupBy("scene_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("groups"), F.sqrt(F.sum("e") / F.sum("w")).alias("rmse"), extent.alias("span"))
    return out.withColumn("psnr", F.when(F.col("rmse") > 0, 20 * F.log10(F.col("span") / F.col("rmse"))))


def _turns(v: np.ndarray) -> np.ndarray:
    """Quaternions, real part first and not negative, of rotation matrices: the eigenvector that fits each best."""
    k = np.empty((len(v), 4, 4))
    k[:, 0, 0] = v[:, 0, 0] + v[:, 1, 1] + v[:, 2, 2]
    for i in range(3):
        j, m = (i + 1) % 3, (i + 2) % 3
        k[:, i + 1, i + 1] = 2 * v[:, i, i] - k[:, 0, 0]
        k[:, 0, i + 1] = k[:, i + 1, 0] = v[:, m, j] - v[:, j, m]
        k[:, j + 1, m + 1] = k[:, m + 1, j + 1] = v[:, j, m] + v[:, m, j]
    q = np.linalg.eigh(k)[1][:, :, 3]
    return q * np.where(q[:, :1] < 0, -1.0, 1.0)


def merge_moments(merged: DataFrame) -> DataFrame:
    """Scales (the greatest first) and turn of merged rows from their moments, which are dropped: a batch of 3x3 eigenproblems."""
    scales = [c for c in SCALES if c in merged.columns]
    kept = [f for f in merged.schema if f.name not in MOMENTS]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            whole = np.isfinite(f[MOMENTS].to_numpy(dtype=float)).all(axis=1)  # beyond a double: scales and turn of one row stay
            out, some = f[[k.name for k in kept]].copy(), np.flatnonzero((f["merged"].to_numpy() > 1) & whole)
            if len(some):
                values, v = np.linalg.eigh(f[MOMENTS].to_numpy(dtype=float)[some][:, [0, 1, 2, 1, 3, 4, 2, 4, 5]].reshape(-1, 3, 3))
                values, v = np.maximum(values[:, ::-1], THINNEST), v[:, :, ::-1].copy()
                v[np.linalg.det(v) < 0, :, 2] *= -1
                columns = dict(zip([*scales, *QUATERNION], [*(np.log(values[:, i]) / 2 for i in range(len(scales))), *_turns(v).T], strict=True))
                for name, column in columns.items():
                    own = out[name].to_numpy(dtype=float, copy=True)
                    own[some] = column
                    out[name] = own
            yield out

    return merged.mapInPandas(solve, fields)


def build_levels(df: DataFrame, levels: int, ratio: float = 0.5, method: str = "uniform") -> DataFrame:
    """All levels stacked with ``lod``; each is built from the one before and written, so no plan grows."""
    names = [c for c in (*BY, "record_no", *POSITION, *COLOUR, "f_rest", "opacity", *SCALES, *QUATERNION) if c in df.columns]
    now = persisted(df.select(*names), "lod0")
    out = now.withColumn("lod", F.lit(0))
    for lod in range(1, levels):
        now = persisted(_decimated(now, ratio, method).select(*names), f"lod{lod}")
        out = out.unionByName(now.withColumn("lod", F.lit(lod)))
    return out


def level_counts(levels: DataFrame) -> DataFrame:
    """Rows and bounds per scene, level and tile."""
    bounds = [f(a).alias(f"{n}_{a}") for a in POSITION for n, f in (("min", F.min), ("max", F.max))]
    return levels.groupBy("scene_id", "lod", "tile").agg(F.count(F.lit(1)).alias("n"), *bounds)


def level_totals(levels: DataFrame) -> DataFrame:
    """Rows per scene and level, and of all levels together (lod null)."""
    return levels.groupingSets([["scene_id", "lod"], ["scene_id"]], "scene_id", "lod").agg(F.count(F.lit(1)).alias("n"))


def lod_leaves(levels: DataFrame, extent: float, min_count: int, steps: int = 12) -> DataFrame:
    """Cells of each tile at multiples of ``extent``; cells of too few rows merge upwards (the edge doubles) until they
    have enough or are the whole tile. scene_id, tile, edge, cx, cy, cz, and by level the count and bounds."""
    cell = [F.floor(F.col(a) / extent).alias(f"c{a}") for a in POSITION]
    bounds = [f(a).alias(f"{n}_{a}") for a in POSITION for n, f in (("min", F.min), ("max", F.max))]
    base = persisted(levels.groupBy(*BY, "lod", *cell).agg(F.count(F.lit(1)).alias("n"), *bounds), "cells")
    keys = [f"c{a}" for a in POSITION]
    widen = lambda d: d.groupBy(*BY, "lod", *keys).agg(F.sum("n").alias("n"), *(f(f"{k}_{a}").alias(f"{k}_{a}") for a in POSITION for k, f in (("min", F.min), ("max", F.max))))
    done, open_ = None, base
    for step in range(steps + 1):
        total = F.sum("n").over(Window.partitionBy(*BY, *keys))
        tagged = open_.withColumn("__total", total).withColumn("edge", F.lit(float(extent * 2**step)))
        enough = F.col("__total") >= min_count
        ready = tagged if step == steps else tagged.where(enough)
        done = ready.drop("__total") if done is None else done.unionByName(ready.drop("__total"))
        if step < steps:
            up = tagged.where(~enough).drop("__total", "edge")
            at = {k: F.floor(F.col(k) / 2) if step < steps - 1 else F.lit(0).cast("long") for k in keys}
            open_ = widen(up.withColumns(at))
    return done


def pack_units(leaves: DataFrame, rows: int) -> DataFrame:
    """leaves (scene_id, tile, lod, leaf, n) -> with unit (per tile and level) and offset inside the unit."""
    packed = pack_groups(leaves, ["scene_id", "tile", "lod"], ["leaf"], "n", rows).withColumnRenamed("group_no", "unit")
    before = Window.partitionBy("scene_id", "tile", "lod", "unit").orderBy("leaf").rowsBetween(Window.unboundedPreceding, 0)
    return packed.withColumn("offset", F.sum("n").over(before) - F.col("n"))


def renumber_units(packed: DataFrame) -> DataFrame:
    """Scene-wide numbers: unit_no dense per level by (tile, unit), file_index by (tile, lod, unit)."""
    units = packed.groupBy("scene_id", "tile", "lod", "unit").agg(F.sum("n").alias("rows"))
    no = F.row_number().over(Window.partitionBy("scene_id", "lod").orderBy("tile", "unit")) - 1
    index = F.row_number().over(Window.partitionBy("scene_id").orderBy("tile", "lod", "unit")) - 1
    return units.withColumn("unit_no", no.cast("long")).withColumn("file_index", index.cast("long"))


def parse_units(files: DataFrame) -> DataFrame:
    """files (scene_id, tile, name, ...) with lod and unit from names like '0_3'; other names and repeated ones are errors."""
    fine = F.col("name").rlike("\\A[0-9]{1,9}_[0-9]{1,9}\\z")
    once = F.count(F.lit(1)).over(Window.partitionBy("scene_id", "tile", "name")) == 1
    checked = F.when(~fine, F.raise_error(F.concat(F.lit("no unit: "), F.col("name")))).when(~once, F.raise_error(F.concat(F.lit("unit twice: "), F.col("name")))).otherwise(F.col("name"))
    part = lambda i: F.split(checked, "_")[i].cast("int")
    return files.withColumn("lod", part(0)).withColumn("unit", part(1))


def reference_units(packed: DataFrame, units: DataFrame) -> DataFrame:
    """Leaves (scene_id, tile, lod, unit, ...) with the scene-wide unit_no and file_index of ``units``; a unit that is not there is an error."""
    keys = ["scene_id", "tile", "lod", "unit"]
    joined = packed.join(units.select(*keys, "unit_no", "file_index"), keys, "left")
    missing = F.raise_error(F.concat_ws(" ", F.lit("leaf of an unknown unit:"), *(F.col(k).cast("string") for k in keys)))
    return joined.withColumn("file_index", F.when(F.col("file_index").isNull(), missing).otherwise(F.col("file_index")))


def scene_manifest(leaves: DataFrame, units: DataFrame, nodes: DataFrame, asset: str = "{}") -> DataFrame:
    """scene_id and its manifest as JSON, numbers to 7 significant digits.

    leaves: a row per cell and level, with bounds and references (scene_id, tile, leaf, lod, n, offset, file_index, min_x ...),
    units (scene_id, lod, unit_no, file_index), nodes of the k-d plan. The tree follows the plan; a node with one side only is
    that side; a tile with several cells has them as children. A scene without any leaf is an error. The manifest of a scene is
    one document, so one task writes it; it has a row per leaf and level, not per splat.
    """
    kind = dict(leaves.dtypes)["scene_id"]
    tree = nodes.where("axis < 0").select("scene_id", "tile", "path")
    ends = F.struct(*(F.col(f"{k}_{a}").cast("double").alias(f"{k}_{a}") for k in ("min", "max") for a in POSITION))
    cells = leaves.join(tree, ["scene_id", "tile"]).select("scene_id", F.struct("path", "leaf", F.col("lod").cast("int").alias("lod"), F.col("n").cast("long").alias("n"), F.col("offset").cast("long").alias("offset"), F.col("file_index").cast("long").alias("file"), ends.alias("ends")).alias("cell"))
    files = units.select("scene_id", F.struct("file_index", F.concat_ws("_", "lod", "unit_no").alias("name")).alias("file"))
    whole = cells.groupBy("scene_id").agg(F.collect_list("cell").alias("cells")).join(files.groupBy("scene_id").agg(F.array_sort(F.collect_list("file")).alias("files")), "scene_id", "full_outer")

    def number(v: float) -> float | int:
        short = float(f"{v:.6e}")
        return int(short) if short.is_integer() else short

    def document(cells: list[dict], files: list[dict]) -> str:
        levels: dict[int, int] = {}
        at: dict[tuple[str, str], dict] = {}
        for c in cells:
            levels[c["lod"]] = levels.get(c["lod"], 0) + c["n"]
            leaf = at.setdefault((c["path"], c["leaf"]), {"ends": [], "lods": {}})
            leaf["ends"].append(c["ends"])
            leaf["lods"][str(c["lod"])] = {"file": c["file"], "offset": c["offset"], "count": c["n"]}
        side: dict[str, list[dict]] = {}
        for (path, _), leaf in sorted(at.items()):
            bound = {k: [pick(e[f"{k}_{a}"] for e in leaf["ends"]) for a in POSITION] for k, pick in (("min", min), ("max", max))}
            side.setdefault(path, []).append({"bound": bound, "lods": leaf["lods"]})
        # from the deepest paths up, what lies under a path becomes one node
        for depth in range(max(map(len, side)), -1, -1):
            for path in [x for x in side if len(x) == depth]:
                under = side.pop(path)
                node = under[0] if len(under) == 1 else {"bound": {k: [pick(u["bound"][k][i] for u in under) for i in range(3)] for k, pick in (("min", min), ("max", max))}, "children": under}
                held = side.setdefault(path[:-1], []) if depth else side.setdefault("", [])
                held.insert(0, node) if depth and path[-1] == "L" else held.append(node)
        top = side[""][0]
        waiting = [top]
        while waiting:
            node = waiting.pop()
            node["bound"] = {k: [number(v) for v in ends] for k, ends in node["bound"].items()}
            waiting += node.get("children", [])
        counts = [levels.get(i, 0) for i in range(max(levels) + 1)]
        return json.dumps({"version": 1, "asset": json.loads(asset), "count": sum(counts), "counts": counts, "lodLevels": len(counts), "filenames": [f["name"] for f in files], "tree": top}, separators=(",", ":"))

    def build(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in frames:
            found = []
            for scene, cells, files in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if not cells:
                    raise ValueError(f"no rows were written of scene {scene}")
                found.append(document(cells, files or []))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.string())], ["scene_id", "manifest"])

    return whole.select("scene_id", "cells", "files").mapInArrow(build, f"scene_id {kind}, manifest string")


def write_manifest(leaves: DataFrame, units: DataFrame, nodes: DataFrame, path: str, asset: str = "{}") -> None:
    """A manifest per scene as a text file in the folder scene_id=<scene>."""
    scene_manifest(leaves, units, nodes, asset).write.partitionBy("scene_id").text(path)


def rollup_bounds(leaves: DataFrame, nodes: DataFrame) -> DataFrame:
    """Bounds and counts of every k-d node from its tiles; nodes with one empty side are left out."""
    tiles = leaves.groupBy(*BY).agg(F.sum("n").alias("n"), *(f(f"{k}_{a}").alias(f"{k}_{a}") for a in POSITION for k, f in (("min", F.min), ("max", F.max))))
    placed = tiles.join(nodes.where("axis < 0").select("scene_id", "tile", "path"), BY)
    above = placed.select("*", F.explode(F.sequence(F.lit(0), F.length("path"))).alias("depth")).withColumn("node", F.substring("path", F.lit(1), F.col("depth")))
    side = F.substring("path", F.col("depth") + 1, F.lit(1))
    out = above.groupBy("scene_id", "node").agg(F.sum("n").alias("n"), F.count_distinct(side).alias("sides"), F.max((F.col("depth") == F.length("path")).cast("int")).alias("leaf"), *(f(f"{k}_{a}").alias(f"{k}_{a}") for a in POSITION for k, f in (("min", F.min), ("max", F.max))))
    return out.where("leaf = 1 OR sides = 2").drop("sides").withColumn("leaf", F.col("leaf") == 1)


def quantize(df: DataFrame, by: list[str]) -> DataFrame:
    """Positions of a unit as 16-bit steps of sign(v) * log1p(|v|), in a low and a high byte; bounds stay along."""
    out = df
    for a in POSITION:
        out = out.withColumn(f"__l{a}", F.signum(a) * F.log1p(F.abs(F.col(a))))
    bounds = out.groupBy(*by).agg(*(f(f"__l{a}").alias(f"{k}_{a}") for a in POSITION for k, f in (("lo", F.min), ("hi", F.max))))
    out = out.join(persisted(bounds, "bounds"), by)
    for a in POSITION:
        extent = F.col(f"hi_{a}") - F.col(f"lo_{a}")
        q = F.when(extent > 0, F.floor((F.col(f"__l{a}") - F.col(f"lo_{a}")) / extent * 65535 + 0.5)).otherwise(0).cast("int")
        out = out.withColumn(f"q_{a}", q).withColumn(f"{a}_low", F.col(f"q_{a}").bitwiseAND(F.lit(255))).withColumn(f"{a}_high", F.shiftright(f"q_{a}", 8))
    return out.drop(*(f"__l{a}" for a in POSITION))


def dequantize(df: DataFrame) -> DataFrame:
    """Positions back from bytes and bounds, as d_x, d_y, d_z."""
    out = df
    for a in POSITION:
        l = F.col(f"lo_{a}") + (F.col(f"{a}_low") + F.col(f"{a}_high") * 256) / 65535 * (F.col(f"hi_{a}") - F.col(f"lo_{a}"))
        out = out.withColumn(f"d_{a}", F.signum(l) * F.expm1(F.abs(l)))
    return out


def quality(df: DataFrame) -> DataFrame:
    """Per scene: rmse of d_x, d_y, d_z against positions and PSNR over the largest extent, in dB."""
    err = sum((F.pow(F.col(f"d_{a}") - F.col(a), 2) for a in POSITION), F.lit(0.0))
    span = F.greatest(*(F.max(a) - F.min(a) for a in POSITION))
    out = df.groupBy("scene_id").agg(F.sqrt(F.avg(err)).alias("rmse"), span.alias("span"))
    return out.withColumn("psnr", F.when(F.col("rmse") > 0, 20 * F.log10(F.col("span") / F.col("rmse"))))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """The nearest centre of each row, the lowest of equal ones; distances are looked at a slice of rows at a time."""
    out, square = np.empty(len(x), dtype=np.int32), (centres * centres).sum(axis=1)
    for lo in range(0, len(x), 4096):
        out[lo : lo + 4096] = (square - 2 * (x[lo : lo + 4096] @ centres.T)).argmin(axis=1)
    return out


def kmeans_palette(df: DataFrame, vec: str, k: int, iterations: int = 10, row: str = "record_no") -> tuple[DataFrame, DataFrame]:
    """Lloyd's iterations from the k lowest rows: labels (row, label) and centroids (label, vec, n). Ties go to the lowest label.

    Only k centroids travel; sums are partial aggregates.
    """
    rows = persisted(df.select(row, F.col(vec).cast("array<double>").alias(vec)), "vectors")
    start = rows.orderBy(row).limit(k).select(vec).collect()
    centroids = np.array([r[0] for r in start], dtype=float)
    kind = dict(df.dtypes)[row]

    def labelled(centres: np.ndarray) -> DataFrame:
        def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in frames:
                x = np.array(f[vec].tolist(), dtype=float).reshape(len(f), centres.shape[-1])
                yield pd.DataFrame({row: f[row], "label": _nearest(x, centres), vec: f[vec]})

        return rows.mapInPandas(assign, f"{row} {kind}, label int, {vec} array<double>")

    for _ in range(iterations):
        sums = labelled(centroids).select("label", F.posexplode(vec).alias("i", "v")).groupBy("label", "i").agg(F.avg("v").alias("v")).collect()  # k x dimensions
        for r in sums:
            centroids[r["label"], r["i"]] = r["v"]
    labels = labelled(centroids)
    table = df.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], f"label int, {vec} array<double>")
    sizes = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return labels.select(row, "label"), table.join(sizes, "label", "left").fillna(0, "n")


def unit_palettes(df: DataFrame, by: list[str], vec: str, k: int, iterations: int = 10, row: str = "record_no") -> tuple[DataFrame, DataFrame]:
    """A palette for each unit, as ``kmeans_palette`` of its rows: labels (unit, row, label) and centroids (unit, label, vec, n).

    ``pack_units`` bounds the rows of a unit, so a task holds one unit's vectors; units are worked on side by side.
    """
    kinds = dict(df.dtypes)
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, row)) + f", label int, `{vec}` array<double>, n long"

    def fit(table: pa.Table) -> pa.Table:
        table = table.sort_by(row)
        x = np.array(table[vec].to_pylist(), dtype=float)
        centres = x[:k].copy()
        for _ in range(iterations):
            label = _nearest(x, centres)
            size = np.bincount(label, minlength=len(centres))
            for i in range(x.shape[1]):
                total = np.bincount(label, x[:, i], len(centres))
                centres[:, i] = np.where(size > 0, total / np.maximum(size, 1), centres[:, i])
        label = _nearest(x, centres)
        n, c = len(x), len(centres)
        unit = [pa.array([table[b][0].as_py()] * (n + c), table.schema.field(b).type) for b in by]
        rows = pa.concat_arrays([table[row].combine_chunks(), pa.nulls(c, table.schema.field(row).type)])
        vectors = pa.array([None] * n + centres.tolist(), pa.list_(pa.float64()))
        sizes = pa.array([None] * n + np.bincount(label, minlength=c).tolist(), pa.int64())
        return pa.Table.from_arrays([*unit, rows, pa.array(np.concatenate([label, np.arange(c, dtype=np.int32)])), vectors, sizes], [*by, row, "label", vec, "n"])

    found = persisted(df.select(*by, row, F.col(vec).cast("array<double>").alias(vec)).groupBy(*by).applyInArrow(fit, schema), "palettes")
    return found.where("n IS NULL").select(*by, row, "label"), found.where("n IS NOT NULL").select(*by, "label", vec, "n")


#: Entries of a palette, and least cells of the histogram that it is found on.
PALETTE, LEAST_CELLS = 256, 2048


def optimal_palette(values: np.ndarray, k: int = PALETTE) -> np.ndarray:
    """At most ``k`` centres that leave the least square error of all choices of cuts between cells.

    Cells are the distinct values, or the cells of a histogram where there are more; each knows its count and sum exactly. The
    bounds of k equal steps are bounds of cells, so the palette leaves no more error than they do. The best last cut of the first cells never moves back as cells are added, so a layer of the dynamic programme halves its ranges
    level by level, all of a level in one numpy step.
    """
    values = values[np.isfinite(values)]
    if not len(values):
        return np.zeros(0)
    steps = max(1, k - 1)
    cells = steps * 2 * -(-LEAST_CELLS // (2 * steps))
    distinct, number = np.unique(values, return_inverse=True)
    if len(distinct) > cells:
        low, high = distinct[0], distinct[-1]
        number = np.minimum(((values - low) * (cells / (high - low))).astype(np.int64), cells - 1)
        number = np.unique(number, return_inverse=True)[1]
    count = np.bincount(number).astype(float)
    middle = np.median(distinct)
    total, square = np.bincount(number, values - middle), np.bincount(number, (values - middle) ** 2)
    if len(count) <= k:
        return total / count + middle
    c, t, s = (np.concatenate([[0.0], np.cumsum(v)]) for v in (count, total, square))
    error = lambda i, j: s[j] - s[i] - (t[j] - t[i]) ** 2 / np.maximum(c[j] - c[i], 1)  # noqa: E731  of cells i .. j - 1
    n = len(count)
    cost, cuts = error(np.zeros(n + 1, np.int64), np.arange(n + 1)), []
    for layer in range(1, k):
        now, cut = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=np.int64)
        low, high, first, last = (np.array([v]) for v in (layer + 1, n, layer, n))  # ranges of ends, and of their best cuts
        while len(low):
            mid = (low + high) // 2
            top = np.minimum(last, mid - 1)
            size = np.maximum(top - first + 1, 1)
            begin = np.cumsum(size) - size
            at = np.repeat(first - begin, size) + np.arange(int(size.sum()))
            price = cost[at] + error(at, np.repeat(mid, size))
            now[mid] = np.minimum.reduceat(price, begin)
            hit = np.flatnonzero(price == np.repeat(now[mid], size))
            cut[mid] = at[hit[np.searchsorted(hit, begin)]]
            left, right = low <= mid - 1, mid + 1 <= high
            low, high, first, last = (np.concatenate(v) for v in ((low[left], mid[right] + 1), (mid[left] - 1, high[right]), (first[left], cut[mid][right]), (cut[mid][left], last[right])))
        cost = now
        cuts.append(cut)
    bounds = [n]
    for cut in reversed(cuts):
        bounds.append(int(cut[bounds[-1]]))
    edges = np.array([0, *bounds[::-1]])
    return (t[edges[1:]] - t[edges[:-1]]) / (c[edges[1:]] - c[edges[:-1]]) + middle


#: Columns that share a palette.
SHARED = {"scale": SCALES, "colour": COLOUR}


def attribute_palettes(df: DataFrame, by: list[str], groups: dict[str, list[str]] | None = None, k: int = PALETTE, row: str = "record_no") -> tuple[DataFrame, DataFrame]:
    """Palettes of a unit for its scales and its colours, each the best for all columns of its group together.

    Returns labels (unit, row, p_<column>; null for values that are no numbers) and palettes (unit, name, label, centre, n).
    ``pack_units`` bounds the rows of a unit; units are worked on side by side.
    """
    groups = {name: [c for c in columns if c in df.columns] for name, columns in (groups or SHARED).items()}
    kinds, columns = dict(df.dtypes), [c for held in groups.values() for c in held]
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*by, row)) + "".join(f", `p_{c}` int" for c in columns) + ", name string, label int, centre double, n long"

    def fit(table: pa.Table) -> pa.Table:
        labels, rows = {}, []
        for name, held in groups.items():
            x = np.column_stack([table[c].to_numpy().astype(float) for c in held])
            centres = optimal_palette(x.ravel(), k)
            good = np.isfinite(x)
            label = np.searchsorted((centres[1:] + centres[:-1]) / 2, np.where(good, x, 0.0), side="right") if len(centres) else np.zeros(x.shape, np.int64)
            size = np.bincount(label[good], minlength=len(centres))
            rows += [(name, i, float(v), int(size[i])) for i, v in enumerate(centres)]
            for i, c in enumerate(held):
                labels[c] = pa.array(label[:, i].astype(np.int32), mask=~good[:, i])
        n, m = table.num_rows, len(rows)
        unit = [pa.array([table[b][0].as_py()] * (n + m), table.schema.field(b).type) for b in by]
        blank = lambda kind, many: pa.nulls(many, kind)
        own = [pa.concat_arrays([table[row].combine_chunks(), blank(table.schema.field(row).type, m)]), *(pa.concat_arrays([labels[c], blank(pa.int32(), m)]) for c in columns)]
        named = [pa.concat_arrays([blank(t, n), pa.array([r[i] for r in rows], t)]) for i, t in enumerate((pa.string(), pa.int32(), pa.float64(), pa.int64()))]
        return pa.Table.from_arrays([*unit, *own, *named], [*by, row, *(f"p_{c}" for c in columns), "name", "label", "centre", "n"])

    found = persisted(df.select(*by, row, *columns).groupBy(*by).applyInArrow(fit, schema), "palettes")
    return found.where("name IS NULL").select(*by, row, *(f"p_{c}" for c in columns)), found.where("name IS NOT NULL").select(*by, "name", "label", "centre", "n")


def palette_error(df: DataFrame, by: list[str], labels: DataFrame, palettes: DataFrame, groups: dict[str, list[str]] | None = None, row: str = "record_no") -> DataFrame:
    """Per unit and palette: root mean square error of its palette (rmse) and of PALETTE equal steps over the same values (rmse_steps)."""
    groups = {name: [c for c in columns if c in df.columns] for name, columns in (groups or SHARED).items()}
    parts = [F.struct(F.lit(name).alias("name"), F.lit(c).alias("column"), F.col(c).cast("double").alias("v"), F.col(f"p_{c}").alias("label")) for name, held in groups.items() for c in held]
    long = df.join(labels, [*by, row]).select(*by, F.explode(F.array(*parts)).alias("x")).select(*by, "x.*").where(finite(F.col("v")))
    ends = long.groupBy(*by, "name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    step = (F.col("hi") - F.col("lo")) / (PALETTE - 1)
    stepped = F.when(step > 0, F.col("lo") + S.nearest((F.col("v") - F.col("lo")) / step) * step).otherwise(F.col("lo"))
    all_ = long.join(palettes.select(*by, "name", "label", "centre"), [*by, "name", "label"]).join(ends, [*by, "name"])
    root = lambda e: F.sqrt(F.avg(F.pow(F.col("v") - e, 2)))
    return all_.groupBy(*by, "name").agg(F.count(F.lit(1)).alias("n"), root(F.col("centre")).alias("rmse"), root(stepped).alias("rmse_steps"))


BYTES = [*SCALES, *COLOUR, "opacity"]


def quantize_attributes(df: DataFrame, by: list[str]) -> DataFrame:
    """Scale, colour and opacity of a unit as bytes of 255 equal steps (b_<name>, bounds lo_/hi_<name>), and the quaternion
    as its three smaller parts in bytes (b_rot_0..2, in order) and the index of the greatest (b_rot_at)."""
    names = [c for c in BYTES if c in df.columns]
    bounds = df.groupBy(*by).agg(*(f(c).alias(f"{k}_{c}") for c in names for k, f in (("lo", F.min), ("hi", F.max))))
    out = df.join(persisted(bounds, "bounds"), by)
    for c in names:
        extent = F.col(f"hi_{c}") - F.col(f"lo_{c}")
        out = out.withColumn(f"b_{c}", F.when(extent > 0, S.nearest((F.col(c) - F.col(f"lo_{c}")) / extent * 255)).otherwise(0).cast("int"))
    size = F.sqrt(sum((F.col(q) * F.col(q) for q in QUATERNION[1:]), F.col("rot_0") * F.col("rot_0")))
    parts = F.array(*(F.col(q) / size for q in QUATERNION))
    at = F.array_position(F.transform(parts, F.abs), F.array_max(F.transform(parts, F.abs))).cast("int") - 1
    out = out.withColumn("__q", parts).withColumn("b_rot_at", at)
    rest = F.filter("__q", lambda _, i: i != F.col("b_rot_at"))
    sign = F.when(F.get("__q", "b_rot_at") < 0, -1.0).otherwise(1.0)
    for i in range(3):
        out = out.withColumn(f"b_rot_{i}", S.nearest((F.get(rest, i) * sign * F.lit(2**0.5) + 1) / 2 * 255).cast("int"))
    return out.drop("__q")


def dequantize_attributes(df: DataFrame) -> DataFrame:
    """d_<name> for each quantised attribute, within half a step; quaternions of unit length with the greatest part positive."""
    out = df
    for c in (c for c in BYTES if f"b_{c}" in df.columns):
        out = out.withColumn(f"d_{c}", F.col(f"lo_{c}") + F.col(f"b_{c}") / 255 * (F.col(f"hi_{c}") - F.col(f"lo_{c}")))
    small = [(F.col(f"b_rot_{i}") / 255 * 2 - 1) / F.lit(2**0.5) for i in range(3)]
    great = F.sqrt(F.greatest(F.lit(0.0), 1 - sum((v * v for v in small[1:]), small[0] * small[0])))
    for i in range(4):
        before = small[i - 1] if i else F.lit(None).cast("double")
        after = small[i] if i < 3 else F.lit(None).cast("double")
        out = out.withColumn(f"d_rot_{i}", F.when(F.col("b_rot_at") == i, great).when(F.col("b_rot_at") < i, before).otherwise(after))
    return out
