"""Splat clouds: filters, samples, k-d tiles, Z-order, transforms. Frames carry scene_id and record_no."""

from __future__ import annotations

import hashlib
import io
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from lodestrata.functions import scalars as S
from lodestrata.sources.files import located
from lodestrata.sources.tables import persisted, shared_path, tasks_for

POSITION = ["x", "y", "z"]
COLUMNS = ["x", "y", "z", "f_dc_0", "f_dc_1", "f_dc_2", "f_rest", "opacity", "scale_0", "scale_1", "scale_2", "rot_0", "rot_1", "rot_2", "rot_3"]
#: Coefficients that a colour channel keeps, by number of bands.
BAND_SIZES = [0, 3, 8, 15]


def keep_splat_columns(df: DataFrame) -> DataFrame:
    """Keys and standard columns in canonical order; everything else is dropped."""
    return df.select(*[c for c in ("scene_id", "record_no", *COLUMNS) if c in df.columns])


def number_records(df: DataFrame, order: list[str], by: str = "scene_id") -> DataFrame:
    """``df`` with ``record_no``: the place of a row in its group from 0, by columns that tell the group's rows apart.

    Rows are dealt by ranges of group and order, sorted within a range and written down with their places there. A range's
    numbers go on where those of the group's ranges before it end, so no task sorts a group however large it is.
    """
    rows = df.repartitionByRange(tasks_for(df), by, *order).sortWithinPartitions(by, *order)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))  # within the task
    rows = persisted(rows.withColumn("__range", F.spark_partition_id()).withColumn("__place", place), "numbered")
    runs = rows.groupBy(by, "__range").agg(F.min("__place").alias("__first"), F.count(F.lit(1)).alias("__rows"))
    before = F.sum("__rows").over(Window.partitionBy(by).orderBy("__range")) - F.col("__rows")
    starts = persisted(runs.select(by, "__range", (before - F.col("__first")).alias("__shift")), "starts")
    numbered = _beside(rows, starts, [by, "__range"]).withColumn("record_no", F.col("__place") + F.col("__shift"))
    return numbered.drop("__range", "__place", "__shift")


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))


def filter_finite(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Rows whose numeric columns are all finite."""
    names = columns or [c for c, t in df.dtypes if t in ("float", "double")]
    checks = [finite(F.col(c)) for c in names]
    checks += [F.forall(c, lambda v: ~F.isnan(v) & (F.abs(v) < float("inf"))) for c, t in df.dtypes if t in ("array<float>", "array<double>") and columns is None]
    return df.where(reduce(lambda a, b: a & b, checks)) if checks else df


def filter_bands(df: DataFrame, bands: int, column: str = "f_rest", stored: int = 3) -> DataFrame:
    """The first ``bands`` SH bands of each of the three colour channels."""
    size, keep = BAND_SIZES[stored], BAND_SIZES[bands]
    parts = [F.slice(column, c * size + 1, keep) for c in range(3)] if keep else [F.slice(column, 1, 0)]
    return df.withColumn(column, F.concat(*parts))


def _block_plan(df: DataFrame, blocks: Column, per_block: Column) -> DataFrame:
    """First record, length and number of each block, by scene; both columns may use the scene's rows ``n``."""
    n = df.groupBy("scene_id").agg((F.max("record_no") + 1).alias("n"))
    n = n.withColumn("blocks", blocks.cast("long")).withColumn("per_block", F.least(per_block, F.col("n")).cast("long"))
    n = n.select("scene_id", "n", "blocks", "per_block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    return n.withColumn("begin", F.floor(F.col("block") / F.col("blocks") * F.greatest(F.lit(0), F.col("n") - F.col("per_block"))))


def _in_blocks(df: DataFrame, plan: DataFrame, block_records: int) -> DataFrame:
    """Rows of the blocks, once per block that covers them: an equi-join on a coarse cell of the record number."""
    cell = lambda c: F.floor(c / block_records)
    plan = plan.withColumn("__cell", F.explode(F.sequence(cell(F.col("begin")), cell(F.col("begin") + F.col("per_block") - 1))))
    plan = persisted(plan.select(F.col("scene_id").alias("__scene"), "__cell", "block", "begin", "per_block"), "blocks")
    near = (df["scene_id"] == plan["__scene"]) & (cell(df["record_no"]) == plan["__cell"])
    inside = (df["record_no"] >= plan["begin"]) & (df["record_no"] < plan["begin"] + plan["per_block"])
    return df.join(plan, near & inside).drop("__scene", "__cell", "begin", "per_block")


def block_sample(df: DataFrame, blocks: int = 2048, block_records: int = 1024) -> DataFrame:
    """Evenly spread blocks of consecutive records with finite positions; a row in two blocks counts twice."""
    count = F.greatest(F.lit(1), F.least(F.lit(blocks), F.ceil(F.col("n") / block_records)))
    return filter_finite(_in_blocks(df, _block_plan(df, count, F.lit(block_records)), block_records), POSITION)


def preview_sample(df: DataFrame, target: int = 400_000) -> DataFrame:
    """The first ``target`` visible rows of about three times as many, with byte colours."""
    blocks = F.least(F.lit(1024), F.greatest(F.lit(16), F.ceil(F.col("n") / 50_000)))
    plan = _block_plan(df, blocks, F.ceil(F.lit(3 * target) / F.col("blocks")))
    width = max(1, -(-3 * target // 1024))
    rows = filter_finite(_in_blocks(df, plan, width), POSITION).where(S.decode_opacity(F.col("opacity")) >= 0.35)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy("scene_id").orderBy("block", "record_no"))).where(F.col("__r") <= target).drop("__r")
    return rows.select("scene_id", "record_no", "block", *POSITION, *(S.decode_color(F.col(f"f_dc_{i}")).alias(c) for i, c in enumerate("rgb")))


def strided_sample(df: DataFrame, points: int = 20_000) -> DataFrame:
    """Every floor(n / points)-th row of a scene."""
    n = df.groupBy(F.col("scene_id").alias("__scene")).agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / points)).alias("__step"))
    n = persisted(n, "steps")
    return df.join(n, F.col("scene_id") == F.col("__scene")).where(F.col("record_no") % F.col("__step") == 0).drop("__scene", "__step")


#: Steps of the approximate quantiles that bracket an exact one, and their accuracy (ranks are off by a part of this at most).
STEPS, ACCURACY = 256, 10_000


def quantiles(df: DataFrame, wanted: dict[str, list[float]], by: list[str] | None = None) -> DataFrame:
    """The elements at floor(q * (n - 1)) of the sorted values of several columns: group, column, q, value (as double).

    Nulls sort first and NaN last. Approximate quantiles bracket the exact ones; only the few rows between the brackets
    are counted by value and ranked, and those below are counted, so no task sorts a group however large it is.
    """
    by = by or ["scene_id"]
    pairs = [(c, q) for c, qs in wanted.items() for q in qs]
    number = {c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")) for c in wanted}
    grid = F.array(*(F.lit(i / STEPS) for i in range(STEPS + 1)))
    facts = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__n"),
        *(F.count_if(F.col(c).isNull()).alias(f"__null{i}") for i, c in enumerate(wanted)), *(F.count(number[c]).alias(f"__some{i}") for i, c in enumerate(wanted)),
        *(F.percentile_approx(number[c], grid, ACCURACY).alias(f"__grid{i}") for i, c in enumerate(wanted)),
    )
    edges = []
    for k, (c, q) in enumerate(pairs):
        i = list(wanted).index(c)
        rank = F.floor(F.lit(q) * (F.col("__n") - 1)) - F.col(f"__null{i}")  # among the numbers, from 0
        step = F.floor(rank * STEPS / F.nullif(F.col(f"__some{i}"), F.lit(0))).cast("int")
        low = F.when(step > 2, F.get(f"__grid{i}", step - 2)).otherwise(float("-inf"))
        high = F.when(step < STEPS - 2, F.get(f"__grid{i}", step + 3)).otherwise(float("inf"))
        kind = F.when(rank < 0, F.lit(None).cast("double")).when(rank >= F.col(f"__some{i}"), float("nan"))
        edges.append(F.struct(F.lit(k).alias("k"), F.lit(c).alias("column"), F.lit(q).alias("q"), low.alias("low"), high.alias("high"), rank.alias("rank"), kind.alias("kind"), ((rank < 0) | (rank >= F.col(f"__some{i}"))).alias("known")))
    facts = persisted(facts.select(*by, F.array(*edges).alias("__edges")), "quantiles")
    keys = [F.col(c).alias(f"__by{i}") for i, c in enumerate(by)]
    near = df.select(*keys, *(number[c].alias(f"__v{i}") for i, c in enumerate(wanted)))
    same = reduce(lambda x, y: x & y, (F.col(f"__by{i}").eqNullSafe(facts[c]) for i, c in enumerate(by)))
    near = near.join(facts, same)
    value = [F.col(f"__v{list(wanted).index(c)}") for c, _ in pairs]
    edge = [F.get("__edges", F.lit(k)) for k in range(len(pairs))]
    below = near.groupBy(*by).agg(F.array(*(F.count_if(v < e["low"]) for v, e in zip(value, edge, strict=True))).alias("__below"))
    hit = F.filter(F.array(*(F.when((v >= e["low"]) & (v <= e["high"]), F.struct(F.lit(k).alias("k"), v.alias("v"))) for k, (v, e) in enumerate(zip(value, edge, strict=True)))), lambda x: x.isNotNull())
    counted = near.select(*by, F.explode(hit).alias("x")).groupBy(*by, F.col("x.k").alias("k"), F.col("x.v").alias("value")).agg(F.count(F.lit(1)).alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*by, "k").orderBy("value"))
    counted = counted.withColumn("__upto", upto)
    every = facts.select(*by, F.explode("__edges").alias("e")).select(*by, "e.*")
    every = _beside(every, below, by).withColumn("__left", F.col("rank") - F.get("__below", F.col("k")))
    found = _beside(counted.withColumnRenamed("k", "__k"), every, by).where((F.col("__k") == F.col("k")) & ~F.col("known") & (F.col("__left") < F.col("__upto")) & (F.col("__left") >= F.col("__upto") - F.col("c")))
    return found.select(*by, "column", "q", "value").unionByName(every.where("known").select(*by, "column", "q", F.col("kind").alias("value")))


def _beside(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Join of two tables on the group, where null is a group of its own."""
    renamed = b.select(*(F.col(c).alias(f"__{c}_") for c in by), *(c for c in b.columns if c not in by))
    return a.join(renamed, reduce(lambda x, y: x & y, (F.col(c).eqNullSafe(F.col(f"__{c}_")) for c in by))).drop(*(f"__{c}_" for c in by))


def quantile_at(df: DataFrame, column: str, q: float, by: list[str] | None = None) -> DataFrame:
    """The element at floor(q * (n - 1)) of the sorted values, by group, as ``value``."""
    return quantiles(df, {column: [q]}, by).drop("column", "q")


def plan_kd_tiles(sample: DataFrame, totals: DataFrame, max_per_tile: int, max_depth: int = 40) -> DataFrame:
    """kd_node: scene_id, path (L and R), axis (-1: leaf), split, ties_left, tile, est.

    A node splits its widest axis at the element in the middle; equal elements go right, or left where the right side
    would get all. The sample of a scene is bounded by the parameters of ``block_sample`` (48 MB at its defaults), so
    one task plans a scene; scenes are planned side by side.
    """
    kind = dict(sample.dtypes)["scene_id"]
    points = sample.select("scene_id", *(F.col(a).cast("double").alias(a) for a in POSITION)).join(totals.select("scene_id", "n"), "scene_id")
    schema = f"scene_id {kind}, path string, axis int, split double, ties_left boolean, tile int, est long"

    def plan(table: pa.Table) -> pa.Table:
        xyz = np.column_stack([table[a].to_numpy() for a in POSITION])
        scale = table["n"][0].as_py() / len(xyz)
        rows, leaves = [], 0
        waiting = [("", np.arange(len(xyz)))]
        while waiting:  # depth first, left before right
            path, some = waiting.pop()
            held = xyz[some]
            extent = held.max(axis=0) - held.min(axis=0)
            axis, share = int(extent.argmax()), len(some) * scale
            split = None
            if share > max_per_tile and len(some) > 1 and len(path) <= max_depth and extent[axis] > 0:
                v = held[:, axis]
                split = float(np.partition(v, len(v) // 2)[len(v) // 2])
                ties_left = not (v < split).any()
                left = v <= split if ties_left else v < split
                if left.all():
                    split = None
            if split is None:
                rows.append((path, -1, None, None, leaves, math.floor(share + 0.5)))
                leaves += 1
            else:
                rows.append((path, axis, split, ties_left, None, math.floor(share + 0.5)))
                waiting += [(path + "R", some[~left]), (path + "L", some[left])]
        path, axis, split, ties, tile, est = zip(*rows, strict=True)
        columns = [pa.array([table["scene_id"][0].as_py()] * len(rows), table.schema.field("scene_id").type), pa.array(path), pa.array(axis, pa.int32()), pa.array(split, pa.float64()), pa.array(ties, pa.bool_()), pa.array(tile, pa.int32()), pa.array(est, pa.int64())]
        return pa.Table.from_arrays(columns, ["scene_id", "path", "axis", "split", "ties_left", "tile", "est"])

    return points.groupBy("scene_id").applyInArrow(plan, schema)


#: Columns of a flattened tree: by node the split axis (-1: leaf), the split, whether equal values go left, children, tile.
TREE = {"axis": np.int8, "split": np.float64, "ties": np.bool_, "left": np.int32, "right": np.int32, "tile": np.int32}


def flatten_tree(nodes: pa.Table) -> dict[str, np.ndarray]:
    """The tree of a scene (path, axis, split, ties_left, tile) as arrays; node 0 is the root, children point at nodes."""
    path = nodes["path"].to_pylist()
    order = sorted(range(len(path)), key=path.__getitem__)
    number = {path[k]: i for i, k in enumerate(order)}
    take = lambda name, empty: nodes[name].fill_null(empty).to_numpy()[order]
    child = lambda side: [number.get(path[k] + side, -1) for k in order]
    columns = take("axis", -1), take("split", 0.0), take("ties_left", False), child("L"), child("R"), take("tile", -1)
    return {name: np.asarray(c, dtype=kind) for (name, kind), c in zip(TREE.items(), columns, strict=True)}


def descend(tree: dict[str, np.ndarray], xyz: np.ndarray) -> np.ndarray:
    """The tile of each row of a batch: all rows go down one level at a time. NaN goes right; -1 where the tree ends early."""
    at, row = np.zeros(len(xyz), dtype=np.int32), np.arange(len(xyz))
    while len(row):
        node = at[row]
        axis = tree["axis"][node]
        row, node, axis = (v[axis >= 0] for v in (row, node, axis))
        v, split = xyz[row, axis], tree["split"][node]
        left = (v < split) | (tree["ties"][node] & (v == split))
        at[row] = np.where(left, tree["left"][node], tree["right"][node])
        row = row[at[row] >= 0]
    return np.where(at >= 0, tree["tile"][at], -1)


def _tree_name(scene: object) -> str:
    return hashlib.sha256(f"{type(scene).__name__}:{scene}".encode()).hexdigest()


def write_trees(nodes: DataFrame) -> str:
    """Write each scene's flattened tree as one file in the shared folder; returns the folder. Scenes are written side by side."""
    folder = shared_path(nodes.sparkSession, "trees")

    def write(table: pa.Table) -> pa.Table:
        fs, inside = located(folder)
        fs.create_dir(inside, recursive=True)
        body, name = io.BytesIO(), _tree_name(table["scene_id"][0].as_py())
        np.savez(body, **flatten_tree(table))
        own = f"{inside}/.{uuid.uuid4().hex}"  # a task that runs twice moves the same tree either time
        with fs.open_output_stream(own) as out:
            out.write(body.getvalue())
        fs.move(own, f"{inside}/{name}")
        return pa.table({"n": pa.array([table.num_rows])})

    nodes.select("scene_id", "path", "axis", "split", "ties_left", "tile").groupBy("scene_id").applyInArrow(write, "n long").agg(F.sum("n")).first()
    return folder


#: Trees that a task keeps at hand.
TREES_HELD = 64


def assign_tile(df: DataFrame, nodes: DataFrame) -> DataFrame:
    """``df`` with its tile: below the split left, else right (NaN and null go right); null for a scene without a tree.

    Trees are written once as arrays and read by the tasks that meet their scene; a whole Arrow batch of positions goes down
    a tree at once. No row is joined or moved, and the plan holds one function, however many leaves there are.
    """
    folder = write_trees(nodes)

    @F.pandas_udf("int")
    def tile(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        fs, inside = located(folder)
        held: dict[str, dict[str, np.ndarray] | None] = {}

        def tree(scene: object) -> dict[str, np.ndarray] | None:
            name = _tree_name(scene)
            if name not in held:
                while len(held) >= TREES_HELD:
                    del held[next(iter(held))]
                held[name] = None
                if fs.get_file_info(f"{inside}/{name}").is_file:
                    with fs.open_input_file(f"{inside}/{name}") as file:
                        held[name] = dict(np.load(io.BytesIO(file.read())))
            return held[name]

        for scene, *axes in batches:
            xyz = np.column_stack([a.to_numpy(dtype=float, na_value=np.nan) for a in axes])
            out, (number, kinds) = np.full(len(xyz), -1, dtype=np.int32), pd.factorize(scene)
            order = np.argsort(number, kind="stable")
            cuts = np.searchsorted(number[order], np.arange(len(kinds) + 1))
            for k, kind in enumerate(kinds):
                found = tree(kind.item() if isinstance(kind, np.generic) else kind)
                if found is not None:
                    some = order[cuts[k] : cuts[k + 1]]
                    out[some] = descend(found, xyz[some])
            yield pd.Series(out, dtype="Int32").mask(out < 0)

    return df.withColumn("tile", tile("scene_id", *POSITION))


def tile_filter(df: DataFrame, tiles: list[int]) -> DataFrame:
    return df.where(F.col("tile").isin(tiles))


def reconcile_tiles(tiled: DataFrame, totals: DataFrame) -> DataFrame:
    """scene_id, n: the rows that have a tile, which must be as many as ``totals`` (scene_id, n) declares; else an error."""
    have = tiled.where("tile IS NOT NULL").groupBy("scene_id").agg(F.count(F.lit(1)).alias("n"))
    both = have.join(totals.select("scene_id", F.col("n").alias("declared")), "scene_id", "full_outer")
    odd = F.raise_error(F.concat_ws(" ", F.lit("rows with a tile and declared rows differ in scene"), F.col("scene_id").cast("string"), F.col("n").cast("string"), F.col("declared").cast("string")))
    return both.select("scene_id", F.when(F.col("n").eqNullSafe(F.col("declared")), F.col("n")).otherwise(odd).alias("n"))


def repartition_by_tile(df: DataFrame, *more: str) -> DataFrame:
    """Each tile's rows together. A scene with one tile too large is for a finer plan, not for a larger task."""
    return df.repartition("scene_id", "tile", *more)


# Shifts and masks that put two zero bits after each of ten bits.
SPREAD = ((16, 0x030000FF), (8, 0x0300F00F), (4, 0x030C30C3), (2, 0x09249249))


def _spread(v: Column) -> Column:
    """Ten bits with two zero bits after each."""
    for shift, mask in SPREAD:
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def morton_code(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """30-bit Z-order code of positions within each group's bounds of finite values; 0 where there is no extent.

    Bounds come from windows over the groups, which a plan keeps to a tile's size: rows are dealt by group once, and ranks
    and merging inside the groups need no other exchange.
    """
    by = by or ["scene_id", "tile"]
    whole = Window.partitionBy(*by)
    good = {a: F.when(finite(F.col(a)), F.col(a)) for a in POSITION}
    out = df.withColumns({f"__{k}{a}": f(good[a]).over(whole) for a in POSITION for k, f in (("lo", F.min), ("hi", F.max))})
    code = F.lit(0)
    for i, a in enumerate(POSITION):
        extent = F.col(f"__hi{a}") - F.col(f"__lo{a}")
        cell = F.when((extent > 0) & finite(F.col(a)), F.floor((F.col(a) - F.col(f"__lo{a}")) * F.lit(1023.999) / extent)).otherwise(F.lit(0)).cast("int")
        code = code.bitwiseOR(F.shiftleft(_spread(cell), i))
    return out.withColumn("code", code).drop(*(f"__{k}{a}" for a in POSITION for k in ("lo", "hi")))


def zorder_rows(df: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Stable Z-order inside each group: ``rank`` from 0."""
    by = by or ["scene_id", "tile"]
    rank = F.row_number().over(Window.partitionBy(*by).orderBy("code", "record_no")) - 1
    return df.withColumn("rank", rank.cast("long"))


def _times(a: list[list[Column]], b: list[list[Column]]) -> list[list[Column]]:
    return [[sum((a[i][k] * b[k][j] for k in range(1, 3)), a[i][0] * b[0][j]) for j in range(3)] for i in range(3)]


def axis_turn(axis: int, degrees: Column) -> list[list[Column]]:
    """The 3x3 rotation about a coordinate axis."""
    c, s, p, q = F.cos(F.radians(degrees)), F.sin(F.radians(degrees)), (axis + 1) % 3, (axis + 2) % 3
    m = [[F.lit(float(i == j)) for j in range(3)] for i in range(3)]
    m[p][p], m[p][q], m[q][p], m[q][q] = c, -s, s, c
    return m


def view_matrix(ex: Column, ey: Column, ez: Column) -> list[list[Column]]:
    """The 3x3 rotation about x, then y, then z, all after a half turn about z."""
    turned = _times(_times(axis_turn(2, ez), axis_turn(1, ey)), axis_turn(0, ex))
    return [[row[0] * -1, row[1] * -1, row[2]] for row in turned]


def hamilton(a: list[Column], b: list[Column]) -> list[Column]:
    """The product of two quaternions, real part first."""
    dot = a[1] * b[1] + a[2] * b[2] + a[3] * b[3]
    cross = [a[1 + (i + 1) % 3] * b[1 + (i + 2) % 3] - a[1 + (i + 2) % 3] * b[1 + (i + 1) % 3] for i in range(3)]
    return [a[0] * b[0] - dot, *(a[0] * b[1 + i] + b[0] * a[1 + i] + cross[i] for i in range(3))]


def view_quaternion(angles: list[Column]) -> list[Column]:
    """The same rotation as a quaternion, real part first."""
    about = [[F.cos(F.radians(e) / 2), *(F.sin(F.radians(e) / 2) if i == axis else F.lit(0.0) for i in range(3))] for axis, e in enumerate(angles)]
    half = [F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)]
    return hamilton(hamilton(hamilton(about[2], about[1]), about[0]), half)


def sh_basis(d: np.ndarray) -> np.ndarray:
    """Real spherical harmonics of bands 1 to 3 at unit directions (n x 3), as splat files order and sign them."""
    x, y, z = d.T
    xx, yy, zz = x * x, y * y, z * z
    # Normalisation of each function.
    return np.column_stack([
        -0.4886025119 * y, 0.4886025119 * z, -0.4886025119 * x,
        1.0925484306 * x * y, -1.0925484306 * y * z, 0.3153915653 * (2 * zz - xx - yy), -1.0925484306 * x * z, 0.5462742153 * (xx - yy),
        -0.5900435899 * y * (3 * xx - yy), 2.8906114426 * x * y * z, -0.4570457995 * y * (4 * zz - xx - yy), 0.3731763326 * z * (2 * zz - 3 * xx - 3 * yy),
        -0.4570457995 * x * (4 * zz - xx - yy), 1.4453057213 * z * (xx - yy), -0.5900435899 * x * (xx - 3 * yy),
    ])


def sh_turn(m: np.ndarray) -> np.ndarray:
    """15 x 15: what the rotation ``m`` does to the coefficients of bands 1 to 3; bands do not mix."""
    d = np.random.default_rng(0).normal(size=(64, 3))
    d /= np.linalg.norm(d, axis=1, keepdims=True)
    before, after, out = sh_basis(d), sh_basis(d @ m), np.zeros((15, 15))
    for lo, hi in ((0, 3), (3, 8), (8, 15)):
        out[lo:hi, lo:hi] = np.linalg.lstsq(before[:, lo:hi], after[:, lo:hi], rcond=None)[0]
    return out


@F.pandas_udf(ArrayType(FloatType()))
def rotate_sh(rest: pd.Series, matrix: pd.Series) -> pd.Series:
    """f_rest (three channels of 3, 8 or 15 coefficients; other lengths and nulls stay) under a 3x3 rotation by rows."""
    out = rest.copy()
    turns = np.array([np.full(9, np.nan) if m is None else m for m in matrix], dtype=float).reshape(-1, 9)
    size = np.array([-1 if r is None else len(r) for r in rest])
    kinds, kind = np.unique(turns, axis=0, return_inverse=True)
    for k, m in enumerate(kinds):
        turn = sh_turn(m.reshape(3, 3)) if np.isfinite(m).all() else np.eye(15)
        for n in (9, 24, 45):
            some = np.flatnonzero((kind.ravel() == k) & (size == n))
            if len(some):
                held = np.array([rest.iloc[i] for i in some], dtype=float).reshape(len(some), 3, n // 3)
                out.iloc[some] = list((held @ turn[: n // 3, : n // 3].T).reshape(len(some), n).astype(np.float32))
    return out


def _turns(scenes: DataFrame) -> DataFrame:
    """scene_id, __m (nine numbers by rows), __q (four) and __t (three) of scenes; angles that are no numbers count as 0."""
    angle = [F.when(finite(F.get("rotation", i)), F.get("rotation", i).cast("double")).otherwise(0.0) for i in range(3)]
    matrix = F.array(*(v for row in view_matrix(*angle) for v in row))
    return persisted(scenes.select("scene_id", matrix.alias("__m"), F.array(*view_quaternion(angle)).alias("__q"), F.col("translation").alias("__t")), "turns")


def _moved() -> dict[str, Column]:
    return {a: sum((F.get("__m", 3 * i + j) * F.col(b) for j, b in enumerate(POSITION)), F.lit(0.0)) + F.get("__t", i) for i, a in enumerate(POSITION)}


def transform_positions(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """Positions rotated, then moved. scenes: scene_id, rotation (3 degrees), translation (3); angles that are no numbers count as 0."""
    return df.join(_turns(scenes), "scene_id").withColumns(_moved()).drop("__m", "__q", "__t")


def transform_splats(df: DataFrame, scenes: DataFrame) -> DataFrame:
    """Positions, quaternions (rot_0 is the real part) and spherical harmonics rotated, then positions moved."""
    turned = hamilton([F.get("__q", i) for i in range(4)], [F.col(f"rot_{i}") for i in range(4)])
    columns = _moved() | {f"rot_{i}": q for i, q in enumerate(turned)}
    if "f_rest" in df.columns:
        columns["f_rest"] = rotate_sh(F.col("f_rest").cast("array<float>"), F.col("__m"))
    return df.join(_turns(scenes), "scene_id").withColumns(columns).drop("__m", "__q", "__t")


def covariance3(df: DataFrame) -> DataFrame:
    """Means and scatter sums of (-x, -y, z) by scene."""
    e = {"x": -F.col("x"), "y": -F.col("y"), "z": F.col("z")}
    pairs = [("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")]
    return df.groupBy("scene_id").agg(
        F.count(F.lit(1)).alias("n"), *(F.avg(e[a]).alias(f"mean_{a}") for a in POSITION),
        *((F.covar_pop(e[a], e[b]) * F.count(F.lit(1))).alias(f"c_{a}{b}") for a, b in pairs),
    )


def histogram_peaks(df: DataFrame, edges: DataFrame, columns: list[str], bins: int = 200) -> DataFrame:
    """edges (scene_id, column, lo, hi) -> scene_id, column, peak, left, right of smoothed histograms, all in one pass."""
    edges = edges.where(F.col("lo").isNotNull()).withColumn("w", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0))
    edges = persisted(edges.select("scene_id", "column", "lo", "w"), "edges")
    long = df.select("scene_id", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x")).select("scene_id", "x.column", "x.v")
    counted = long.join(edges, ["scene_id", "column"]).select("scene_id", "column", F.floor((F.col("v") - F.col("lo")) / F.col("w")).alias("bin"))
    counted = counted.where(F.col("bin").between(0, bins - 1)).groupBy("scene_id", "column", "bin").agg(F.count(F.lit(1)).alias("h"))
    grid = edges.select("scene_id", "column", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("bin"))
    by = Window.partitionBy("scene_id", "column").orderBy("bin")
    smooth = grid.join(counted, ["scene_id", "column", "bin"], "left").withColumn("s", F.avg(F.coalesce("h", F.lit(0))).over(by.rowsBetween(-2, 2)))
    top = F.max(F.struct("s", (-F.col("bin")).alias("back"))).over(Window.partitionBy("scene_id", "column"))
    smooth = smooth.withColumn("peak", -top["back"]).withColumn("low", F.col("s") <= 0.1 * top["s"])
    return smooth.groupBy("scene_id", "column", "peak").agg(
        F.coalesce(F.max(F.when(F.col("low") & (F.col("bin") < F.col("peak")), F.col("bin"))), F.lit(0)).alias("left"),
        F.coalesce(F.min(F.when(F.col("low") & (F.col("bin") > F.col("peak")), F.col("bin"))), F.lit(bins - 1)).alias("right"),
    )


def _edges(found: DataFrame) -> DataFrame:
    """The 0.5 % and 99.5 % quantiles by scene and column."""
    of = lambda q: F.max(F.when(F.col("q") == q, F.col("value")))
    return found.groupBy("scene_id", "column").agg(of(0.005).alias("lo"), of(0.995).alias("hi"))


def histogram_peak(df: DataFrame, column: str, bins: int = 200) -> DataFrame:
    """Smoothed histogram between the 0.5 % and 99.5 % quantile: peak bin, and the bins where it falls to a tenth."""
    return histogram_peaks(df, _edges(quantiles(df, {column: [0.005, 0.995]})), [column], bins).drop("column")


def centre_translation(sample: DataFrame, scenes: DataFrame) -> DataFrame:
    """Shift that puts the middle at the origin and the ground at 0, after rotation; zeros under 10 points."""
    turned = transform_positions(sample, scenes.withColumn("translation", F.array(*[F.lit(0.0)] * 3)))
    found = quantiles(turned, {"x": [0.5], "y": [0.01], "z": [0.5]}).groupBy("scene_id").agg(*(F.max(F.when(F.col("column") == a, F.col("value"))).alias(f"t{a}") for a in POSITION))
    out = turned.groupBy("scene_id").agg(F.count(F.lit(1)).alias("n")).join(found, "scene_id")
    return out.select("scene_id", *(F.when(F.col("n") < 10, 0.0).otherwise(S.nearest(-F.col(f"t{a}") * 1000) / 1000).alias(f"t{a}") for a in POSITION))


# The turn (degrees about x, y, z) that puts an engine axis upright, by axis and the sign of its longer tail;
# how far the thinnest direction must be aligned with an axis, how thin it must be, and how many points are needed.
UPRIGHT = {(0, 1): (0, 0, 90), (0, -1): (0, 0, -90), (1, 1): (0, 0, 0), (1, -1): (180, 0, 0), (2, 1): (-90, 0, 0), (2, -1): (90, 0, 0)}
ALIGNED, THIN, ENOUGH = 0.85, 0.6, 100
_TAILS = (0.02, 0.5, 0.98)


def auto_orient(sample: DataFrame) -> DataFrame:
    """scene_id, euler, confident, up_axis: the thinnest axis, turned so that its longer tail points up.

    Sure only if the thinnest direction lies along an axis, is thin beside the next one, and the side of the histogram
    that falls more slowly is the one of the longer tail. '?' under ENOUGH points; only finite ones count.
    """
    scenes = sample.select(F.col("scene_id").alias("__scene")).distinct()
    sample = persisted(filter_finite(sample.select("scene_id", *POSITION), POSITION), "points")
    engine = sample.select("scene_id", (-F.col("x")).alias("e0"), (-F.col("y")).alias("e1"), F.col("z").cast("double").alias("e2"))
    axes = ["e0", "e1", "e2"]
    found = persisted(quantiles(engine, {a: [0.005, *_TAILS, 0.995] for a in axes}), "tails")
    of = lambda a, q: F.max(F.when((F.col("column") == a) & (F.col("q") == q), F.col("value")))
    reach = found.groupBy("scene_id").agg(F.array(*(of(a, 0.98) + of(a, 0.02) - 2 * of(a, 0.5) for a in axes)).alias("tail"))
    peaks = histogram_peaks(engine, _edges(found), axes)
    longer = lambda a: F.max(F.when(F.col("column") == a, F.col("right") + F.col("left") - 2 * F.col("peak")))
    falls = peaks.groupBy("scene_id").agg(F.array(*map(longer, axes)).alias("fall"))
    moments = ["c_xx", "c_xy", "c_xz", "c_xy", "c_yy", "c_yz", "c_xz", "c_yz", "c_zz"]
    facts = covariance3(sample).select("scene_id", "n", F.array(*moments).alias("scatter")).join(reach, "scene_id", "left").join(falls, "scene_id", "left")
    nothing = F.array(*[F.lit(0.0)] * 9)
    facts = scenes.join(facts, F.col("__scene").eqNullSafe(F.col("scene_id")), "left").select(
        F.col("__scene").alias("scene_id"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("scatter", nothing).alias("scatter"),
        *(F.coalesce(c, F.array(*[F.lit(0).cast(k)] * 3)).alias(c) for c, k in (("tail", "double"), ("fall", "long"))),
    )
    kind = dict(sample.dtypes)["scene_id"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            if not len(f):
                continue
            scatter = np.stack(f["scatter"]).reshape(-1, 3, 3).astype(float)
            broad = ~np.isfinite(scatter).all(axis=(1, 2))  # squares beyond a double
            few = (f["n"].to_numpy() < ENOUGH) | broad
            values, vectors = np.linalg.eigh(np.where(broad[:, None, None], 0.0, scatter))
            share = np.abs(vectors[:, :, 0])
            axis, row = share.argmax(axis=1), np.arange(len(f))
            tail = np.where(np.stack(f["tail"])[row, axis] >= 0, 1, -1)
            fall = np.where(np.stack(f["fall"])[row, axis] > 0, 1, -1)
            flat = np.maximum(values[:, 0], 0) < THIN**2 * np.maximum(values[:, 1], 1e-12)
            sure = (share[row, axis] > ALIGNED) & flat & (tail == fall) & ~few
            turn = [[0.0] * 3 if w else [float(e) for e in UPRIGHT[a, t]] for a, t, w in zip(axis.tolist(), tail.tolist(), few, strict=True)]
            upward = np.where(axis == 2, tail, -tail)  # x and y are mirrored in engine space
            name = ["?" if w else ("+" if u > 0 else "-") + "XYZ"[a] for a, u, w in zip(axis.tolist(), upward, few, strict=True)]
            yield pd.DataFrame({"scene_id": f["scene_id"], "euler": turn, "confident": sure, "up_axis": name})

    return facts.mapInPandas(solve, f"scene_id {kind}, euler array<double>, confident boolean, up_axis string")
