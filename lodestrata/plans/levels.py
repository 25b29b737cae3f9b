"""Level plans, cost model, presets and viewer floors; each is a projection over a table of scenes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.functions.scalars import nearest

MAX_LEVELS = 24
MIB = 1 << 20

# Presets in the order they are tried.
PRESET_COLUMNS = ["lod_ratio", "min_coarsest", "max_levels", "decimator", "sh_bands", "chunk_count", "chunk_extent", "chunk_min"]
PRESETS = [
    ("all", 0.5, 100_000, 0, "adaptive", -1, 256, 16, 16),
    ("aerial", 0.5, 100_000, 0, "adaptive", 0, 256, 32, 32),
    ("street", 0.5, 100_000, 0, "adaptive", -1, 256, 16, 8),
    ("interior", 0.5, 100_000, 0, "adaptive", -1, 256, 8, 4),
    ("object", 0.5, 100_000, 0, "uniform", -1, 256, 16, 8),
    ("light", 0.5, 50_000, 0, "adaptive", 0, 128, 16, 16),
    ("standard", 0.5, 1_000_000, 0, "uniform", -1, 512, 16, 8),
]
#: Rows that the weakest viewer aims at.
VIEWER_ROWS = 500_000


def plan_levels(scenes: DataFrame, ratio: float = 0.5, stop: int = 100_000, max_levels: int = 0) -> DataFrame:
    """scenes (scene_id, n) -> scene_id, lod, planned_n: shrinking until ``stop`` or the cap is reached."""
    cap = min(MAX_LEVELS, max_levels) if max_levels > 0 else MAX_LEVELS
    last = lambda levels: F.element_at(levels, -1)
    smaller = lambda levels: F.concat(levels, F.array(F.greatest(F.lit(1).cast("long"), nearest(last(levels) * F.lit(ratio)))))
    levels = F.array(F.col("n").cast("long"))
    if cap > 1:
        levels = F.aggregate(F.sequence(F.lit(2), F.lit(cap)), levels, lambda found, _: F.when(last(found) > stop, smaller(found)).otherwise(found))
    return scenes.select("scene_id", F.posexplode(levels).alias("lod", "planned_n"))


def cost_model(scenes: DataFrame, decimator: str = "adaptive", memory_bytes: int = 8 << 30, ratio: float = 0.5, stop: int = 100_000) -> DataFrame:
    """scenes (scene_id, n, kept_floats, sh_bands, stride) -> tiles, passes, seconds and output bytes to expect.

    Fixed values: 300 MB/s read, 7.5 us decimation and 6.7 us encoding per row, adaptive 2.4 times as slow.
    """
    work = F.col("kept_floats") * 8 + (130 if decimator == "adaptive" else 110) + 60
    tile = F.greatest(F.lit(1_000_000), F.least(F.lit(40_000_000), F.floor(F.lit(0.4 * memory_bytes) / work)))
    sums = plan_levels(scenes, ratio, stop).groupBy("scene_id").agg(F.sum("planned_n").alias("encoded"), F.max_by("planned_n", "lod").alias("coarsest"), F.count("*").alias("levels"))
    out = scenes.join(sums, "scene_id").withColumn("tile_rows", tile)
    out = out.withColumn("tiles", F.greatest(F.lit(1), F.ceil(F.col("n") / F.col("tile_rows"))))
    group = F.greatest(F.lit(0.35 * memory_bytes), F.col("tile_rows") * F.col("kept_floats") * 4 * 1.3)
    out = out.withColumn("passes", F.greatest(F.lit(1), F.ceil(F.col("n") * F.col("kept_floats") * 4 / group)))
    factor = 2.4 if decimator == "adaptive" else 1.0
    seconds = F.col("passes") * F.col("n") * F.col("stride") / 300e6 + (F.col("encoded") - F.col("coarsest")) * 7.5e-6 * factor + F.col("encoded") * 6.7e-6
    size = nearest(F.col("encoded") * (F.lit(12.2) + F.when(F.col("sh_bands") > 0, 4).otherwise(0)))
    return out.select("scene_id", "levels", "tile_rows", "tiles", "passes", F.round(seconds, 6).alias("seconds"), size.alias("output_bytes"))


def match_preset(settings: DataFrame) -> DataFrame:
    """settings with a column preset: the first that fits exactly, else 'custom'."""
    kinds = "double, long, int, string, int, int, int, int".split(", ")
    table = settings.sparkSession.createDataFrame(PRESETS, "preset string, " + ", ".join(f"{c} {k}" for c, k in zip(PRESET_COLUMNS, kinds, strict=True)))
    return settings.join(F.broadcast(table), PRESET_COLUMNS, "left").withColumn("preset", F.coalesce("preset", F.lit("custom")))


def viewer_floor(levels: DataFrame) -> DataFrame:
    """levels (scene_id, lod, planned_n) -> coarsest rows, their share of a viewer's budget in percent, warning."""
    floor = levels.groupBy("scene_id").agg(F.max_by("planned_n", "lod").alias("floor_rows"))
    return floor.select("scene_id", "floor_rows", nearest(F.col("floor_rows") / VIEWER_ROWS * 100).alias("floor_percent"), (F.col("floor_rows") > 0.25 * VIEWER_ROWS).alias("warn"))


def plan_warnings(costs: DataFrame, floors: DataFrame) -> DataFrame:
    """scene_id, warning: 'over10' where more than 10 GiB are to be expected, 'floor' where the coarsest level is over a quarter
    of a viewer's budget. costs as of ``cost_model``, floors as of ``viewer_floor``."""
    over = costs.where(F.col("output_bytes") > 10 << 30).select("scene_id", F.lit("over10").alias("warning"))
    return over.unionByName(floors.where("warn").select("scene_id", F.lit("floor").alias("warning")))
