"""Audits and comparisons: manifest rules, archive offsets, snapshot differences, log windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestrata.operators.cloud import quantiles

# Files that a unit may hold.
UNIT_FILES = ["meta.json", "means_l.webp", "means_u.webp", "scales.webp", "quats.webp", "sh0.webp", "shN_centroids.webp", "shN_labels.webp"]
#: From here on an archive needs its 64-bit form: an offset or size, and a number of entries.
WIDE, MANY = 0xFFFFFFFF, 0xFFFF
GIB, MILLION = 1 << 30, 1_000_000


def running_offsets(entries: DataFrame, by: str = "path") -> DataFrame:
    """entries (path, seq, name, size, maybe content) -> offset of each in its archive, duplicate and bad names, whether the entry
    (zip64) and the archive's directory (zip64_directory) need 64 bits, and the CRC of the content (crc)."""
    before = Window.partitionBy(by).orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(by)
    need = F.lit(30) + F.octet_length("name") + F.col("size")
    out = entries.withColumn("offset", F.sum(need).over(before) - need)
    out = out.withColumn("duplicate", F.count(F.lit(1)).over(Window.partitionBy(by, "name")) > 1)
    bad = (F.col("name") == "") | F.col("name").startswith("/") | F.col("name").contains("\\") | F.col("name").rlike("(^|/)\\.\\.(/|$)")
    out = out.withColumn("bad_name", bad).withColumn("zip64", (F.col("offset") >= WIDE) | (F.col("size") >= WIDE))
    out = out.withColumn("zip64_directory", (F.count(F.lit(1)).over(whole) >= MANY) | (F.sum(need).over(whole) >= WIDE))
    return out.withColumn("crc", F.crc32(F.col("content").cast("binary"))).drop("content") if "content" in entries.columns else out


def _found(rows: DataFrame, level: str, rule: str, subject, detail) -> DataFrame:
    return rows.select("scene_id", F.lit(level).alias("level"), F.lit(rule).alias("rule"), subject.cast("string").alias("subject"), detail.cast("string").alias("detail"))


def audit_manifest(manifest: DataFrame, leaves: DataFrame, units: DataFrame, entries: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """Findings: scene_id, level, rule, subject, detail.

    manifest (scene_id, version, count, counts, lod_levels), leaves (scene_id, lod, file, offset, n),
    units (scene_id, file, rows, files), entries (scene_id, name, size, maybe crc as stored and crc_found as counted),
    expected (scene_id, lod, n). Of a scene without its root manifest only that and unexpected names are found.
    """
    c = F.col
    out = []
    pattern = "\\A(lod-meta\\.json|[^/]+/(" + "|".join(f.replace(".", "\\.") for f in UNIT_FILES) + "))\\z"
    out.append(_found(entries.where(~c("name").rlike(pattern)), "error", "V1", c("name"), F.lit("unexpected name")))
    roots = entries.where("name = 'lod-meta.json'").select("scene_id").distinct()
    scenes = entries.select("scene_id").union(manifest.select("scene_id")).distinct()
    out.append(_found(scenes.join(roots, "scene_id", "left_anti"), "error", "V2", F.lit("lod-meta.json"), F.lit("missing")))
    out.append(_found(manifest.where("version <> 1"), "error", "V3", F.lit("version"), c("version")))
    out.append(_found(manifest.where(F.size("counts") != c("lod_levels")), "error", "V4", F.lit("counts"), F.size("counts")))
    total = F.aggregate("counts", F.lit(0).cast("long"), lambda a, b: a + b)
    out.append(_found(manifest.where(c("count") != total), "error", "V5", F.lit("count"), total))
    single = manifest.where("lod_levels = 1")
    out.append(_found(single.where(c("count") >= MILLION), "error", "V6", F.lit("levels"), c("count")))
    out.append(_found(single.where(c("count") < MILLION), "warning", "V6", F.lit("levels"), c("count")))
    counts = manifest.select("scene_id", F.posexplode("counts").alias("lod", "n"))
    before = F.lag("n").over(Window.partitionBy("scene_id").orderBy("lod"))
    out.append(_found(counts.withColumn("p", before).where("n >= p"), "error", "V7", c("lod"), c("n")))
    if expected is not None:
        pair = counts.join(expected.select("scene_id", "lod", c("n").alias("want")), ["scene_id", "lod"], "full_outer")
        out.append(_found(pair.where(~c("n").eqNullSafe(c("want"))), "error", "V8", c("lod"), c("want")))
    sums = leaves.groupBy("scene_id", "lod").agg(F.sum("n").alias("have"))
    pair = counts.join(sums, ["scene_id", "lod"], "full_outer")
    out.append(_found(pair.where(~c("n").eqNullSafe(c("have"))), "error", "V9", c("lod"), c("have")))
    named = leaves.select("scene_id", "file").distinct()
    out.append(_found(named.join(units, ["scene_id", "file"], "left_anti"), "error", "V10", c("file"), F.lit("unit missing")))
    listed = units.select("scene_id", "file", F.explode("files").alias("part")).withColumn("name", F.concat("file", F.lit("/"), "part"))
    out.append(_found(listed.join(entries, ["scene_id", "name"], "left_anti"), "error", "V11", c("name"), F.lit("file missing")))
    run = Window.partitionBy("scene_id", "file").orderBy("offset", "n").rowsBetween(Window.unboundedPreceding, 0)
    gaps = leaves.withColumn("due", F.sum("n").over(run) - c("n")).where("offset <> due").groupBy("scene_id", "file").agg(F.min("offset").alias("at"))
    out.append(_found(gaps, "error", "V12", c("file"), c("at")))
    referenced = leaves.groupBy("scene_id", "file").agg(F.sum("n").alias("n"))
    held = units.join(referenced, ["scene_id", "file"], "left").where(c("rows") != F.coalesce("n", F.lit(0)))
    out.append(_found(held, "error", "V13", c("file"), c("rows")))
    size = entries.groupBy("scene_id").agg(F.sum("size").alias("size"))
    out.append(_found(size.where(c("size") > 10 * GIB), "warning", "V14", F.lit("size"), c("size")))
    checked = running_offsets(entries.withColumn("seq", F.col("name")), "scene_id")
    out.append(_found(checked.where("duplicate OR bad_name").select("scene_id", "name").distinct(), "error", "V15", c("name"), F.lit("duplicate or bad name")))
    if {"crc", "crc_found"} <= set(entries.columns):
        out.append(_found(entries.where(~c("crc").eqNullSafe(c("crc_found"))), "error", "V15", c("name"), F.lit("content differs from its CRC")))
    found = out[2]
    for rows in out[3:]:
        found = found.unionByName(rows)
    return found.join(roots, "scene_id", "left_semi").unionByName(out[0]).unionByName(out[1])


def compare_manifests(a: DataFrame, b: DataFrame) -> DataFrame:
    """Entries (name, crc) that differ: added, gone or changed."""
    held = lambda m, side: m.select("name", F.struct("crc").alias(side))
    pair = held(a, "a").join(held(b, "b"), "name", "full_outer")  # an entry may lack its CRC
    kind = F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "gone").when(~F.col("a.crc").eqNullSafe(F.col("b.crc")), "changed")
    return pair.select("name", kind.alias("change")).where("change IS NOT NULL")


def compare_quantiles(a: DataFrame, b: DataFrame, qs: list[float], tolerance: float, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """Quantiles of two clouds by scene and axis, and whether they agree within a tolerance."""
    of = lambda df, name: quantiles(df, {c: qs for c in columns}).select("scene_id", F.col("column").alias("axis"), "q", F.col("value").alias(name))
    pair = of(a, "a").join(of(b, "b"), ["scene_id", "axis", "q"], "full_outer")
    return pair.withColumn("equal", F.coalesce(F.abs(F.col("a") - F.col("b")) <= tolerance, F.lit(False)))


def diff_snapshots(before: DataFrame, after: DataFrame, allow: list[str], stable: list[DataFrame] | None = None, hash_kind: str = "body", start_kind: str = "started", open_kind: str = "socket") -> DataFrame:
    """Snapshots (kind, key, value) -> kind, key, change; keys of ``allow`` are left out.

    gone, added and changed in general. Values of ``hash_kind`` count as changed only where every stable snapshot has the value
    of ``before``. A value of ``start_kind`` is 'time|restarts': of keys in both, 'restarted' where the time differs and
    'restart count' where the number does. Of ``open_kind`` the key alone counts, and none is allowed for.
    """
    pair = before.withColumnRenamed("value", "a").join(after.withColumnRenamed("value", "b"), ["kind", "key"], "full_outer")
    pair = pair.where(~F.col("key").isin(allow) | (F.col("kind") == open_kind))
    part = lambda c, i: F.coalesce(F.get(F.split(c, "\\|"), F.lit(i)), F.lit("?"))
    differ = lambda i: part(F.col("a"), i) != part(F.col("b"), i)
    both = F.col("a").isNotNull() & F.col("b").isNotNull()
    presence = F.when(F.col("b").isNull(), "gone").when(F.col("a").isNull(), "added")
    plain = F.array(presence.when((F.col("a") != F.col("b")) & (F.col("kind") != open_kind), "changed"))
    starts = F.when(both, F.array(F.when(differ(0), "restarted"), F.when(differ(1), "restart count")))
    out = pair.withColumn("change", F.explode(F.when(F.col("kind") == start_kind, starts).otherwise(plain))).where("change IS NOT NULL")
    steady = before.where(F.col("kind") == hash_kind).select("kind", "key", "value")
    for s in stable or []:
        steady = steady.intersect(s.select("kind", "key", "value"))
    steady = steady.select("kind", "key", F.lit(True).alias("steady")) if stable else steady.where("false").select("kind", "key", F.lit(True).alias("steady"))
    out = out.join(steady, ["kind", "key"], "left").where((F.col("kind") != hash_kind) | (F.col("change") != "changed") | F.coalesce("steady", F.lit(False)))
    return out.select("kind", "key", "change")


def log_window_count(lines: DataFrame, since: str, until: str) -> DataFrame:
    """lines (ts, line) -> lines in the window, strict and loose hits, three masked samples."""
    inside = lines.where(F.col("ts").between(F.lit(since).cast(dict(lines.dtypes)["ts"]), F.lit(until).cast(dict(lines.dtypes)["ts"])))
    strict, loose = F.col("line").rlike("\\[(emerg|crit)\\]"), F.col("line").rlike("(?i)emerg|crit")
    masked = F.substring(F.regexp_replace("line", "\\b[0-9]{1,3}(\\.[0-9]{1,3}){3}\\b", "x.x.x.x"), 1, 300)
    counts = inside.agg(F.count(F.lit(1)).alias("lines"), F.count_if(strict).alias("strict"), F.count_if(loose).alias("loose"))
    samples = inside.where(strict).orderBy("ts", "line").limit(3).agg(F.sort_array(F.collect_list(masked)).alias("samples"))
    return counts.crossJoin(F.broadcast(samples))
