"""JSON lines, daily totals files, archives: readers and sinks."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestrata.sources.files import located
from lodestrata.sources.parts import PartStore, add_up

REPORT = "id string, ts string, site string, kind string, page string, lang string, release string, stage string, message string, contact string, suspect boolean, diagnostics string, diagBytes long, repeatOf string"
# What an archive may hold, and how large a member may be.
MEMBER_RULES = [("reports\\.jsonl", 256 << 20), ("reports/(R-[0-9]{8}-[0-9]{4,})\\.json", 3 << 20), ("events-[0-9]{4}-[0-9]{2}-[0-9]{2}\\.json", 4 << 20)]


def read_jsonl(spark: SparkSession, path: str, schema: str = REPORT) -> DataFrame:
    """Report lines; broken lines and lines without a valid id are left out."""
    rows = spark.read.schema(schema + ", _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where(F.col("_broken").isNull() & F.col("id").rlike("^R-[0-9]{8}-[0-9]{4,}$")).drop("_broken")


def read_daily_totals(spark: SparkSession, path: str) -> DataFrame:
    """day, name, value (null for the total), n from files of maps."""
    rows = spark.read.schema("day string, site string, counts map<string,long>, props map<string,map<string,long>>").json(path)
    totals = rows.select("day", F.explode("counts").alias("name", "n")).select("day", "name", F.lit(None).cast("string").alias("value"), "n")
    values = rows.select("day", F.explode("props").alias("name", "of")).select("day", "name", F.explode("of").alias("value", "n"))
    return totals.unionByName(values)


def append_jsonl(rows: DataFrame, path: str) -> None:
    """One JSON line per record, appended; a job that fails leaves nothing behind."""
    rows.write.mode("append").json(path)


TOTALS = "day string, name string, value string, n long"


def write_daily_totals(totals: DataFrame, path: str, part: str = "0") -> None:
    """Totals (day, name, value, n) as the part ``part``: writing a part again replaces it, so a job that runs twice counts
    once; other parts are not touched. ``daily_totals`` adds the parts up."""
    rows = totals.groupBy(F.col("day").cast("string").alias("day"), "name", "value").agg(F.sum("n").alias("n"))
    PartStore(totals.sparkSession, path, TOTALS).add(rows, part)


def daily_totals(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """day, name, value, n of all parts (of days from ``since`` on)."""
    return PartStore(spark, path, TOTALS).read(since).groupBy("day", "name", "value").agg(F.sum("n").alias("n"))


def merge_daily_totals(spark: SparkSession, path: str) -> int:
    """Make one part of the parts of each day, but for the newest part; how many were merged."""
    return PartStore(spark, path, TOTALS).merge(add_up(["day", "name", "value"], ["n"]))


def archive_entries(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row per entry of each archive: path, seq, name, size, crc, offset, zip64. Paths may name any file system that Arrow knows."""

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for path in f["path"]:
                fs, inside = located(path)
                with fs.open_input_file(inside) as file, zipfile.ZipFile(file) as z:
                    rows = [(path, i, e.filename, e.file_size, e.CRC, e.header_offset, e.header_offset >= 0xFFFFFFFF or e.file_size >= 0xFFFFFFFF) for i, e in enumerate(z.infolist())]
                yield pd.DataFrame(rows, columns=["path", "seq", "name", "size", "crc", "offset", "zip64"])

    table = spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, min(len(paths), 64)))
    return table.mapInPandas(look, "path string, seq long, name string, size long, crc long, offset long, zip64 boolean")


def safe_members(entries: DataFrame, rules: list[tuple[str, int]] = MEMBER_RULES) -> DataFrame:
    """entries with ``kept``: a name that a rule allows, within its size."""
    kept = F.lit(False)
    for pattern, cap in rules:
        kept = kept | (F.col("name").rlike(f"\\A(?:{pattern})\\z") & (F.col("size") <= cap))
    return entries.withColumn("kept", kept)
