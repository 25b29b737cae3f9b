"""Views of the driver's tables as the library's inputs; the SQL runs unchanged in Spark and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lodestrata.operators import cloud

_ORDER = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
_NUMBER = f"CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY {', '.join(_ORDER)}) - 1 AS BIGINT) AS record_no"
SPLATS = f"""
SELECT l_returnflag AS scene_id,
       {_NUMBER},
       l_extendedprice / CAST(1000 AS DOUBLE) AS x, l_quantity AS y, CAST(l_partkey % 1000 AS DOUBLE) AS z,
       l_discount * CAST(20 AS DOUBLE) - CAST(1 AS DOUBLE) AS f_dc_0, l_tax * CAST(20 AS DOUBLE) - CAST(1 AS DOUBLE) AS f_dc_1,
       CAST(l_suppkey % 10 AS DOUBLE) / CAST(5 AS DOUBLE) - CAST(1 AS DOUBLE) AS f_dc_2,
       (l_quantity - CAST(25 AS DOUBLE)) / CAST(5 AS DOUBLE) AS opacity,
       CAST(-3 AS DOUBLE) + l_tax * CAST(10 AS DOUBLE) AS scale_0, CAST(-3 AS DOUBLE) AS scale_1, CAST(-3 AS DOUBLE) + l_discount * CAST(10 AS DOUBLE) AS scale_2,
       CAST(1 AS DOUBLE) AS rot_0, CAST(0 AS DOUBLE) AS rot_1, CAST(0 AS DOUBLE) AS rot_2, CAST(0 AS DOUBLE) AS rot_3, l_suppkey AS suppkey
FROM lineitem
"""

EVENTS = """
SELECT event_id, user_id, ts, CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) AS k, value AS amount,
       CASE event_type WHEN 'view' THEN 'page_view' WHEN 'click' THEN 'file_selected' WHEN 'signup' THEN 'convert_start' WHEN 'purchase' THEN 'convert_done' ELSE 'convert_error' END AS name,
       CASE event_type WHEN 'view' THEN (CASE CAST(regexp_extract(props, '([0-9]+)', 1) AS BIGINT) % 5 WHEN 0 THEN 'en' WHEN 1 THEN 'es' WHEN 2 THEN 'pl' WHEN 3 THEN 'ru' ELSE 'xx1' END)
            WHEN 'error' THEN concat('s', regexp_extract(props, '([0-9]+)', 1))
            ELSE (CASE WHEN value < 100 THEN 'lt100m' WHEN value < 250 THEN '1g-4g' WHEN value < 400 THEN 'gt64g' ELSE 'huge' END) END AS raw_value
FROM events
"""

# Errors: seconds since the epoch, release, stage, message.
ERRORS = f"""
SELECT event_id AS id, ts, user_id, concat('r', CAST(user_id % 3 AS VARCHAR(9))) AS release, concat('s', CAST(k % 4 AS VARCHAR(9))) AS stage,
       concat('RangeError: allocation  failed at ', CAST(k AS VARCHAR(9)), ' splats in step ', chr(CAST(97 + user_id % 7 AS INT))) AS message
FROM ({EVENTS}) AS e WHERE name = 'convert_error'
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """A query over tables of a folder; table names are marked in braces or plain after FROM."""
    return spark.sql(_bound(sql, tables), **{t: load(spark, sf_dir, t) for t in tables})


def _bound(sql: str, tables: tuple[str, ...]) -> str:
    for t in tables:
        sql = sql.replace(f"FROM {t}\n", f"FROM {{{t}}}\n").replace(f"JOIN {t}\n", f"JOIN {{{t}}}\n")
    return sql


def splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splat view, whose window would sort a scene in one task: its rows are numbered by ranges and written down instead."""
    rows = load(spark, sf_dir, "lineitem").select("l_returnflag", *_ORDER, "l_quantity", "l_discount", "l_tax")
    return spark.sql(_bound(SPLATS.replace(_NUMBER, "record_no"), ("lineitem",)), lineitem=cloud.number_records(rows, _ORDER, "l_returnflag"))


def unnumbered_splats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The splat view without record numbers, for what does not look at them."""
    return view(spark, sf_dir, SPLATS.replace(f"       {_NUMBER},\n", ""), "lineitem")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, EVENTS, "events")


def errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, ERRORS, "events")
