"""Sensor-shaped views of the driver's tables, as DataFrames and as the same views in DuckDB SQL.

Stamps are microseconds as longs. Nothing here needs a global sort: the index of a point is its place
within its scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SWEEP_US = 7_200_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str):
    return F.unix_micros(F.col(column).cast("timestamp"))


def sensor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sample: event_id, stamp_us, sensor_id, modality, value, k, user_id."""
    kind = F.when(F.col("event_type") == "view", "lidar").when(F.col("event_type") == "click", "imu").when(F.col("event_type") == "purchase", "gnss").when(F.col("event_type") == "signup", "camera").otherwise("fault")
    return table(spark, sf_dir, "events").select(
        "event_id", micros("ts").alias("stamp_us"), (F.col("user_id") % 8).cast("int").alias("sensor_id"), kind.alias("modality"), "value", F.get_json_object("props", "$.k").cast("int").alias("k"), "user_id"
    )


def modality(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return sensor(spark, sf_dir).filter(F.col("modality") == name)


def sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per sweep: sweep_id, t_begin, t_end, sensor_id."""
    return modality(spark, sf_dir, "lidar").select(F.col("event_id").alias("sweep_id"), F.col("stamp_us").alias("t_begin"), (F.col("stamp_us") + SWEEP_US).alias("t_end"), "sensor_id")


POINT_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_shipdate")


def point(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per return: scan_id, idx (within the scan), x, y, z, t_offset, intensity."""
    order = Window.partitionBy("l_orderkey").orderBy(*POINT_ORDER)
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("scan_id"), F.row_number().over(order).alias("idx"), F.col("l_quantity").cast("double").alias("x"), (F.col("l_extendedprice") / 2000).alias("y"),
        (F.col("l_discount") * 100 + 0.0).alias("z"), F.col("l_linenumber").cast("int").alias("t_offset"), F.col("l_tax").alias("intensity"),
    )


def track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per pose: run, t, kf_id, x, y."""
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("run"), micros("o_orderdate").alias("t"), F.col("o_orderkey").alias("kf_id"), (F.col("o_totalprice") / 1000).alias("x"), (F.col("o_orderkey") % 997).cast("double").alias("y")
    )


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per fix: id, lat, lon, alt, fix_rank, num_sats, cov_trace."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), (48 + F.col("c_acctbal") / 1e5).alias("lat"), (2 + F.col("c_custkey") / 1e5).alias("lon"), (F.col("c_nationkey") * 10.0).alias("alt"),
        (F.col("c_custkey") % 5).cast("int").alias("fix_rank"), (F.col("c_custkey") % 13).cast("int").alias("num_sats"), (F.abs("c_acctbal") / 1000).alias("cov_trace"),
    )


def descriptor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per place: id, d (8 rings of 8 sectors, row by row)."""
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("d"))


#: The same views for DuckDB, to be put behind WITH.
SQL = {
    "v_sensor": """SELECT event_id, epoch_us(ts) AS stamp_us, CAST(user_id % 8 AS INT) AS sensor_id,
        CASE event_type WHEN 'view' THEN 'lidar' WHEN 'click' THEN 'imu' WHEN 'purchase' THEN 'gnss' WHEN 'signup' THEN 'camera' ELSE 'fault' END AS modality,
        value, CAST(json_extract_string(props, '$.k') AS INT) AS k, user_id FROM events""",
    "v_sweep": f"SELECT event_id AS sweep_id, stamp_us AS t_begin, stamp_us + {SWEEP_US} AS t_end, sensor_id FROM v_sensor WHERE modality = 'lidar'",
    "v_point": f"""SELECT l_orderkey AS scan_id, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY {", ".join(POINT_ORDER)}) AS INT) AS idx,
        CAST(l_quantity AS DOUBLE) AS x, l_extendedprice / 2000 AS y, l_discount * 100 + 0.0 AS z, CAST(l_linenumber AS INT) AS t_offset, l_tax AS intensity FROM lineitem""",
    "v_track": "SELECT o_custkey AS run, epoch_us(o_orderdate) AS t, o_orderkey AS kf_id, o_totalprice / 1000 AS x, CAST(o_orderkey % 997 AS DOUBLE) AS y FROM orders",
    "v_geo": """SELECT c_custkey AS id, 48 + c_acctbal / 1e5 AS lat, 2 + c_custkey / 1e5 AS lon, c_nationkey * 10.0::DOUBLE AS alt, CAST(c_custkey % 5 AS INT) AS fix_rank,
        CAST(c_custkey % 13 AS INT) AS num_sats, abs(c_acctbal) / 1000 AS cov_trace FROM customer""",
    "v_descriptor": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS d FROM embeddings",
}
NEEDS = {"v_sweep": ("v_sensor",)}


def with_views(sql: str, *ctes: str, recursive: bool = False) -> str:
    """``sql`` behind the views whose names stand in it, then ``ctes`` ("name AS (...)")."""
    text = sql + " ".join(ctes)
    names = [v for v in SQL if v in text or any(v in NEEDS.get(w, ()) and w in text for w in SQL)]
    parts = [f"{v} AS ({SQL[v]})" for v in names] + list(ctes)
    return (f"WITH {'RECURSIVE ' if recursive else ''}" + ", ".join(parts) + " " if parts else "") + sql
