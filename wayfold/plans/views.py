"""Inputs of the registered queries: the driver's tables read as survey data by whole-number arithmetic, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df by as many tasks as an exchange has, for what is dear to compute: a small file is read by one or two."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a frame; each 10,000 of them in an area of their own, so that density doesn't grow with the table."""
    return table(spark, sf_dir, "events").selectExpr(
        "event_id AS frame_id", "user_id AS drive_id", "ts",
        "(12940000 + (event_id * 7919) % 10007 + (event_id div 10000) * 20000) / 1e6D AS lat",
        "(80230000 + (event_id * 6007) % 10009) / 1e6D AS lon",
        "CAST((event_id * 37) % 360 AS DOUBLE) AS heading", "5 + ((event_id * 13) % 500) / 10D AS depth", "0.05D + ((event_id * 11) % 90) / 100D AS frac",
    )


FRAMES = """frames AS (
  SELECT event_id AS frame_id, user_id AS drive_id, ts,
    (12940000 + (event_id * 7919) % 10007 + (event_id // 10000) * 20000) / 1e6::DOUBLE AS lat,
    (80230000 + (event_id * 6007) % 10009) / 1e6::DOUBLE AS lon,
    ((event_id * 37) % 360)::DOUBLE AS heading, 5 + ((event_id * 13) % 500) / 10::DOUBLE AS depth, 0.05::DOUBLE + ((event_id * 11) % 90) / 100::DOUBLE AS frac
  FROM events)"""


def buildings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a square building with a WKT outline; each 2,000 of them in the area of 10,000 frames."""
    b = table(spark, sf_dir, "part").selectExpr(
        "p_partkey AS building_id", "12940000 + (p_partkey * 4001) % 10007 + (p_partkey div 2000) * 20000 AS y", "80230000 + (p_partkey * 9001) % 10009 AS x",
        "20 + p_size AS half", "CAST(p_partkey % 100 AS DOUBLE) / 100D AS confidence",
    )
    deg = lambda e: f"concat({e} div 1000000, '.', lpad(CAST({e} % 1000000 AS STRING), 6, '0'))"
    corner = lambda dx, dy: f"{deg(f'(x {dx} half)')}, ' ', {deg(f'(y {dy} half)')}"
    ring = ", ', ', ".join(corner(*c) for c in ("--", "+-", "++", "-+", "--"))
    return b.selectExpr(
        "building_id", "y / 1e6D AS b_lat", "x / 1e6D AS b_lon", "confidence", "2 * half * 0.11132D AS footprint_w_m", f"concat('POLYGON((', {ring}, '))') AS geometry", "half",
    )


def _sql_deg(e: str) -> str:
    return f"({e} // 1000000) || '.' || lpad(({e} % 1000000)::VARCHAR, 6, '0')"


BUILDINGS = f"""buildings AS (
  SELECT building_id, y / 1e6::DOUBLE AS b_lat, x / 1e6::DOUBLE AS b_lon, confidence, 2 * half * 0.11132::DOUBLE AS footprint_w_m, half,
    'POLYGON((' || {" || ', ' || ".join(_sql_deg(f"(x {a} half)") + " || ' ' || " + _sql_deg(f"(y {b} half)") for a, b in ("--", "+-", "++", "-+", "--"))} || '))' AS geometry
  FROM (SELECT p_partkey AS building_id, 12940000 + (p_partkey * 4001) % 10007 + (p_partkey // 2000) * 20000 AS y, 80230000 + (p_partkey * 9001) % 10009 AS x,
    20 + p_size AS half, (p_partkey % 100)::DOUBLE / 100::DOUBLE AS confidence FROM part))"""


def imu(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a sample of its user's drive: epoch seconds, position, a yaw that wraps."""
    return table(spark, sf_dir, "events").selectExpr(
        "user_id AS drive_id", "event_id", "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', ts) / 1e6D AS t",
        "(12940000 + (event_id * 7919) % 10007) / 1e6D AS lat", "(80230000 + (event_id * 6007) % 10009) / 1e6D AS lon", "CAST((event_id * 97) % 360 AS DOUBLE) AS yaw",
    )


IMU = """imu AS (
  SELECT user_id AS drive_id, event_id, epoch_us(ts) / 1e6::DOUBLE AS t,
    (12940000 + (event_id * 7919) % 10007) / 1e6::DOUBLE AS lat, (80230000 + (event_id * 6007) % 10009) / 1e6::DOUBLE AS lon, ((event_id * 97) % 360)::DOUBLE AS yaw
  FROM events)"""


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order line as a LiDAR point of one of two sensors, in the tile of its order."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS tile", "l_linenumber AS n", "CAST(1 + l_orderkey % 2 AS INT) AS sensor",
        "2 + ((l_orderkey * 31 + l_linenumber * 17) % 600) / 10D AS x", "((l_partkey * 7) % 800) / 10D - 40 AS y", "((l_suppkey * 13 + l_linenumber * 5) % 120) / 10D - 4 AS z",
    )


POINTS = """points AS (
  SELECT l_orderkey AS tile, l_linenumber AS n, (1 + l_orderkey % 2)::INT AS sensor,
    2 + ((l_orderkey * 31 + l_linenumber * 17) % 600) / 10::DOUBLE AS x, ((l_partkey * 7) % 800) / 10::DOUBLE - 40 AS y, ((l_suppkey * 13 + l_linenumber * 5) % 120) / 10::DOUBLE - 4 AS z
  FROM lineitem)"""
