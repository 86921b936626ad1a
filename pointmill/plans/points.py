"""Point-table queries over the `points` view of the events table, each with its SQL equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pointmill.operators.intervals import running

SCALE, CHUNK = 0.01, 500

POINTS_SQL = """WITH points AS (SELECT event_id AS point_index, CAST(round(value * 100) AS INT) AS x, user_id * 1000 + event_id % 997 AS y,
event_id % 5003 - 2500 AS z, (event_id * 7919) % 65536 AS intensity, 1 + event_id % 5 AS return_number,
1 + (event_id * 3) % 5 AS number_of_returns, user_id AS point_source_id,
CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 7 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 2 ELSE 5 END AS classification,
event_id * CAST(0.001 AS DOUBLE) AS gps_time, (event_id * 31) % 65536 AS red, (event_id * 37) % 65536 AS green, (event_id * 41) % 65536 AS blue,
(event_id * 43) % 65536 AS nir FROM events) """


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        e.alias("point_index"), F.round(F.col("value") * 100).cast("int").alias("x"), (F.col("user_id") * 1000 + e % 997).alias("y"), (e % 5003 - 2500).alias("z"),
        ((e * 7919) % 65536).alias("intensity"), (1 + e % 5).alias("return_number"), (1 + (e * 3) % 5).alias("number_of_returns"), F.col("user_id").alias("point_source_id"),
        F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 7 WHEN 'purchase' THEN 6 WHEN 'signup' THEN 2 ELSE 5 END").alias("classification"),
        (e * F.lit(0.001)).alias("gps_time"), *(((e * k) % 65536).alias(c) for c, k in (("red", 31), ("green", 37), ("blue", 41), ("nir", 43))),
    )


def world_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_index", *((F.col(c) * F.lit(SCALE)).alias(f"world_{c}") for c in "xyz"))


def header_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).agg(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))


def points_by_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points by return, for each return from 1 to 15."""
    counted = points(spark, sf_dir).where("return_number BETWEEN 1 AND 15").groupBy("return_number").agg(F.count(F.lit(1)).alias("n"))
    spine = spark.range(1, 16).select(F.col("id").alias("return_number"))
    return spine.join(F.broadcast(counted), "return_number", "left").select("return_number", F.coalesce("n", F.lit(0).cast("long")).alias("n_points"))


def pack_bit_byte(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).select("point_index", F.col("return_number").bitwiseOR(F.shiftleft("number_of_returns", 3)).alias("bit_byte"))


def box_filter_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return points(spark, sf_dir).where("x BETWEEN 1000 AND 5000 AND y BETWEEN 0 AND 500000").select("point_index", "x", "y")


def chunk_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = points(spark, sf_dir).groupBy(F.floor(F.col("point_index") / CHUNK).cast("long").alias("chunk_id")).agg(F.count(F.lit(1)).alias("n_points"))
    return running(chunks, "chunk_id", "n_points", "first_point").select("chunk_id", "n_points", "first_point")


QUERIES = {f.__name__: f for f in (world_coords, header_bounds, points_by_return, pack_bit_byte, box_filter_2d, chunk_table)}
ORACLES = {
    "world_coords": POINTS_SQL + "SELECT point_index, x * CAST(0.01 AS DOUBLE) AS world_x, y * CAST(0.01 AS DOUBLE) AS world_y, z * CAST(0.01 AS DOUBLE) AS world_z FROM points",
    "header_bounds": POINTS_SQL + "SELECT min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y, min(z) AS min_z, max(z) AS max_z FROM points",
    "points_by_return": POINTS_SQL + "SELECT r AS return_number, count(point_index) AS n_points FROM range(1, 16) t(r) LEFT JOIN points ON return_number = r GROUP BY r",
    "pack_bit_byte": POINTS_SQL + "SELECT point_index, return_number | (number_of_returns << 3) AS bit_byte FROM points",
    "box_filter_2d": POINTS_SQL + "SELECT point_index, x, y FROM points WHERE x BETWEEN 1000 AND 5000 AND y BETWEEN 0 AND 500000",
    "chunk_table": POINTS_SQL + "SELECT chunk_id, n_points, CAST(coalesce(sum(n_points) OVER (ORDER BY chunk_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_point FROM (SELECT point_index // 500 AS chunk_id, count(*) AS n_points FROM points GROUP BY 1)",
}
