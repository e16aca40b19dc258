"""The engine's entities as views of the tables at hand, each as a DataFrame and as the SQL that makes the same rows.

sightings: a labelled 3D point with a confidence; cabinets: a few named points, some without a position; detections: a
classed event with a position, or without; boxes: scored rectangles of an image; cameras: poses that look around level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.plans.registry import table


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tag_id"), F.concat(F.lit("L"), "label").alias("label"), F.concat(F.lit("K"), F.col("label") % 3).alias("kind"),
        e(0).alias("x"), e(1).alias("y"), e(2).alias("z"), F.abs(e(3)).alias("confidence"),
        (F.col("vec_id") % 108).cast("int").alias("image"), F.floor(F.col("vec_id") % 108 / 6).cast("int").alias("scan"),
    )


SIGHTINGS = """sightings AS (SELECT vec_id AS tag_id, 'L' || label AS label, 'K' || (label % 3) AS kind,
  CAST(embedding[1] AS DOUBLE) AS x, CAST(embedding[2] AS DOUBLE) AS y, CAST(embedding[3] AS DOUBLE) AS z, abs(CAST(embedding[4] AS DOUBLE)) AS confidence,
  CAST(vec_id % 108 AS INT) AS image, CAST(floor((vec_id % 108) / 6.0) AS INT) AS scan FROM embeddings)"""


def cabinets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    at = lambda v: F.when(k % 10 != 9, v.cast("double"))
    return table(spark, sf_dir, "nation").select(
        k.alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("F"), "n_regionkey").alias("folder"),
        at(k % 5 * 2).alias("x"), at(F.floor(k / 5)).alias("y"), at(F.lit(1)).alias("z"), F.when(k % 4 != 0, (k % 7) / 10.0).alias("confidence"),
    )


CABINETS = """cabinets AS (SELECT n_nationkey AS id, n_name AS name, 'F' || n_regionkey AS folder,
  CASE WHEN n_nationkey % 10 <> 9 THEN CAST(n_nationkey % 5 * 2 AS DOUBLE) END AS x, CASE WHEN n_nationkey % 10 <> 9 THEN CAST(floor(n_nationkey / 5.0) AS DOUBLE) END AS y,
  CASE WHEN n_nationkey % 10 <> 9 THEN CAST(1 AS DOUBLE) END AS z, CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey % 7 AS DOUBLE) / 10 END AS confidence FROM nation)"""


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    at = lambda v: F.when(k % 17 != 0, v.cast("double"))
    return table(spark, sf_dir, "events").select(
        k.alias("id"), F.col("event_type").alias("class"), F.round(F.col("value") % 1, 2).alias("conf"),
        at(F.col("user_id") % 100 / 10.0).alias("x"), at(k % 50 / 10.0).alias("y"), at(k % 3 / 2.0).alias("z"), (k % 108).cast("int").alias("image"),
    )


DETECTIONS = """detections AS (SELECT event_id AS id, event_type AS class, round(fmod(value, 1), 2) AS conf,
  CASE WHEN event_id % 17 <> 0 THEN CAST(user_id % 100 AS DOUBLE) / 10 END AS x, CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 50 AS DOUBLE) / 10 END AS y,
  CASE WHEN event_id % 17 <> 0 THEN CAST(event_id % 3 AS DOUBLE) / 2 END AS z, CAST(event_id % 108 AS INT) AS image FROM events)"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles of an image (an order) and class; scores differ within an image. They are grouped by the numbers that they are made of."""
    c = F.col
    own = table(spark, sf_dir, "lineitem").select(
        c("l_orderkey").alias("image"), c("l_linenumber").alias("n"), c("l_partkey").alias("part"), (c("l_suppkey") % 30).cast("int").alias("s"), c("l_quantity").alias("q"),
        (c("l_discount") + c("l_tax") + 0.3).alias("score"),
    ).groupBy("image", "n", "part", "s", "q").agg(F.round(F.max("score"), 2).alias("score"))
    x0, y0 = (c("part") % 60 * 4).cast("double"), (c("s") * 4).cast("double")
    return own.select("image", (c("n") % 2).alias("class"), "n", "part", x0.alias("x0"), y0.alias("y0"), (x0 + 80 + c("q")).alias("x1"), (y0 + 60 + c("q")).alias("y1"), "score")


BOXES = """boxes AS (SELECT image, class, n, part, x0, y0, x0 + 80 + q AS x1, y0 + 60 + q AS y1, round(max(s), 2) AS score FROM (
  SELECT l_orderkey AS image, l_linenumber % 2 AS class, l_linenumber AS n, l_partkey AS part, CAST(l_partkey % 60 * 4 AS DOUBLE) AS x0, CAST(l_suppkey % 30 * 4 AS DOUBLE) AS y0,
  l_quantity AS q, l_discount + l_tax + 0.3 AS s FROM lineitem) GROUP BY image, class, n, part, x0, y0, q)"""


def camera(k: Column) -> Column:
    """A camera by its number: the quaternion turns its -z axis level and then about the vertical."""
    half = F.radians((k * 37 % 360).cast("double")) / 2
    c = F.lit(0.5**0.5)
    rotation = F.struct((F.cos(half) * c).alias("w"), (F.cos(half) * c).alias("x"), (F.sin(half) * c).alias("y"), (F.sin(half) * c).alias("z"))
    position = F.struct((k % 11).cast("double").alias("x"), (k % 7).cast("double").alias("y"), F.lit(1.2).alias("z"))
    frame = {"fx": 500.0, "fy": 500.0, "cx": 500.0, "cy": 500.0, "width": 1000.0, "height": 1000.0}
    return F.struct(rotation.alias("rotation"), position.alias("position"), *[F.lit(v).alias(n) for n, v in frame.items()])


def cameras(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(k.alias("camera_id"), camera(k).alias("camera"))


CAMERAS = """cameras AS (SELECT s_suppkey AS camera_id, cos(h) * r AS qw, cos(h) * r AS qx, sin(h) * r AS qy, sin(h) * r AS qz,
  CAST(s_suppkey % 11 AS DOUBLE) AS px, CAST(s_suppkey % 7 AS DOUBLE) AS py, CAST(1.2 AS DOUBLE) AS pz FROM (
  SELECT s_suppkey, radians(CAST(s_suppkey * 37 % 360 AS DOUBLE)) / 2 AS h, sqrt(CAST(0.5 AS DOUBLE)) AS r FROM supplier))"""

#: A camera's matrix, and a point (x, y, z) in its axes, for SQL.
POSED = """posed AS (SELECT *, 1-2*(qy*qy+qz*qz) AS m00, 2*(qx*qy-qw*qz) AS m01, 2*(qx*qz+qw*qy) AS m02, 2*(qx*qy+qw*qz) AS m10, 1-2*(qx*qx+qz*qz) AS m11,
  2*(qy*qz-qw*qx) AS m12, 2*(qx*qz-qw*qy) AS m20, 2*(qy*qz+qw*qx) AS m21, 1-2*(qx*qx+qy*qy) AS m22 FROM cameras)"""
SEEN = """seen AS (SELECT *, m00*(x-px)+m10*(y-py)+m20*(z-pz) AS cx, -(m01*(x-px)+m11*(y-py)+m21*(z-pz)) AS cy, -(m02*(x-px)+m12*(y-py)+m22*(z-pz)) AS cz
  FROM posed CROSS JOIN (SELECT id, name, x, y, z FROM cabinets WHERE x IS NOT NULL))"""


def point() -> object:
    return g.vec(F.col("x"), F.col("y"), F.col("z"))
