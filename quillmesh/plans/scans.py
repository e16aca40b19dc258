"""Queries of laser scans: files written and read by tasks, and anchors of detections in their clouds."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.operators import raycast
from quillmesh.operators.lineage import checkpointed, new_folder
from quillmesh.plans import inputs as i
from quillmesh.plans.registry import query
from quillmesh.sources import e57, readers


def _scanned(spark, sf_dir) -> str:
    """Sightings as points of scan files in the shared folder, a scan for each number; every seventh is marked invalid."""
    rows = i.sightings(spark, sf_dir).select(
        F.concat(F.lit("scan"), "scan").alias("guid"), "x", "y", "z", (F.col("tag_id") % 7 == 0).cast("int").alias("invalid"),
        (F.col("tag_id") % 256 * 257).cast("int").alias("r"), (F.col("tag_id") % 13).cast("double").alias("intensity"),
    )
    folder = new_folder(spark, "scans")
    e57.write_points(rows, folder)
    return folder


@query(f"""WITH {i.SIGHTINGS} SELECT 'scan' || scan AS guid, count(*) AS points, round(min(x), 6) AS min_x, round(max(x), 6) AS max_x, round(sum(y), 4) AS sum_y, round(max(z), 6) AS max_z, CAST(sum(tag_id % 256) AS BIGINT) AS red
FROM sightings WHERE tag_id % 7 <> 0 GROUP BY scan""")
def s3_e57_points(spark, sf_dir):
    """Valid points of scan files, read in parts; colours of two bytes brought to one."""
    points = e57.points(spark, _scanned(spark, sf_dir), "guid string, x double, y double, z double, invalid int, r int")
    wide = F.when(F.col("r") % 257 == 0, F.col("r") / 257).cast("int")  # the scale's own multiples
    return readers.valid_points(points.withColumn("r", wide)).groupBy("guid").agg(
        F.count(F.lit(1)).alias("points"), F.round(F.min("x"), 6).alias("min_x"), F.round(F.max("x"), 6).alias("max_x"), F.round(F.sum("y"), 4).alias("sum_y"), F.round(F.max("z"), 6).alias("max_z"), F.sum("r").cast("long").alias("red"),
    )


@query(f"WITH {i.SIGHTINGS} SELECT 'scan' || scan AS guid, CAST(count(*) AS BIGINT) AS points, CAST(1 AS DOUBLE) AS w, CAST(0 AS DOUBLE) AS x FROM sightings GROUP BY scan")
def s1_e57_scans(spark, sf_dir):
    """Scans that the files' headers name, with the poses they leave out."""
    found = e57.scans(spark, _scanned(spark, sf_dir))
    return found.groupBy("guid").agg(F.sum("points").alias("points"), F.max("rotation.w").alias("w"), F.max("translation.x").alias("x"))


_CLOUD = """cloud AS (SELECT tag_id, scan % 3 AS scan, floor(x * 20) / 4 + 5 AS x, floor(y * 20) / 4 + 3 AS y, floor(z * 8) / 4 + 1.2 AS z FROM sightings),
posed AS (SELECT *, 1-2*(qy*qy+qz*qz) AS m00, 2*(qx*qy-qw*qz) AS m01, 2*(qx*qz+qw*qy) AS m02, 2*(qx*qy+qw*qz) AS m10, 1-2*(qx*qx+qz*qz) AS m11, 2*(qy*qz-qw*qx) AS m12, 2*(qx*qz-qw*qy) AS m20, 2*(qy*qz+qw*qx) AS m21, 1-2*(qx*qx+qy*qy) AS m22
  FROM (SELECT tag_id AS id, scan, x AS tx, y AS ty, z AS tz, cos(h) * r AS qw, cos(h) * r AS qx, sin(h) * r AS qy, sin(h) * r AS qz, CAST(k % 11 AS DOUBLE) AS px, CAST(k % 7 AS DOUBLE) AS py, CAST(1.2 AS DOUBLE) AS pz
    FROM (SELECT *, tag_id % 10 + 1 AS k, radians(CAST((tag_id % 10 + 1) * 37 % 360 AS DOUBLE)) / 2 AS h, sqrt(CAST(0.5 AS DOUBLE)) AS r FROM cloud))),
aimed AS (SELECT *, m00*(tx-px)+m10*(ty-py)+m20*(tz-pz) AS ax, -(m01*(tx-px)+m11*(ty-py)+m21*(tz-pz)) AS ay, -(m02*(tx-px)+m12*(ty-py)+m22*(tz-pz)) AS az FROM posed),
boxed AS (SELECT *, CASE WHEN az > 0.05 THEN 500*ax/az+500 + id % 5 - 2 END AS mu, CASE WHEN az > 0.05 THEN 500*ay/az+500 + id % 3 - 1 END AS mv FROM aimed),
cam AS (SELECT b.*, c.x, c.y, c.z, m00*(c.x-px)+m10*(c.y-py)+m20*(c.z-pz) AS cx, -(m01*(c.x-px)+m11*(c.y-py)+m21*(c.z-pz)) AS cy, -(m02*(c.x-px)+m12*(c.y-py)+m22*(c.z-pz)) AS cz FROM boxed b JOIN cloud c ON b.scan = c.scan),
win AS (SELECT * FROM cam WHERE cz > 0.3 AND 500*cx/cz+500 >= 0 AND 500*cx/cz+500 < 1000 AND 500*cy/cz+500 >= 0 AND 500*cy/cz+500 < 1000 AND abs(500*cx/cz+500 - mu) < 4 AND abs(500*cy/cz+500 - mv) < 4),
front AS (SELECT *, min(cz) OVER (PARTITION BY id) AS least FROM win),
mid AS (SELECT id, round(median(x), 4) AS x, round(median(y), 4) AS y, round(median(z), 4) AS z, count(*) AS n FROM front WHERE cz < least * 1.05 + 0.03 GROUP BY id)"""


def _cloud(spark, sf_dir):
    grid = lambda k, scale, at: (F.floor(F.col(k) * scale) / 4 + F.lit(at)).alias(k)
    return i.sightings(spark, sf_dir).select("tag_id", (F.col("scan") % 3).alias("scan"), grid("x", 20, 5.0), grid("y", 20, 3.0), grid("z", 8, 1.2))


def _aimed(spark, sf_dir):
    """A detection for each point: a box near where one of ten cameras sees it."""
    own = _cloud(spark, sf_dir).select(F.col("tag_id").alias("id"), "scan", i.camera(F.col("tag_id") % 10 + 1).alias("camera"), F.struct("x", "y", "z").alias("at"))
    px = own.withColumn("px", g.project(F.col("at"), F.col("camera")))
    u, v = F.col("px.u") + F.col("id") % 5 - 2, F.col("px.v") + F.col("id") % 3 - 1
    return px.select("id", "scan", "camera", F.when(F.col("px").isNotNull(), g.box(u - 10, v - 10, u + 10, v + 10)).alias("box"))


@query(f"WITH {i.SIGHTINGS}, {_CLOUD} SELECT b.id, x, y, z, coalesce(n, 0) AS n FROM boxed b LEFT JOIN mid USING (id)")
def j12_a7_anchors(spark, sf_dir):
    """Where in the cloud each detection lies: its scan's points in the window around the box's centre, their front surface, its median."""
    return raycast.anchors(_cloud(spark, sf_dir).select("scan", "x", "y", "z"), checkpointed(_aimed(spark, sf_dir)))
