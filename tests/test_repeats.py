"""Repeated places, windows and keys: results count every row, work follows what is distinct."""

import statistics

import duckdb
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import raycast, spatial
from quillmesh.operators.quantile import medians
from quillmesh.plans import relational as _  # noqa: F401  it registers its queries
from quillmesh.plans.registry import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("most", [3, 10_000])
def test_medians_of_weighted_values(spark, most):
    groups = {1: {k * 0.5: 1 + k % 4 for k in range(200)}, 2: {1.0: 1, 2.0: 1}, 3: {1.0: 5, 9.0: 4}, 4: {7.0: 3}, 5: {float(k): 10**9 for k in range(40)}}
    rows = spark.createDataFrame([(k, v, w) for k, vs in groups.items() for v, w in vs.items()], "k long, v double, w long")
    got = {x.k: x.v for x in medians(rows, ["k"], ["v"], most, weight="w").collect()}
    for k in (1, 2, 3, 4):
        assert got[k] == statistics.median([v for v, w in groups[k].items() for _ in range(w)]), k
    assert got[5] == 19.5


def test_anchors_of_repeated_points_and_windows_make_no_pair_twice(spark, monkeypatch):
    made = []
    plain = raycast.front_surface
    monkeypatch.setattr(raycast, "front_surface", lambda seen, by: made.append(seen.count()) or plain(seen, by))
    camera = F.expr("struct(struct(1D as w, 0D as x, 0D as y, 0D as z) as rotation, struct(0D as x, 0D as y, 0D as z) as position, 500D as fx, 500D as fy, 500D as cx, 500D as cy, 1000D as width, 1000D as height)")
    dets = spark.range(300).select("id", F.lit(0).alias("scan"), camera.alias("camera"), F.expr("struct(490D as x0, 490D as y0, 510D as x1, 510D as y1)").alias("box"))
    points = spark.range(400).select(F.lit(0).alias("scan"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.when(F.col("id") % 4 == 0, -2.0).otherwise(-2.05).alias("z"))
    got = raycast.anchors(points, dets).collect()
    assert len(got) == 300 and all((x.x, x.y, x.z, x.n) == (0.0, 0.0, -2.05, 400) for x in got)
    assert made == [2]


def test_targets_of_one_place_count_once(spark, monkeypatch):
    monkeypatch.setattr(spatial, "SMALL_ROWS", 5)
    monkeypatch.setattr(spatial, "_nearest_by_cells", lambda *_: pytest.fail("five places are few"))
    targets = spark.range(1000).select((F.col("id") + 7).alias("id"), *[(F.col("id") % 5).cast("double").alias(a) for a in "xyz"])
    rows = spark.range(50).select(F.col("id").alias("k"), *[(F.col("id") / 10).alias(a) for a in "xyz"])
    got = {r.k: (r.near, round(r.dist, 6)) for r in spatial.nearest(rows, targets, "k").collect()}
    for k in range(50):
        dist, near = min((round(abs(k / 10 - p) * 3**0.5, 9), 7 + p) for p in range(5))
        assert got[k] == (near, round(dist, 6))


def test_names_of_tiles_from_a_million_on_are_as_in_sql(spark, sf, tmp_path):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet").where("l_orderkey < 40")
    lines.withColumn("l_orderkey", F.col("l_orderkey") + 1_234_500).unionByName(lines).write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {(r.image, r.line) for r in QUERIES["s12_metadata_lines"](spark, str(tmp_path)).collect()}
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == set(db.execute(ORACLE_SQL["s12_metadata_lines"]).fetchall()) and max(got)[0] > 1_234_500
