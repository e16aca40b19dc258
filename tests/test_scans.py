"""Medians of hot groups, points in pixel windows, views by cells: against plain loops."""

import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.operators import raycast, spatial
from quillmesh.operators.quantile import medians
from quillmesh.plans import inputs as i
from quillmesh.plans import spatial as _  # noqa: F401  it registers its queries
from quillmesh.plans.registry import QUERIES


@pytest.mark.parametrize("most", [3, 10_000])
def test_medians_of_groups_of_any_size(spark, most):
    r = random.Random(4)
    groups = {
        1: [r.gauss(0, 1) for _ in range(3000)], 2: [5.0] * 400 + [7.0] * 400, 3: [1.0], 4: [1.0, 2.0], 5: [1.0, 1.0 + 2**-52, 1.0 + 2**-51] * 5 + [1.0],
        6: [float("nan"), None, float("inf"), 3.0, 4.0], 7: [None], 8: [10.0**k for k in range(-150, 150)], 9: [0.0] * 999 + [1e300], None: [2.0, 9.0, 1.0],
    }
    rows = [(k, v, None if v is None else -v) for k, vs in groups.items() for v in vs]
    got = {x.k: (x.v, x.w) for x in medians(spark.createDataFrame(rows, "k long, v double, w double").where("k is not null"), ["k"], ["v", "w"], most).collect()}
    for k, vs in groups.items():
        own = [v for v in vs if v is not None and math.isfinite(v)]
        if k is not None and own:
            m = statistics.median(own)
            assert got[k] == (m, -m), k
    assert 7 not in got


def test_a_group_of_all_rows_is_narrowed_in_few_rounds(spark):
    rows = spark.range(60_000).select(F.lit(1).alias("k"), F.sqrt(F.col("id").cast("double")).alias("v"))
    (x,) = medians(rows, ["k"], ["v"], 200).collect()
    assert x.v == (math.sqrt(29_999) + math.sqrt(30_000)) / 2


CAMERA = "camera struct<rotation:struct<w:double,x:double,y:double,z:double>,position:struct<x:double,y:double,z:double>,fx:double,fy:double,cx:double,cy:double,width:double,height:double>"


def camera(r):
    q = [r.gauss(0, 1) for _ in range(4)]
    n = math.sqrt(sum(v * v for v in q))
    return (tuple(v / n for v in q), tuple(r.uniform(-3, 3) for _ in range(3)), 400.0, 450.0, 320.0, 240.0, 640.0, 480.0)


def projected(cam, p):
    (w, x, y, z), at, fx, fy, cx, cy, _, _ = cam
    m = np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]])
    a, b, c = (np.array(p) - np.array(at)) @ m * (1, -1, -1)
    return float(fx * a / c + cx), float(fy * b / c + cy), float(c)


@pytest.mark.parametrize("few", [True, False])
def test_anchors_equal_a_loop_over_all_points(spark, monkeypatch, few):
    r = random.Random(11)
    points = [(k % 3, *(round(r.uniform(-30, 30), 1) if k % 4 else round(r.uniform(-3, 3), 2) for _ in range(3))) for k in range(2500)]
    points += [(0, None, 1.0, 1.0), (0, float("nan"), 0.0, 0.0), (None, 1.0, 1.0, 1.0), *points[:50]]
    found = []
    for k in range(60):
        while True:
            cam, aim = camera(r), r.choice([p for p in points[:2500] if p[0] == k % 3])
            u, v, d = projected(cam, aim[1:])
            if k % 5 == 0 or (d > 0.5 and 0 < u < 640 and 0 < v < 480):
                break
        found.append((k, k % 3, cam, None if k % 17 == 5 else (u - 5 + r.uniform(-3, 3), v - 5, u + 5, v + 5 + r.uniform(-3, 3))))
    found.append((99, None, camera(r), (0.0, 0.0, 9.0, 9.0)))
    if not few:
        monkeypatch.setattr(raycast, "few", lambda df, rows=0: df)
    dets = spark.createDataFrame(found, f"id long, scan int, {CAMERA}, box struct<x0:double,y0:double,x1:double,y1:double>")
    got = {x.id: x for x in raycast.anchors(spark.createDataFrame(points, "scan int, x double, y double, z double"), dets).collect()}
    hits = 0
    for k, scan, cam, box in found:
        near = []
        for s, *p in points:
            if box and scan is not None and s == scan and None not in p and all(map(math.isfinite, p)):
                u, v, d = projected(cam, p)
                if d > 0.3 and 0 <= u < 640 and 0 <= v < 480 and abs(u - (box[0] + box[2]) / 2) < 4 and abs(v - (box[1] + box[3]) / 2) < 4:
                    near.append((d, p))
        least = min((d for d, _ in near), default=0)
        front = [p for d, p in near if d < least * 1.05 + 0.03]
        assert got[k].n == len(front)
        if front:
            hits += 1
            assert np.allclose([got[k].x, got[k].y, got[k].z], np.median(front, axis=0), atol=1e-4)
        else:
            assert got[k].x is None
    assert hits > 15


def test_views_by_cells_lose_no_pair_and_join_on_keys(spark):
    r = random.Random(2)
    cams = spark.createDataFrame([(k, camera(r)) for k in range(25)], f"id long, {CAMERA}")
    targets = spark.createDataFrame([(k, tuple(r.uniform(-20, 20) for _ in range(3))) for k in range(400)], "t long, at struct<x:double,y:double,z:double>")
    c = g.to_camera(F.col("at"), F.col("camera.position"), F.col("camera.rotation"))
    wanted = (c["z"] > 0) & (c["z"] <= 6) & (F.abs(c["x"]) <= 0.9 * c["z"]) & (F.abs(c["y"]) <= 0.9 * c["z"])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        near = spatial.in_view(cams, targets, 6.0, 0.9)
        plan = near._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        got = near.where(wanted).select("id", "t")
        every = cams.crossJoin(targets).where(wanted).select("id", "t")
        assert got.count() == every.count() > 20 and got.exceptAll(every).count() == 0
        assert near.count() < 0.3 * 25 * 400
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("small", [0, 1_000])
def test_targets_without_a_finite_position_are_none_either_way(spark, monkeypatch, small):
    monkeypatch.setattr(spatial, "SMALL_ROWS", small)
    inf, nan = float("inf"), float("nan")
    targets = spark.createDataFrame([(1, inf, 0.0, 0.0), (2, nan, 0.0, 0.0), (3, 5.0, 0.0, 0.0), (4, None, 0.0, 0.0)], "id long, x double, y double, z double")
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, inf, 0.0, 0.0), (3, nan, 0.0, 0.0), (4, None, 1.0, 1.0)], "k long, x double, y double, z double")
    got = {r.k: (r.near, r.dist) for r in spatial.nearest(rows, targets, "k").collect()}
    assert got == {1: (3, 5.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_no_view_query_needs_a_cross_join(spark, sf):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for name in ("j13_visible_cabinets", "a13_photo_category", "p14_photos_of_cabinet", "p7_visibility_reasons"):
            plan = QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan, name
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_cameras_see_the_cabinets_that_a_loop_finds(spark, sf):
    cams = i.cameras(spark, sf).count()
    assert QUERIES["p7_visibility_reasons"](spark, sf).count() == cams


@pytest.mark.parametrize("spread", [0.01, 0.4, 3.0])
def test_most_weight_within_a_radius(spark, spread):
    r = random.Random(8)
    rows = [(k, "ab"[k % 2], r.gauss(0, spread), r.gauss(0, spread), r.gauss(0, spread), round(r.random(), 2)) for k in range(240)]
    df = spark.createDataFrame(rows + [(900, "a", None, 0.0, 0.0, 99.0), (901, "b", float("nan"), 0.0, 0.0, 99.0)], "tag_id long, label string, x double, y double, z double, confidence double")
    got = {x.label: x for x in spatial.mode_seeking(df, 0.5, ["label"]).collect()}
    for label in "ab":
        own = [row for row in rows if row[1] == label]
        near = {row[0]: [o for o in own if math.dist(row[2:5], o[2:5]) < 0.5] for row in own}
        centre = min(own, key=lambda row: (-round(sum(o[5] for o in near[row[0]]), 9), row[0]))[0]
        kept, x = near[centre], got[label]
        total = sum(o[5] for o in kept)
        assert (x.centre, x.kept, x.confidence) == (centre, len(kept), max(o[5] for o in kept))
        assert abs(x.y - sum(o[5] * o[3] for o in kept) / total) < 1e-9
