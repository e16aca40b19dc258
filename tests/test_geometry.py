import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.functions import text as t

SIDES = ("x0", "y0", "x1", "y1")


def numbers(n, *shape):
    return np.random.default_rng(n).normal(size=shape).round(6).tolist()


def test_rotations_are_orthonormal_and_zero_is_the_identity(spark):
    df = spark.createDataFrame([*map(tuple, numbers(1, 50, 4)), (0.0, 0.0, 0.0, 0.0)], "w double, x double, y double, z double")
    m = g.rotation(F.col("q"))
    out = df.select(g.unit_quaternion(*[F.col(k) for k in "wxyz"]).alias("q")).select(*[m[i][j] for i in range(3) for j in range(3)]).collect()
    for r in out:
        a = np.array(r).reshape(3, 3)
        assert np.allclose(a @ a.T, np.eye(3), atol=1e-9) and math.isclose(np.linalg.det(a), 1, abs_tol=1e-9)
    assert np.allclose(np.array(out[-1]).reshape(3, 3), np.eye(3))


def test_projecting_and_going_back_along_the_ray_meet(spark):
    rows = [(*q, *p, *x) for q, p, x in zip(numbers(2, 40, 4), numbers(3, 40, 3), numbers(4, 40, 3), strict=True)]
    names = [f"{a}{k}" for a, ks in (("q", "wxyz"), ("p", "xyz"), ("t", "xyz")) for k in ks]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names))
    vec = lambda a: F.struct(*[F.col(f"{a}{k}").alias(k) for k in "xyz"])
    camera = F.struct(g.unit_quaternion(*[F.col(f"q{k}") for k in "wxyz"]).alias("rotation"), vec("p").alias("position"), *[F.lit(v).alias(k) for k, v in (("fx", 500.0), ("fy", 400.0), ("cx", 320.0), ("cy", 240.0))])
    df = df.select(camera.alias("c"), vec("t").alias("t"))
    df = df.select("c", "t", g.project(F.col("t"), F.col("c")).alias("px")).where("px is not null")
    back = g.along(F.col("c.position"), g.ray(F.col("px.u"), F.col("px.v"), F.col("c")), g.distance(F.col("t"), F.col("c.position")))
    out = df.select(g.distance(back, F.col("t")).alias("d")).collect()
    assert len(out) > 5 and max(r.d for r in out) < 1e-9


def test_iou_is_symmetric_and_one_of_itself(spark):
    r = np.random.default_rng(5).integers(0, 50, (60, 4)).astype(float)
    r[:, 2:] += r[:, :2] + 1
    rows = [(*a, *b) for a, b in zip(r.tolist(), r[::-1].tolist(), strict=True)]
    df = spark.createDataFrame(rows, ", ".join(f"{s}{k} double" for s in "ab" for k in SIDES))
    a, b = (F.struct(*[F.col(f"{s}{k}").alias(k) for k in SIDES]) for s in "ab")
    for one, other, same in df.select(g.iou(a, b), g.iou(b, a), g.iou(a, a)).collect():
        assert one == other and 0 <= one <= 1 and same == 1


@pytest.mark.parametrize(("a", "b", "apart"), [(0.0, 360.0, 0), (350.0, 10.0, 20), (10.0, 190.0, 180), (0.0, 270.0, 90)])
def test_angles_wrap(spark, a, b, apart):
    assert spark.range(1).select(g.angular_difference(F.lit(a), F.lit(b))).first()[0] == apart


def test_edges_behind_parallel_and_unknown_axis(spark):
    one = spark.range(1)
    camera = F.struct(g.unit_quaternion(*[F.lit(float(v)) for v in (1, 0, 0, 0)]).alias("rotation"), g.vec(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("position"), *[F.lit(1.0).alias(k) for k in ("fx", "fy", "cx", "cy")])
    df = one.select(camera.alias("c"))
    assert df.select(g.project(g.vec(F.lit(0.0), F.lit(0.0), F.lit(1.0)), F.col("c"))).first()[0] is None
    assert df.select(g.project(g.vec(F.lit(0.0), F.lit(0.0), F.lit(-1.0)), F.col("c"))).first()[0].depth == 1
    ahead = g.vec(F.lit(0.0), F.lit(0.0), F.lit(-1.0))
    assert df.select(g.meets_plane_x(F.col("c.position"), ahead, F.lit(3.0))).first()[0] is None
    assert one.select(g.vec(F.lit(1.0), F.lit(None).cast("double"), F.lit(1.0))).first()[0] is None
    with pytest.raises(ValueError):
        g.forward(F.col("q"), "w")


def test_tiles_end_flush(spark):
    for size, expected in ((1000, [0]), (1280, [0]), (2000, [0, 720]), (4096, [0, 960, 1920, 2816])):
        assert spark.range(1).select(g.tile_origins(F.lit(size))).first()[0] == expected


def test_question_terms_keep_order_and_repeats(spark):
    df = spark.createDataFrame([("What is the relay RELAY of the model_X?",), ("of the",), (None,)], "q string")
    assert [r[0] for r in df.select(t.question_terms(F.col("q"), F.array(F.lit("model_x")))).collect()] == [["relay", "relay"], [], None]
