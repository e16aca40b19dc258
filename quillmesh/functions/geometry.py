"""Camera and box geometry as column expressions, so that it stays inside whole-stage code generation.

Vectors are structs (x, y, z), quaternions structs (w, x, y, z), boxes structs (x0, y0, x1, y1), cameras structs (pose
`rotation` and `position`, `fx`, `fy`, `cx`, `cy`, `width`, `height`). A null in gives a null out.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def vec(x, y, z) -> Column:
    """A vector, or null if any part is null."""
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(sum((a[k] - b[k]) * (a[k] - b[k]) for k in "xyz"))


def unit_quaternion(w: Column, x: Column, y: Column, z: Column) -> Column:
    """Normalised; a zero quaternion becomes the identity."""
    n = F.sqrt(w * w + x * x + y * y + z * z)
    zero = n == 0
    part = lambda v, at_zero: F.when(zero, F.lit(at_zero)).otherwise(v / n)
    return F.struct(part(w, 1.0).alias("w"), part(x, 0.0).alias("x"), part(y, 0.0).alias("y"), part(z, 0.0).alias("z"))


def rotation(q: Column) -> list[list[Column]]:
    """The 3 x 3 matrix of a unit quaternion, as nine expressions."""
    w, x, y, z = (q[k] for k in "wxyz")
    return [
        [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
        [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
        [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
    ]


AXES = {"x": (0, 1), "y": (1, 1), "z": (2, 1), "-x": (0, -1), "-y": (1, -1), "-z": (2, -1)}


def forward(q: Column, axis: str = "-z") -> Column:
    """Where the given camera axis points in the world."""
    if axis not in AXES:
        raise ValueError(f"unknown axis {axis!r}; one of {', '.join(AXES)}")
    k, sign = AXES[axis]
    m = rotation(q)
    return F.struct(*[(sign * m[i][k]).alias("xyz"[i]) for i in range(3)])


def yaw(v: Column) -> Column:
    """Degrees in [0, 360)."""
    deg = F.degrees(F.atan2(v["y"], v["x"]))
    return F.when(deg < 0, deg + 360).otherwise(deg)


def pitch(v: Column) -> Column:
    return F.degrees(F.atan2(v["z"], F.sqrt(v["x"] * v["x"] + v["y"] * v["y"])))


def angular_difference(a: Column, b: Column) -> Column:
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


def sector(yaw_degrees: Column, sectors: int = 6) -> Column:
    return F.floor(F.pmod(yaw_degrees, F.lit(360.0)) / (360.0 / sectors)).cast("int")


def to_camera(point: Column, position: Column, q: Column) -> Column:
    """World to camera axes: x right, y down, z ahead."""
    m, d = rotation(q), [point[k] - position[k] for k in "xyz"]
    turned = [sum(m[i][j] * d[i] for i in range(3)) for j in range(3)]
    return F.struct(turned[0].alias("x"), (-turned[1]).alias("y"), (-turned[2]).alias("z"))


def project(point: Column, camera: Column, nearest: float = 0.05) -> Column:
    """Pixel (u, v) and depth; null at or behind the nearest depth."""
    c = to_camera(point, camera["position"], camera["rotation"])
    u, v = camera["fx"] * c["x"] / c["z"] + camera["cx"], camera["fy"] * c["y"] / c["z"] + camera["cy"]
    return F.when(c["z"] > nearest, F.struct(u.alias("u"), v.alias("v"), c["z"].alias("depth")))


def ray(u: Column, v: Column, camera: Column) -> Column:
    """The unit ray of a pixel in the world."""
    a, b = (u - camera["cx"]) / camera["fx"], (v - camera["cy"]) / camera["fy"]
    n, m = F.sqrt(a * a + b * b + 1), rotation(camera["rotation"])
    own = [a / n, -b / n, -1 / n]
    return F.struct(*[sum(m[i][j] * own[j] for j in range(3)).alias("xyz"[i]) for i in range(3)])


def along(position: Column, direction: Column, length: Column) -> Column:
    return F.struct(*[(position[k] + direction[k] * length).alias(k) for k in "xyz"])


def meets_plane_x(position: Column, direction: Column, at_x: Column, digits: int = 3) -> Column:
    """Where a ray meets the plane x = at_x, rounded; null if parallel or behind."""
    t = (at_x - position["x"]) / direction["x"]
    return F.when((F.abs(direction["x"]) >= 1e-6) & (t > 0), F.struct(*[F.round(position[k] + t * direction[k], digits).alias(k) for k in "xyz"]))


def planes(camera: Column, sides: list[tuple[list, float]]) -> Column:
    """World planes (x, y, z, d) of sides given in camera axes (a unit normal that points outward, and what is added): see `reaches_in`."""
    m, out = rotation(camera["rotation"]), []
    for n, d in sides:
        world = [m[i][0] * n[0] - m[i][1] * n[1] - m[i][2] * n[2] for i in range(3)]
        away = sum(w * camera["position"][a] for w, a in zip(world, "xyz", strict=True))
        out.append(F.struct(*[w.alias(a) for w, a in zip(world, "xyz", strict=True)], (F.lit(d) - away).alias("d")))
    return F.array(*out)


def reaches_in(planes: Column, x: Column, y: Column, z: Column, radius: float) -> Column:
    """Whether no plane has the ball around a point wholly outside."""
    return F.forall(planes, lambda p: p["x"] * x + p["y"] * y + p["z"] * z + p["d"] < radius)


def view_angle(a: Column, b: Column) -> Column:
    """Degrees between unit vectors."""
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b)))))


def in_frame(pixel: Column, width: Column, height: Column, margin: float = 0.0) -> Column:
    return (pixel["u"] >= -margin) & (pixel["u"] < width + margin) & (pixel["v"] >= -margin) & (pixel["v"] < height + margin)


def box(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    return F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1"))


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersect(a: Column, b: Column) -> Column:
    return box(F.greatest(a["x0"], b["x0"]), F.greatest(a["y0"], b["y0"]), F.least(a["x1"], b["x1"]), F.least(a["y1"], b["y1"]))


def iou(a: Column, b: Column) -> Column:
    """Intersection over union; 0 where both are empty."""
    common = area(intersect(a, b))
    union = area(a) + area(b) - common
    return F.when(union > 0, common / union).otherwise(F.lit(0.0))


def clip(b: Column, width: Column, height: Column) -> Column:
    return intersect(b, box(F.lit(0.0), F.lit(0.0), width, height))


def visible_fraction(b: Column, width: Column, height: Column) -> Column:
    return F.when(area(b) > 0, area(clip(b, width, height)) / area(b)).otherwise(F.lit(0.0))


def xywh_to_box(x: Column, y: Column, w: Column, h: Column) -> Column:
    return box(x, y, x + w, y + h)


def yolo(b: Column, width: Column, height: Column) -> Column:
    """Centre and size as shares of the frame."""
    return F.struct(((b["x0"] + b["x1"]) / 2 / width).alias("cx"), ((b["y0"] + b["y1"]) / 2 / height).alias("cy"), ((b["x1"] - b["x0"]) / width).alias("w"), ((b["y1"] - b["y0"]) / height).alias("h"))


def scaled(b: Column, factor: Column) -> Column:
    return box(*[b[k] * factor for k in ("x0", "y0", "x1", "y1")])


def depth_band(depth: Column, near: float = 1.5, far: float = 3.5) -> Column:
    return F.when(depth < near, "near").when(depth < far, "mid").when(depth.isNotNull(), "far")


def door_normal(x: Column, limit: float = -4.0) -> Column:
    return F.when(x < limit, F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0))).when(x.isNotNull(), F.array(F.lit(-1.0), F.lit(0.0), F.lit(0.0)))


def tile_origins(size: Column, tile: int = 1280, stride: int = 960) -> Column:
    """Origins along one side; the last tile is flush with the end."""
    last = F.greatest(F.lit(0), size - tile)
    return F.array_sort(F.array_distinct(F.concat(F.filter(F.sequence(F.lit(0), last, F.lit(stride)), lambda x: x <= last), F.array(last))))
