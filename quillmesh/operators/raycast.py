"""From a detection in a picture to its place in the room: the points of a scan that a pixel window sees.

A window of pixels is a thin pyramid that begins at the camera. The cloud is tiled on several levels, each tile of one holding
those of the next inside it; a window meets the coarsest tiles of its scan, then only the tiles inside those that its
pyramid touches, and at last the points of the finest that are left. A tile is touched unless the ball around it lies outside
one of the pyramid's planes, so no point is lost; points are projected for the windows of their own tile alone. Points of one
place are one row with their number, and detections with one window ask once: work follows distinct places and windows.

Cases: a detection whose window sees no point, or that has no box, camera or scan, has no anchor (null); points without a
finite position are not seen; points at the picture's right or lower edge, on the window's border or within 0.3 m are outside;
repeated points count as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.operators.lineage import checkpointed
from quillmesh.operators.parallel import few, joined_to_few, over_cores
from quillmesh.operators.quantile import medians

#: Sides of the tiles, in metres, each a whole multiple of the next. A scan's reach is a few of the first.
SIDES = (32.0, 8.0, 2.0, 0.5)
NEAREST = 0.3
#: Touched tiles that go to every task, so that the cloud is not shuffled; they are counted before.
FEW_TILES = 200_000
AXES = ("x", "y", "z")


def tile(side: float, *axes: Column) -> list[Column]:
    return [F.floor(a / side).cast("long") for a in axes]


def windows(detections: DataFrame, key: str) -> DataFrame:
    """key, scan, camera, the window (max(4, 0.4 % of the width) around the box's centre) and the planes of its pyramid."""
    reach = F.greatest(F.lit(4.0), F.col("camera.width") * 0.004)
    u, v = (F.col("box.x0") + F.col("box.x1")) / 2, (F.col("box.y0") + F.col("box.y1")) / 2
    out = detections.select(key, "scan", "camera", u.alias("mu"), v.alias("mv"), reach.alias("reach"))
    return out.where("scan is not null and camera is not null and mu is not null and mv is not null").withColumn("planes", planes())


def planes() -> Column:
    """The planes of a window's pyramid."""
    cam, sides = F.col("camera"), [([0.0, 0.0, -1.0], NEAREST)]
    for k, (middle, f, at) in enumerate((("mu", "fx", "cx"), ("mv", "fy", "cy"))):
        for sign in (-1.0, 1.0):
            slope = (F.col(middle) + sign * F.col("reach") - cam[at]) / cam[f]
            long = F.sqrt(1 + slope * slope)
            n = [F.lit(0.0), F.lit(0.0), -sign * slope / long]
            n[k] = sign / long
            sides.append((n, 0.0))
    return g.planes(cam, sides)


def seen_points(points: DataFrame, detections: DataFrame, key: str = "id", sides: tuple[float, ...] = SIDES) -> DataFrame:
    """key, x, y, z, depth of the points (scan, x, y, z) in the window of each detection (key, scan, camera, box), with what else the points have."""
    finite = " and ".join(f"{a} is not null and abs({a}) < double('infinity')" for a in AXES)
    finest, more = sides[-1], [c for c in points.columns if c not in ("scan", *AXES)]
    own = points.where(f"scan is not null and {finite}").select("scan", *AXES, *more, *[t.alias(f"t{a}") for t, a in zip(tile(finest, *map(F.col, AXES)), AXES, strict=True)])
    filled = checkpointed(own.select("scan", *[f"t{a}" for a in AXES]).distinct())
    asked, at = checkpointed(windows(detections, key)), None
    for level, side in enumerate(sides):
        steps = round(side / finest)
        tiles = filled.select("scan", *[F.floor(F.col(f"t{a}") / steps).alias(f"n{a}") for a in AXES]).distinct()
        if at is None:
            pairs = asked.join(few(tiles), "scan")
        else:
            ratio = round(sides[level - 1] / side)
            inner = tiles.select("*", *[F.floor(F.col(f"n{a}") / ratio).alias(f"o{a}") for a in AXES])
            pairs = at.join(inner, ["scan", "ox", "oy", "oz"])
        ball = side * 3**0.5 / 2 * (1 + 1e-9)
        hit = pairs.where(g.reaches_in(F.col("planes"), *[(F.col(f"n{a}") + 0.5) * side for a in AXES], ball))
        at = hit.select(key, "scan", "planes", *[F.col(f"n{a}").alias(f"o{a}") for a in AXES])
    tiles = at.select(key, *[F.col(f"o{a}").alias(f"t{a}") for a in AXES])
    at = checkpointed(tiles.join(asked.drop("planes"), key))
    near = own.join(few(at, FEW_TILES), ["scan", *[f"t{a}" for a in AXES]])
    px = near.withColumn("px", g.project(F.struct(*AXES), F.col("camera"), NEAREST))
    in_window = (F.abs(F.col("px.u") - F.col("mu")) < F.col("reach")) & (F.abs(F.col("px.v") - F.col("mv")) < F.col("reach"))
    return px.where(g.in_frame(F.col("px"), F.col("camera.width"), F.col("camera.height")) & in_window).select(key, *AXES, *more, F.col("px.depth").alias("depth"))


def front_surface(seen: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """The rows near the closest surface of their group: depth < 1.05 least + 0.03."""
    least = checkpointed(seen.groupBy(*by).agg(F.min(depth).alias("_least")))
    return joined_to_few(seen, least, by).where(F.col(depth) < F.col("_least") * 1.05 + 0.03).drop("_least")


def anchors(points: DataFrame, detections: DataFrame, key: str = "id") -> DataFrame:
    """key, x, y, z (medians of the front surface, four digits; null where nothing is seen) and n, the points they rest on."""
    view = ["scan", "camera", "box"]
    places = over_cores(checkpointed(points.groupBy("scan", *AXES).agg(F.count(F.lit(1)).alias("n"))))
    views = over_cores(checkpointed(detections.where(" and ".join(f"{c} is not null" for c in view)).groupBy(*view).agg(F.min(key).alias("_view"))))
    front = over_cores(checkpointed(front_surface(checkpointed(seen_points(places, views, "_view")), ["_view"])))
    middle = medians(front, ["_view"], list(AXES), weight="n").join(front.groupBy("_view").agg(F.sum("n").alias("n")), "_view")
    out = detections.select(key, *view).join(views.join(middle, "_view"), view, "left")
    return out.select(key, *[F.round(a, 4).alias(a) for a in AXES], F.coalesce("n", F.lit(0)).alias("n"))
