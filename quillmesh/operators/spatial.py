"""Joins and aggregates in space: cells instead of all pairs wherever both sides can be large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.operators.graph import components
from quillmesh.operators.lineage import checkpointed
from quillmesh.operators.parallel import joined_to_few
from quillmesh.operators.quantile import medians
from quillmesh.operators.raycast import front_surface

AXES = ("x", "y", "z")
#: Targets up to which every task holds all of them; they are counted before.
SMALL_ROWS = 1_000


def cell(radius: float, *axes: str) -> list[Column]:
    return [F.floor(F.col(a) / radius).cast("long").alias(f"c{a}") for a in axes]


def with_neighbour_cells(df: DataFrame, radius: float, axes=AXES) -> DataFrame:
    """Each row once for each of the cells around its own (27 in space)."""
    for a in axes:
        df = df.withColumn(f"c{a}", F.explode(F.array(*[F.floor(F.col(a) / radius).cast("long") + d for d in (-1, 0, 1)])))
    return df


def squared(a: str, b: str, axes=AXES) -> Column:
    return sum((F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) * (F.col(f"{a}.{k}") - F.col(f"{b}.{k}")) for k in axes)


def radius_pairs(points: DataFrame, radius: float, by: list[str], key: str = "tag_id") -> DataFrame:
    """(a, b, dist), a < b, closer than radius and equal in `by`: an equi-join on cells, so work follows local density."""
    own = points.where(" and ".join(f"{k} is not null" for k in AXES))
    left = own.select("*", *cell(radius, *AXES)).alias("p")
    right = with_neighbour_cells(own, radius).alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*by, "cx", "cy", "cz")]
    dist = F.sqrt(squared("p", "q"))
    return left.join(right, [*on, F.col(f"p.{key}") < F.col(f"q.{key}"), dist < radius]).select(F.col(f"p.{key}").alias("a"), F.col(f"q.{key}").alias("b"), dist.alias("dist"))


def nearest(rows: DataFrame, targets: DataFrame, key: str, order: str = "id", by: list[str] | None = None) -> DataFrame:
    """rows with near (id) and dist of the nearest target, the one of the lowest `order` among equals; null without one.
    Rows and targets without a finite position have none, and are none.

    Targets of one place count once. Up to SMALL_ROWS of them go to every task as one array (one for each value of `by`), and each row takes the least over
    its array: no row is made for a pair, and rows are not shuffled. More are searched in cells of growing size until a found
    target is surely the nearest.
    """
    by = by or []
    finite = " and ".join(f"{k} is not null and abs({k}) < double('infinity')" for k in AXES)
    # of targets at one place the first is the nearest, so the others ask for no work
    have = checkpointed(targets.where(finite).groupBy(*by, *AXES).agg(F.min(order).alias(order)))
    if have.limit(SMALL_ROWS + 1).count() > SMALL_ROWS:
        best = _nearest_by_cells(rows, have, key, order, by)
        return rows.join(best, rows[key] == best["_key"], "left").select(rows["*"], F.col("_best.near").alias("near"), F.col("_best.dist").alias("dist"))
    every = F.collect_list(F.struct(F.col(order).alias("near"), *AXES)).alias("_targets")
    if by:
        held = rows.join(F.broadcast(have.groupBy(*[F.col(c).alias(f"_by_{c}") for c in by]).agg(every)), [rows[c] == F.col(f"_by_{c}") for c in by], "left")
    else:
        held = rows.join(F.broadcast(have.agg(every)), how="left")
    apart = F.transform("_targets", lambda t: F.struct(F.sqrt(sum((F.col(k) - t[k]) * (F.col(k) - t[k]) for k in AXES)).alias("dist"), t["near"].alias("near")))
    best = F.when(F.expr(finite), F.array_min(apart)).alias("_best")
    return held.select(*[rows[c] for c in rows.columns], best).select(*rows.columns, F.col("_best.near").alias("near"), F.col("_best.dist").alias("dist"))


def _nearest_by_cells(rows: DataFrame, have: DataFrame, key: str, order: str, by: list[str]) -> DataFrame:
    """A target within the cell size of a row is in its cell or one next to it, so what is found within that is final.

    Cells grow fourfold until no row is left, so rounds follow the logarithm of the farthest distance.
    """
    finite = " and ".join(f"{k} is not null and abs({k}) < double('infinity')" for k in AXES)
    spread = have.agg(*[(F.max(k) - F.min(k)).alias(k) for k in AXES], F.count(F.lit(1)).alias("n")).first()
    widest = max(max(spread[k] or 0.0 for k in AXES), 1e-9)
    size = max(widest / max(1.0, spread["n"]) ** (1 / 3), widest / 2**10)
    open_rows = rows.where(finite).select(key, *by, *AXES)
    open_rows = open_rows.join(have.select(*by).distinct(), by, "left_semi") if by else open_rows.where(F.lit(spread["n"] > 0))
    dist = F.sqrt(squared("r", "t"))
    out = None
    while True:
        on = [F.col(f"r.{c}") == F.col(f"t.{c}") for c in (*by, "cx", "cy", "cz")]
        pairs = with_neighbour_cells(open_rows, size).alias("r").join(have.select("*", *cell(size, *AXES)).alias("t"), on)
        found = pairs.groupBy(F.col(f"r.{key}").alias("_key")).agg(F.min(F.struct(dist.alias("dist"), F.col(f"t.{order}").alias("near"))).alias("_best")).where(F.col("_best.dist") <= size)
        found = checkpointed(found)
        out = found if out is None else out.unionByName(found)
        open_rows = checkpointed(open_rows.join(found, open_rows[key] == found["_key"], "left_anti"))
        if open_rows.isEmpty():
            return out
        size *= 4


def in_view(cameras: DataFrame, targets: DataFrame, reach: float, slope: float) -> DataFrame:
    """Pairs of cameras (camera) and targets (at, a vector) among which are all with a depth in (0, reach] and at most `slope` times
    that to any side. Cells as wide as the reach are listed for each camera and kept where a ball around the cell reaches into its
    pyramid; targets meet the cameras of their cell. A camera's cells are so many whatever the targets."""
    far, long = reach * (1 + 2 * slope * slope) ** 0.5, (1 + slope * slope) ** 0.5
    sides = [([0.0, 0.0, -1.0], 0.0), ([0.0, 0.0, 1.0], -reach)]
    sides += [([sign / long if k == "x" else 0.0, sign / long if k == "y" else 0.0, -slope / long], 0.0) for k in "xy" for sign in (-1.0, 1.0)]
    own = cameras.withColumn("_planes", g.planes(F.col("camera"), sides))
    for a in AXES:
        at = F.col(f"camera.position.{a}")
        own = own.withColumn(f"c{a}", F.explode(F.sequence(F.floor((at - far) / reach).cast("long"), F.floor((at + far) / reach).cast("long"))))
    meets = g.reaches_in(F.col("_planes"), *[(F.col(f"c{a}") + 0.5) * reach for a in AXES], reach * 3**0.5 / 2 * (1 + 1e-9))
    cells = [F.floor(F.col(f"at.{a}") / reach).cast("long").alias(f"c{a}") for a in AXES]
    return own.where(meets).drop("_planes").join(targets.select("*", *cells), ["cx", "cy", "cz"]).drop("cx", "cy", "cz")


def clusters(points: DataFrame, radius: float, by: list[str], key: str = "tag_id") -> DataFrame:
    """points with `cluster`: the least key reachable over pairs closer than radius; a point without a position is its own."""
    roots = components(cluster_links(points, radius, by, key))
    return points.join(roots, points[key] == roots["node"], "left").select(points["*"], F.coalesce("root", key).alias("cluster"))


def cluster_links(points: DataFrame, radius: float, by: list[str], key: str) -> DataFrame:
    """(a, b) that join the points of each cluster, one for each point and each pair of cells.

    Cells are so small that all points of one are closer than the radius: they are linked to the least of their cell, and
    of two cells one pair of points that is close enough links all.
    """
    size, cells = radius * 0.577, ("cx", "cy", "cz")
    own = points.where(" and ".join(f"{k} is not null" for k in AXES)).select(F.col(key).alias("node"), *by, *AXES, *cell(size, *AXES))
    least = own.groupBy(*by, *cells).agg(F.min("node").alias("a"))
    inside = own.join(least, [*by, *cells]).where("a <> node").select("a", F.col("node").alias("b"))
    # cells up to two steps away, each pair of cells from one side
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3) if (i, j, k) > (0, 0, 0)]
    near = F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, cells, strict=True)]) for s in steps])).alias("s")
    filled = least.select(*by, *cells, near).select(*by, *cells, *[(F.col(c) + F.col(f"s.{c}")).alias(f"n{c}") for c in cells])
    pairs = filled.join(least.select(*by, *[F.col(c).alias(f"n{c}") for c in cells]), [*by, *[f"n{c}" for c in cells]])
    left = pairs.join(own, [*by, *cells]).select(*by, *cells, *[f"n{c}" for c in cells], "node", *AXES).alias("p")
    right = own.select(*by, *[F.col(c).alias(f"n{c}") for c in cells], "node", *AXES).alias("q")
    on = [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*by, *[f"n{c}" for c in cells])]
    close = left.join(right, [*on, F.sqrt(squared("p", "q")) < radius])
    across = close.groupBy(*[F.col(f"p.{c}") for c in (*by, *cells, *[f"n{c}" for c in cells])]).agg(F.min(F.struct(F.col("p.node").alias("a"), F.col("q.node").alias("b"))).alias("l"))
    return inside.unionByName(across.select("l.a", "l.b"))


def physical_tags(clustered: DataFrame, by: list[str]) -> DataFrame:
    """Each cluster as one tag: confidence-weighted place, best confidence, and what it was seen in."""
    w = F.col("confidence")
    mean = lambda k: F.when(F.sum(w) > 0, F.sum(w * F.col(k)) / F.sum(w)).otherwise(F.avg(k))
    return clustered.groupBy(*by, "cluster").agg(
        *[mean(k).alias(k) for k in AXES], F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("observations"),
        F.sort_array(F.collect_set("image")).alias("images"), F.sort_array(F.collect_set("scan")).alias("scans"),
    )


def mode_seeking(points: DataFrame, radius: float, by: list[str], key: str = "tag_id") -> DataFrame:
    """For each group the weighted mean around the point with the most weight near it (itself included), ties to the least key.

    Cells are half a radius wide: all points of one are near each other, so a cell's own weight is a lower bound of what its
    points gather, and that of the cells up to two steps away an upper one. Only points of cells whose upper bound reaches the
    best lower bound of their group are counted exactly, against the points of other cells; those of their own count as a sum.
    A group within one cell is linear. Points without a finite position take no part.
    """
    size, cells = radius / 2, ["cx", "cy", "cz"]
    finite = " and ".join(f"{k} is not null and abs({k}) < double('infinity')" for k in AXES)
    own = checkpointed(points.where(finite).select(key, *by, *AXES, "confidence", *cell(size, *AXES)))
    sums = checkpointed(own.groupBy(*by, *cells).agg(F.sum("confidence").alias("weight")))
    steps = [(i, j, k) for i in range(-2, 3) for j in range(-2, 3) for k in range(-2, 3)]
    around = lambda chosen: F.explode(F.array(*[F.struct(*[F.lit(v).alias(c) for v, c in zip(s, cells, strict=True)]) for s in chosen])).alias("s")
    spread = sums.select(*by, *cells, "weight", around(steps)).groupBy(*by, *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in cells]).agg(F.sum("weight").alias("most"))
    best = sums.groupBy(*by).agg(F.max("weight").alias("least"))
    open_cells = checkpointed(joined_to_few(sums.join(spread, [*by, *cells]), checkpointed(best), by).where("most >= least - 1e-9").select(*by, *cells, "weight"))
    asked = joined_to_few(own, open_cells, [*by, *cells])
    left = asked.select(*by, key, *AXES, *cells, around([s for s in steps if any(s)])).select(*by, key, *AXES, *[(F.col(c) + F.col(f"s.{c}")).alias(c) for c in cells]).alias("p")
    near = left.join(own.alias("q"), [F.col(f"p.{c}") == F.col(f"q.{c}") for c in (*by, *cells)]).where(F.sqrt(squared("p", "q")) < radius)
    more = near.groupBy(F.col(f"p.{key}").alias("_key")).agg(F.sum("q.confidence").alias("more"))
    scored = asked.join(more, asked[key] == more["_key"], "left").withColumn("support", F.round(F.col("weight") + F.coalesce("more", F.lit(0.0)), 9))
    centre = checkpointed(scored.groupBy(*by).agg(F.min(F.struct((-F.col("support")).alias("s"), F.col(key).alias("centre"), *AXES)).alias("m")))
    kept = joined_to_few(own, centre, by).where(F.sqrt(sum((F.col(k) - F.col(f"m.{k}")) * (F.col(k) - F.col(f"m.{k}")) for k in AXES)) < radius)
    w = F.col("confidence")
    return kept.groupBy(*by, F.col("m.centre").alias("centre")).agg(*[(F.sum(w * F.col(k)) / F.sum(w)).alias(k) for k in AXES], F.max(w).alias("confidence"), F.count(F.lit(1)).alias("kept"))


def front_surface_median(points: DataFrame, by: list[str], depth: str = "depth") -> DataFrame:
    """Exact median of each axis over the points near the closest surface, and how many they are."""
    front = checkpointed(front_surface(points.select(*by, *AXES, depth), by, depth))
    middle = medians(front, by, list(AXES)).join(front.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by)
    return middle.select(*by, *[F.round(k, 4).alias(k) for k in AXES], "n")


def depth_map(px: DataFrame, by: list[str], scales: tuple[int, ...], near: float = 1.08, more: float = 0.05) -> DataFrame:
    """(by, u, v, depth) of points (by, u, v, d): each pixel's least depth; where there is none, or it lies far behind the cell
    of the next scale, the cell's. Pixels are those of the coarsest cells that hold a point."""
    cells = {}
    finest = px.groupBy(*by, "u", "v").agg(F.min("d").alias("d"))
    for s in scales:
        cells[s] = finest.groupBy(*by, F.floor(F.col("u") / s).cast("int").alias(f"u{s}"), F.floor(F.col("v") / s).cast("int").alias(f"v{s}")).agg(F.min("d").alias(f"d{s}"))
    last = scales[-1]
    out = cells[last]
    for a in "uv":
        out = out.withColumn(a, F.explode(F.array(*[F.col(f"{a}{last}") * last + k for k in range(last)])))
    for s in scales[:-1]:
        out = out.withColumns({f"{a}{s}": F.floor(F.col(a) / s).cast("int") for a in "uv"}).join(cells[s], [*by, f"u{s}", f"v{s}"], "left")
    depth = F.col(f"d{scales[0]}")
    for s in scales[1:]:
        d = F.col(f"d{s}")
        depth = F.when((d > 0) & ((F.coalesce(depth, F.lit(0.0)) == 0) | (depth > d * near + more)), d).otherwise(depth)
    return out.select(*by, "u", "v", depth.alias("depth"))
