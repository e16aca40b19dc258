"""Order-dependent selection inside one image: candidates are relational, only the greedy step is a kernel.

Rows are dealt out by group and sorted by Spark; a task then streams through them in Arrow batches, group after group, so
small groups cost no call each and a task holds one group at most.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import geometry as g
from quillmesh.operators.lineage import checkpointed
from quillmesh.operators.parallel import few, joined_to_few

#: Boxes of a group that one task suppresses; a larger group is settled in rounds first.
GROUP_BOXES = 20_000
#: Cells around kept boxes that go to every task, once they are counted.
FEW_STRIKES = 200_000


def select_in_groups(df: DataFrame, by: list[str], order: list[Column], columns: list[str], choose: Callable[..., list[int]]) -> DataFrame:
    """The rows that `choose` takes of each group: it gets the group's values of `columns`, in order, and returns places."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def taken(table: pa.Table, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
            values, keep, start = [table[c].to_pylist() for c in columns], [], 0
            for end in ends.tolist():
                keep += [start + k for k in choose(*(v[start:end] for v in values))]
                start = end
            yield from table.take(pa.array(keep, pa.int64())).to_batches()

        for batch in batches:
            part = pa.Table.from_batches([batch])
            held = part if held is None else pa.concat_tables([held, part])
            if not held.num_rows:
                continue
            change = np.zeros(held.num_rows - 1, bool)
            for k in by:
                v = np.asarray(held[k])
                change |= v[1:] != v[:-1]
            ends = np.flatnonzero(change) + 1
            if len(ends):  # the last group may go on in the next batch
                cut = int(ends[-1])
                yield from taken(held.slice(0, cut), ends)
                held = held.slice(cut)
        if held is not None and held.num_rows:
            yield from taken(held, np.array([held.num_rows]))

    return df.repartition(*by).sortWithinPartitions(*by, *order).mapInArrow(run, df.schema).select(*names)


def _iou(a: tuple, b: tuple) -> float:
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    if w <= 0 or h <= 0:
        return 0.0
    return w * h / ((a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h)


def kept_boxes(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, limit: float) -> list[int]:
    """Places of the boxes, best first, that overlap no kept one by more than the limit: each kept box strikes out those behind it."""
    area, left, out = (x1 - x0) * (y1 - y0), np.arange(len(x0)), []
    while len(left):
        k, left = left[0], left[1:]
        out.append(int(k))
        w = np.minimum(x1[left], x1[k]) - np.maximum(x0[left], x0[k])
        h = np.minimum(y1[left], y1[k]) - np.maximum(y0[left], y0[k])
        common = np.where((w > 0) & (h > 0), w * h, 0.0)
        union = area[left] + area[k] - common
        left = left[np.divide(common, union, out=np.zeros_like(common), where=union > 0) <= limit]
    return out


def non_maximum_suppression(boxes: DataFrame, by: list[str], limit: float = 0.5, tie: str = "n", most: int | None = None) -> DataFrame:
    """The boxes of each group, best score first, that overlap no kept one by more than `limit`; ties by `tie`, which tells boxes apart.

    A group of up to GROUP_BOXES is one task's. In a larger one boxes are settled in rounds on a grid until so many are left.
    """
    most, groups = GROUP_BOXES if most is None else most, boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    large = checkpointed(groups.where(F.col("_n") > most))
    done = []
    if not large.isEmpty():
        sized = joined_to_few(boxes, large, by, "left")
        boxes, open_boxes = sized.where("_n is null").drop("_n"), checkpointed(sized.where("_n is not null").drop("_n"))
        while not large.isEmpty():
            open_boxes, kept = _settled(open_boxes, by, limit, tie)
            done.append(kept)
            large = checkpointed(open_boxes.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most))
        boxes = boxes.unionByName(open_boxes)

    def keep(*sides: list[float]) -> list[int]:
        if len(sides[0]) > 16:
            return kept_boxes(*[np.array(s, np.float64) for s in sides], limit)
        out: list[int] = []
        all_boxes = list(zip(*sides, strict=True))
        for k, box in enumerate(all_boxes):
            if all(_iou(all_boxes[j], box) <= limit for j in out):
                out.append(k)
        return out

    chosen = select_in_groups(boxes, by, [boxes["score"].desc(), boxes[tie].asc()], ["x0", "y0", "x1", "y1"], keep)
    for kept in done:
        chosen = chosen.unionByName(kept)
    return chosen


def _settled(boxes: DataFrame, by: list[str], limit: float, tie: str) -> tuple[DataFrame, DataFrame]:
    """A round: (boxes still open, boxes kept).

    A box lies in the cell of its centre, on a grid as coarse as its width and height in powers of two; what may overlap it by
    more than the limit lies in cells near it, on grids a step or two finer or coarser. The best box of a cell is kept
    if none of those it overlaps is better, and they are struck out. A cell sends one box a round.
    """
    names, steps = boxes.columns, max(1, math.ceil(-math.log2(max(limit, 1e-3))))
    cells = ["_lx", "_ly", "_cx", "_cy"]
    level = lambda a, b: F.coalesce(F.floor(F.log2(F.when(F.col(b) > F.col(a), F.col(b) - F.col(a)))), F.lit(-60)).cast("long")
    own = boxes.withColumns({"_lx": level("x0", "x1"), "_ly": level("y0", "y1")})
    for k in "xy":
        own = own.withColumn(f"_c{k}", F.floor((F.col(f"{k}0") + F.col(f"{k}1")) / 2 / F.pow(F.lit(2.0), F.col(f"_l{k}"))).cast("long"))
    own = checkpointed(own)
    rank = F.struct("score", (-F.col(tie)).alias("tie"))
    best = own.groupBy(*by, *cells).agg(F.max(F.struct(rank.alias("rank"), "x0", "y0", "x1", "y1")).alias("m")).select(*by, *cells, "m.*")
    near = best
    for k in "xy":
        span = F.col(f"{k}1") - F.col(f"{k}0")
        near = near.withColumn(f"_l{k}", F.explode(F.sequence(F.col(f"_l{k}") - steps, F.col(f"_l{k}") + steps)))
        size = F.pow(F.lit(2.0), F.col(f"_l{k}"))
        middle, reach = (F.col(f"{k}0") + F.col(f"{k}1")) / 2, (span + 2 * size) / 2
        near = near.withColumn(f"_c{k}", F.explode(F.sequence(F.floor((middle - reach) / size).cast("long"), F.floor((middle + reach) / size).cast("long"))))
    overlap = g.iou(F.struct("x0", "y0", "x1", "y1"), F.struct(*[F.col(f"_{s}").alias(s) for s in ("x0", "y0", "x1", "y1")])) > limit
    on = lambda t: [own[c].eqNullSafe(t[c]) for c in [*by, *cells]] + [overlap]
    around = checkpointed(near.select(*by, *cells, F.col("rank").alias("_rank"), *[F.col(s).alias(f"_{s}") for s in ("x0", "y0", "x1", "y1")]))
    asks = few(around, FEW_STRIKES)
    beaten = own.join(asks, [*on(asks), rank > F.col("_rank")]).select(*[own[c] for c in by], F.col("_rank").alias("rank")).distinct()
    winners = checkpointed(best.select(*by, "rank").join(beaten, [*by, "rank"], "left_anti"))
    strikes = few(around.join(winners.withColumnRenamed("rank", "_rank"), [*by, "_rank"], "left_semi"), FEW_STRIKES)
    kept = checkpointed(own.join(few(winners, FEW_STRIKES), [own[c].eqNullSafe(winners[c]) for c in by] + [rank == winners["rank"]], "left_semi").select(*names))
    still = own.join(strikes, on(strikes), "left_anti").join(few(winners, FEW_STRIKES), [own[c].eqNullSafe(winners[c]) for c in by] + [rank == winners["rank"]], "left_anti")
    return checkpointed(still.select(*names)), kept


def assign_greedily(candidates: DataFrame, image: str, detection: str, target: str, conf: str, overlap: str) -> DataFrame:
    """Of each image's candidate pairs: detections by falling confidence take their best target that is still free."""

    def choose(detections: list, targets: list) -> list[int]:
        used, done, out = set(), set(), []
        for k, (d, t) in enumerate(zip(detections, targets, strict=True)):
            if d not in done and t not in used:
                done.add(d)
                used.add(t)
                out.append(k)
        return out

    c = candidates
    return select_in_groups(c, [image], [c[conf].desc(), c[detection].asc(), c[overlap].desc(), c[target].asc()], [detection, target], choose)
