"""Connected components of a graph that is never on one machine, and minima of groups of any size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.lineage import checkpointed

#: Parts into which the rows of every key are dealt, so that no task holds all rows of one.
PARTS = 64
#: Links that one task joins by itself, once they are counted; more go in rounds.
TASK_LINKS = 1 << 20


def with_least(rows: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """rows and, under `name`, the least value of their key. A key's rows meet in parts; only the parts' minima meet under the key."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(value), F.lit(PARTS)))
    minima = dealt.groupBy(key, "_part").agg(F.min(value).alias("_low"))
    least = minima.groupBy(key).agg(F.min("_low").alias(name))
    return dealt.join(minima.select(key, "_part").join(least, key), [key, "_part"]).drop("_part")


def joined_by_parts(rows: DataFrame, table: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """rows joined with a table of one row for each key, both of any size. A key's rows, told apart by `by`, meet the table in
    parts; only a row for each key and part meets it under the key."""
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(by), F.lit(PARTS)))
    parts = dealt.groupBy(key, "_part").agg(F.count(F.lit(1)).alias("_n")).drop("_n").join(table, key)
    return dealt.join(parts, [key, "_part"], how).drop("_part")


def components(links: DataFrame) -> DataFrame:
    """(node, root) for the nodes of links (a, b): root is the smallest node that can be reached.

    Up to TASK_LINKS links are joined by one task. More are made into stars in turn: every node links its smaller neighbours
    and itself to the least of them, then its larger neighbours to the least of all. Links become fewer, and in a logarithmic
    number of rounds each component is one star around its smallest node. Each round is written to the shared folder; a node
    of very many links is dealt out in parts.
    """
    edges = checkpointed(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _mark(edges)
    while before[0] > TASK_LINKS:
        low = with_least(edges, "u", "v", "m")  # v < u: to the smaller
        edges = low.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        high = with_least(both, "u", "v", "m").where("v > u")
        edges = checkpointed(high.select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())
        now = _mark(edges)
        if now == before:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        before = now
    return edges.repartition(1).mapInArrow(_joined, "node long, root long")


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = [(np.asarray(b.column(0), np.int64), np.asarray(b.column(1), np.int64)) for b in batches if b.num_rows]
    if held:
        u, v = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        nodes, root = forest(u, v)
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(root)], ["node", "root"])


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of links, sorted, and for each the smallest node that it reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        for k in (x, y, root[x], root[y]):
            np.minimum.at(new, k, low)
        new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _mark(edges: DataFrame) -> tuple:
    """Tells sets of links apart."""
    return tuple(edges.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))"), F.sum((F.xxhash64("v", "u") % 1_000_003))).first())
