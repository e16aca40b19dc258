"""Exact nearest vectors, and how well they retrieve."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators.lineage import checkpointed, new_folder
from quillmesh.sources.files import listed, located

#: Vectors around which the rows are gathered in balls: one for so many rows, PIVOTS at most, sampled by a hash of the key. Every
#: row is in a ball; the pivots decide what is read, never the result.
PIVOT_ROWS, PIVOTS = 4096, 512
#: Rows of a ball that one task writes; a larger ball is written by several.
BALL_ROWS = 1 << 18
#: Queries searched together and rows read at a time: a task's scores are a matrix of one by the other.
BLOCK, BATCH = 1024, 2048
#: Scores are compared after so many digits; bounds leave more room than rounding does.
DIGITS, ROOM = 12, 1e-9


def unit(vectors: np.ndarray) -> np.ndarray:
    n = np.sqrt((vectors * vectors).sum(1, keepdims=True))
    return np.divide(vectors, n, out=np.zeros_like(vectors), where=n > 0)


def _matrix(column: pa.Array) -> np.ndarray:
    return np.zeros((0, 0)) if not len(column) else np.asarray(column.flatten(), np.float64).reshape(len(column), -1)


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances between the rows of two matrices."""
    return np.sqrt(np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T), 0))


def _homes(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows (key, vector) with the ball of the nearest pivot and how far it is; vectors of zeros have a ball of their own."""
    for batch in batches:
        for at in range(0, batch.num_rows, BATCH):
            part = batch.slice(at, BATCH)
            raw = _matrix(part.column(1))
            whole = np.isfinite(raw).all(1)
            u = unit(np.where(whole[:, None], raw, 0.0))
            zero = ~u.any(1)
            d = _apart(u, pivots)
            ball = np.where(zero, len(pivots), d.argmin(1))
            held = [pa.array(ball), pa.array(np.where(zero, 0.0, d.min(1))), part.column(0), part.column(1)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(whole)) for c in held], ["ball", "far", "key", "vector"])


class Best:
    """The k best rows of each of some queries, ties by key."""

    def __init__(self, n: int, k: int):
        self.k, self.score, self.key = k, np.full((n, k), -np.inf), np.zeros((n, k), np.int64)

    def least(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, of: np.ndarray, score: np.ndarray, keys: np.ndarray) -> None:
        """Scores of the queries `of` (rows) with keys (columns)."""
        enough = self.least()[of]
        if score.shape[1] > self.k:
            enough = np.maximum(enough, np.partition(score, -self.k, 1)[:, -self.k])
        i, j = np.nonzero(score >= (enough - 10.0**-DIGITS)[:, None])
        had = np.isfinite(self.score[of])
        x = np.concatenate([np.repeat(np.arange(len(of)), self.k)[had.ravel()], i])
        s = np.concatenate([self.score[of][had], score[i, j]])
        y = np.concatenate([self.key[of][had], keys[j]])
        order = np.lexsort((y, -np.round(s, DIGITS), x))
        x, s, y = x[order], s[order], y[order]
        place = np.arange(len(x)) - np.searchsorted(x, x)
        kept = place < self.k
        self.score[of[x[kept]], place[kept]], self.key[of[x[kept]], place[kept]] = s[kept], y[kept]


def _searched(ids: np.ndarray, q: np.ndarray, pivots: np.ndarray, reach: np.ndarray, folder: str, k: int, others_only: bool) -> Best:
    """A block of queries against the balls, most promising first; a ball is read while a query may find a better row in it."""
    best = Best(len(q), k)
    zero = ~q.any(1)
    to = np.concatenate([_apart(q, pivots), np.zeros((len(q), 1))], 1)
    bound = 1 - np.maximum(to - reach[None, :], 0) ** 2 / 2
    bound[:, -1] = 0.0  # rows of zeros
    bound[zero] = 0.0
    bound[:, reach < 0] = -np.inf  # no rows
    for ball in np.argsort(-bound.max(0), kind="stable"):
        asks = bound[:, ball] >= best.least() - ROOM
        asks &= bound[:, ball] > -np.inf
        if not asks.any():
            continue
        for path, _ in listed(f"{folder}/ball={ball}", ".parquet"):
            system, inner = located(path)
            with system.open_input_file(inner) as source:
                for batch in pq.ParquetFile(source).iter_batches(BATCH, columns=["far", "key", "vector"]):
                    far, keys = np.asarray(batch.column(0)), np.asarray(batch.column(1), np.int64)
                    # rows come by their distance from the pivot, so a batch is a shell
                    gap = np.maximum(np.maximum(to[:, ball] - far.max(), far.min() - to[:, ball]), 0)
                    may = asks & (zero | (ball == len(pivots)) | (1 - gap**2 / 2 >= best.least() - ROOM))
                    of = np.flatnonzero(may)
                    if len(of):
                        score = q[of] @ unit(_matrix(batch.column(2))).T
                        if others_only:
                            score[ids[of][:, None] == keys[None, :]] = -np.inf
                        best.add(of, score, keys)
    return best


def knn(rows: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding", others_only: bool = False) -> DataFrame:
    """(query, rank, vec_id, score): the k rows of the largest cosine for each query, ties by key.

    Rows are gathered in balls around pivots and written to the shared folder by ball and distance from the pivot. Queries are
    dealt out in blocks of neighbours; a task reads the balls, nearest first, that may still hold a better row by the triangle
    inequality, so near queries read little and none is answered by chance. The driver sees pivots and balls' sizes alone, both
    bounded. A vector of zeros has the score 0 with all; null vectors, and those with NaN or infinity, are no rows and find none.
    """
    spark = rows.sparkSession
    own = rows.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where("vector is not null")
    asked = queries.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("vector")).where("vector is not null")
    kind = own.schema["vector"].dataType.simpleString()
    sample = own.orderBy(F.xxhash64("key"), "key").limit(min(PIVOTS, own.count() // PIVOT_ROWS + 1)).collect()
    out_ddl = "query long, rank int, vec_id long, score double"
    if not sample:
        return spark.createDataFrame([], out_ddl)
    pivots = np.array([r["vector"] for r in sample], np.float64)
    pivots = np.unique(unit(pivots[np.isfinite(pivots).all(1)]), axis=0)
    if not len(pivots):
        pivots = np.zeros((1, len(sample[0]["vector"])))
    at = spark.sparkContext.broadcast(pivots)
    homes = lambda df: df.mapInArrow(lambda b: _homes(b, at.value), f"ball long, far double, key long, vector {kind}")
    placed = checkpointed(homes(own))
    reach, parts = np.full(len(pivots) + 1, -1.0), [1] * (len(pivots) + 1)
    for r in placed.groupBy("ball").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        reach[r["ball"]], parts[r["ball"]] = r["far"], r["n"] // BALL_ROWS + 1
    folder = new_folder(spark, "balls")
    dealt = placed.withColumn("part", F.pmod(F.xxhash64("key"), F.element_at(F.array(*map(F.lit, parts)), (F.col("ball") + 1).cast("int"))))
    dealt.repartition("ball", "part").sortWithinPartitions("ball", "part", "far").drop("part").write.partitionBy("ball").parquet(folder)
    known = spark.sparkContext.broadcast((pivots, reach))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            ids, q = np.asarray(table["key"], np.int64), unit(_matrix(table["vector"].combine_chunks()))
            best = _searched(ids, q, *known.value, folder, k, others_only)
            ok = np.isfinite(best.score)
            ranks = np.broadcast_to(np.arange(1, k + 1, dtype=np.int32), ok.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids, ok.sum(1))), pa.array(ranks[ok]), pa.array(best.key[ok]), pa.array(best.score[ok])], ["query", "rank", "vec_id", "score"])

    near = homes(asked).repartitionByRange("ball", "far", "key").sortWithinPartitions("ball", "far", "key")
    return near.mapInArrow(run, out_ddl)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            if n + part.num_rows > BLOCK:
                yield pa.Table.from_batches(held)
                held, n = [], 0
            held.append(part)
            n += part.num_rows
    if n:
        yield pa.Table.from_batches(held)


def hit_rates(found: DataFrame, labels: DataFrame, key: str = "vec_id") -> DataFrame:
    """For each query's label: queries, share whose first is of their label, share with one among all, mean best score."""
    of = labels.select(F.col(key).alias("_k"), F.col("label").alias("_label"))
    hits = found.join(of.select(F.col("_k").alias("query"), F.col("_label").alias("label")), "query").join(of, F.col("vec_id") == F.col("_k"))
    per = hits.groupBy("query", "label").agg(F.max((F.col("rank") == 1) & (F.col("_label") == F.col("label"))).alias("top1"), F.max(F.col("_label") == F.col("label")).alias("topk"), F.max("score").alias("best"))
    return per.groupBy("label").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("top1").cast("double")).alias("top1"), F.avg(F.col("topk").cast("double")).alias("topk"), F.avg("best").alias("best"), F.median("best").alias("median_best"))
