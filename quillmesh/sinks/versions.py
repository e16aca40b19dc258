"""Keyed tables that are committed: versions of Parquet files, named by a manifest each.

A table's rows lie in buckets by a hash of the key. A change writes the buckets it touches, and no others, into a folder of
its own by Spark's Parquet writer, then commits by creating the manifest of the next version, which names the folder of each
bucket. Creating a file fails if it is there, so of two writers that began from one version one wins and the other
gets `Conflict`, with the table unharmed. A job that fails leaves folders that no manifest names; `swept` removes them. A
change may carry a token: a repeated run with a token that was committed changes nothing.

Cases: a table without versions has no rows; an empty change commits nothing; null keys are refused; of several new rows of a
key the one of the highest order is taken.
"""

from __future__ import annotations

import json
import time
import uuid
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.operators import merge
from quillmesh.operators.lineage import checkpointed

BUCKET = "_bucket"
#: Age of a lock without a manifest after which its writer is taken for dead.
STALE_SECONDS = 600


class Conflict(RuntimeError):
    """Another writer has committed since the version that a change began from."""


@dataclass
class Manifest:
    version: int
    ddl: str
    key: str
    buckets: int
    folders: dict[str, str] = field(default_factory=dict)
    tokens: list[str] = field(default_factory=list)


class VersionedTable:
    """A table in a folder of any file system that Spark reaches."""

    def __init__(self, spark: SparkSession, path: str, ddl: str, key: str, buckets: int = 64):
        self.spark, self.path = spark, path.rstrip("/")
        self.empty = Manifest(0, ddl, key, buckets)
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # ---- versions

    def _listed(self, folder: str) -> list[str]:
        at = self._path(f"{self.path}/{folder}")
        return [s.getPath().getName() for s in self._fs.listStatus(at)] if self._fs.exists(at) else []

    def versions(self) -> list[int]:
        return sorted(int(n[:-5]) for n in self._listed("versions") if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> Manifest:
        """Of a version, or of the latest."""
        if version is None:
            known = self.versions()
            version = known[-1] if known else 0
        if version == 0:
            return self.empty
        stream = self._fs.open(self._path(f"{self.path}/versions/{version:012d}.json"))
        try:
            return Manifest(**json.loads(bytes(stream.readAllBytes()).decode()))
        finally:
            stream.close()

    def read(self, version: int | None = None) -> DataFrame:
        return self._rows(self.manifest(version))

    def _rows(self, m: Manifest, buckets: list[str] | None = None) -> DataFrame:
        paths = [f"{self.path}/{folder}/{BUCKET}={b}" for b, folder in m.folders.items() if buckets is None or b in buckets]
        return self.spark.read.schema(m.ddl).parquet(*paths) if paths else self.spark.createDataFrame([], m.ddl)

    # ---- changes

    def bucket(self, m: Manifest):
        return F.pmod(F.xxhash64(m.key), F.lit(m.buckets)).cast("int")

    def upsert(self, news: DataFrame, order: str, token: str | None = None, base: Manifest | None = None) -> Manifest:
        """The version after new rows (the table's columns, and `order`) have replaced those of their keys and been added.

        base: the manifest that the caller decided by; by default the latest.
        """
        m = self.manifest() if base is None else base
        if token is not None and token in self.manifest().tokens:
            return self.manifest()
        change = checkpointed(news.withColumn(BUCKET, self.bucket(m)))
        if change.where(F.col(m.key).isNull()).limit(1).count():
            raise ValueError(f"{m.key} is null")
        touched = [str(r[0]) for r in change.select(BUCKET).distinct().collect()]  # m.buckets at most
        if not touched:
            return m
        rows = merge.upsert(self._rows(m, touched), change.drop(BUCKET), m.key, order).drop("touched")
        return self._commit(m, rows, touched, token)

    def delete(self, keys: DataFrame, token: str | None = None, base: Manifest | None = None) -> Manifest:
        """The version without the rows of some keys."""
        m = self.manifest() if base is None else base
        if token is not None and token in self.manifest().tokens:
            return self.manifest()
        gone = checkpointed(keys.select(m.key).where(f"{m.key} is not null").distinct().withColumn(BUCKET, self.bucket(m)))
        touched = [str(r[0]) for r in gone.select(BUCKET).distinct().collect() if str(r[0]) in m.folders]
        return self._commit(m, self._rows(m, touched).join(gone.select(m.key), m.key, "left_anti"), touched, token) if touched else m

    def _commit(self, m: Manifest, rows: DataFrame, touched: list[str], token: str | None) -> Manifest:
        folder = f"data/{uuid.uuid4().hex}"
        columns = self.spark.createDataFrame([], m.ddl).columns
        rows.select(*columns, self.bucket(m).alias(BUCKET)).repartition(BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = {n.partition("=")[2] for n in self._listed(folder) if n.startswith(f"{BUCKET}=")}
        kept = {b: f for b, f in m.folders.items() if b not in touched}
        after = Manifest(m.version + 1, m.ddl, m.key, m.buckets, {**kept, **{b: folder for b in sorted(written)}}, [*m.tokens, *([token] if token else [])])
        self._create(f"versions/{after.version:012d}.json", json.dumps(after.__dict__).encode())
        return after

    def _create(self, name: str, content: bytes) -> None:
        """A whole file that was not there: written aside, then given its name by the one writer who could create its lock.

        A writer that dies between the two leaves a lock alone; after STALE_SECONDS it counts for nothing.
        """
        aside, at, lock = (self._path(f"{self.path}/{n}") for n in (f"aside/{uuid.uuid4().hex}", name, f"{name}.lock"))
        self._fs.mkdirs(at.getParent())
        stream = self._fs.create(aside, False)
        stream.write(bytearray(content))
        stream.close()
        if self._fs.exists(lock) and not self._fs.exists(at) and time.time() - self._fs.getFileStatus(lock).getModificationTime() / 1000 > STALE_SECONDS:
            self._fs.delete(lock, False)
        try:
            self._fs.create(lock, False).close()
        except Py4JJavaError as e:
            self._fs.delete(aside, False)
            raise Conflict(f"{self.path} has changed: {name} is there") from e
        self._fs.rename(aside, at)

    def swept(self, versions: int = 1) -> list[str]:
        """Removes the folders that none of the last versions names; their names."""
        named = {f for v in self.versions()[-versions:] for f in self.manifest(v).folders.values()}
        gone = [f"data/{n}" for n in self._listed("data") if f"data/{n}" not in named]
        for n in gone:
            self._fs.delete(self._path(f"{self.path}/{n}"), True)
        return gone


def ingested(table: VersionedTable, incoming: DataFrame, text: str = "text", token: str | None = None) -> tuple[Manifest, DataFrame]:
    """Documents (the key, text) whose hash is new or other than the table's are written; (the version, the state of each document)."""
    base = table.manifest()
    states = checkpointed(merge.ingest_states(incoming, table.read(base.version), base.key, F.sha2(text, 256)))
    news = states.where("state <> 'unchanged'").select(base.key, "sha256", text, F.lit(0).alias("order"))
    return table.upsert(news, "order", token, base), states.select(base.key, "state")
