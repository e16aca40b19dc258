"""What the training-data operators share: reading, slicing of Arrow batches, rows out."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quillmesh.operators.lineage import checkpointed  # noqa: F401
from quillmesh.operators.parallel import spread

#: Characters of text that are held as Python objects at a time.
SLICE_CHARS = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, so that other columns are not read and cannot clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def slices(batch: pa.RecordBatch, column: int = 1, chars: int = SLICE_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of about `chars` bytes of a column, so that few Python strings live at once."""
    if not batch.num_rows:
        return
    mean = max(1, batch.column(column).nbytes // batch.num_rows)
    step = max(1, chars // mean)
    for i in range(0, batch.num_rows, step):
        yield batch.slice(i, step)


def schema_of(ddl: str) -> tuple[StructType, pa.Schema]:
    spark_schema = _parse_datatype_string(ddl)
    return spark_schema, to_arrow_schema(spark_schema)


def map_texts(df: DataFrame, make: Callable[[], Callable[[list, list], list[list]]], ddl: str) -> DataFrame:
    """Rows of (doc_id, text) through a Python kernel, in Arrow batches and without a shuffle.

    make() runs once in each task and returns a function from the ids and texts of a slice to the columns of `ddl`.
    """
    spark_schema, arrow = schema_of(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch):
                columns = kernel(part.column(0).to_pylist(), part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return spread(df).mapInArrow(run, spark_schema)


def append_texts(docs: DataFrame, make: Callable[[], Callable[[list, list], list[list]]], ddl: str) -> DataFrame:
    """All columns of the documents, and those of `ddl` that a kernel makes of the texts (null: empty); no shuffle."""
    _, arrow = schema_of(ddl)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = make()
        for batch in batches:
            for part in slices(batch, at):
                own = part.column(at)
                columns = kernel([None] * len(own), ["" if t is None else t for t in own.to_pylist()])
                made = [pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names=[*part.schema.names, *arrow.names])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, *schema_of(ddl)[0].fields]))


def unused(df: DataFrame, name: str) -> str:
    """A column name that the frame does not have; Spark does not tell capitals from small letters."""
    had = {c.lower() for c in df.columns}
    while name.lower() in had:
        name += "_"
    return name


def sha256(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def spans_text(spans: list[tuple[int, int, str]]) -> str:
    """kind:start:end, comma-joined, of spans that are in order."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


def input_bytes(df: DataFrame) -> int:
    """Bytes that a plan reads: the sizes of its files, or, where it starts from something else, of its texts."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    if size < 1 << 60:
        return size
    return df.agg(F.sum(F.octet_length("text"))).first()[0] or 0
