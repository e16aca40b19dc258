"""Small inputs over all cores, and small sides of joins to every task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A scan that reads less than this from fewer files than there are cores is dealt out; larger ones have splits enough.
FEW_BYTES = 256 << 20
#: Rows up to which a side is sent to every task.
FEW_ROWS = 10_000
#: Parts of each key of a join whose small side may hold a row for a key of very many rows.
PARTS = 64


def spread(df: DataFrame) -> DataFrame:
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size >= FEW_BYTES:  # looked at first: a large input's list of files stays where it is
        return df
    cores, files = df.sparkSession.sparkContext.defaultParallelism, len(df.inputFiles())
    return df.repartition(cores) if 0 < files < cores else df


def over_cores(df: DataFrame) -> DataFrame:
    """Checkpointed rows on as many partitions as there are cores, at least: few bytes may be much work."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def few(df: DataFrame, rows: int = FEW_ROWS) -> DataFrame:
    """The rows marked for every task, if they have been counted and are few; else as they are, for the planner to join."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def joined_to_few(rows: DataFrame, groups: DataFrame, key: list[str], how: str = "inner", most: int = FEW_ROWS) -> DataFrame:
    """rows joined with a table of their groups: sent to every task if it is counted and small, else each group's rows go in PARTS parts."""
    near = few(groups, most)
    if near is not groups:
        return rows.join(near, key, how)
    dealt = rows.withColumn("_part", F.pmod(F.xxhash64(*rows.columns), F.lit(PARTS)).cast("int"))
    return dealt.join(groups.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))), [*key, "_part"], how).drop("_part")
