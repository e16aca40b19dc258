"""Places in an order of any number of rows: a sort by ranges, and the rows that lie in the ranges before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.lineage import checkpointed


def placed(df: DataFrame, order: list[Column | str], place: str = "place") -> DataFrame:
    """df with every row's place from 1 on. No window holds the rows: one sums up the partitions' sizes."""
    ordered = checkpointed(df.orderBy(*order))
    at = F.monotonically_increasing_id()  # the partition, and in the low 33 bits the row in it
    numbered = ordered.withColumns({"_part": F.shiftright(at, 33), "_row": at.bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # a row for each partition
    return numbered.join(F.broadcast(before), "_part").withColumn(place, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")


def placed_in_groups(df: DataFrame, by: list[str], order: list[Column | str], place: str = "place", size: str = "size") -> DataFrame:
    """df with every row's place in its group from 1 on, and the group's size; groups may be of any size."""
    numbered = placed(df, [*by, *order], "_place")
    groups = numbered.groupBy(*by).agg(F.min("_place").alias("_first"), F.count(F.lit(1)).alias(size))
    return numbered.join(groups, by).withColumn(place, F.col("_place") - F.col("_first") + 1).drop("_place", "_first")
