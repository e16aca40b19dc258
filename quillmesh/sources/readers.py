"""Reading: tables that may be missing, text lines, JSON maps, point clouds and scan metadata."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_or_empty(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A table, or no rows of its schema if there is none; other errors are errors."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], ddl)


def read_csv(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """Typed by the schema, not by guessing; an empty field is null."""
    return spark.read.csv(path, schema=ddl, header=True, emptyValue="", nullValue="")


def csv_lines(lines: DataFrame, column: str, ddl: str) -> DataFrame:
    return lines.select(F.from_csv(column, ddl, {"emptyValue": "", "nullValue": ""}).alias("r")).select("r.*")


def json_entries(df: DataFrame, key: str, column: str) -> DataFrame:
    """(key, name, value) for each entry of a JSON object."""
    return df.select(key, F.explode(F.from_json(column, "map<string,string>")).alias("name", "value"))


def read_json_records(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    """A file that holds a list of records."""
    return spark.read.schema(ddl).json(path, multiLine=True)


def valid_points(points: DataFrame) -> DataFrame:
    """Without points that the scanner marked; colours above a byte are scaled to one."""
    out = points.where(F.coalesce(F.col("invalid"), F.lit(0)) == 0).drop("invalid")
    for c in ("r", "g", "b"):
        if c in out.columns:
            out = out.withColumn(c, F.when(F.col(c) > 255, F.col(c) / 257).otherwise(F.col(c)).cast("int"))
    return out


def header_stats(points: DataFrame, scan: str) -> DataFrame:
    return points.groupBy(scan).agg(F.count(F.lit(1)).alias("points"), *[f(k).alias(f"{n}_{k}") for k in "xyz" for n, f in (("min", F.min), ("max", F.max))])


def scan_rows(scans: DataFrame) -> DataFrame:
    """Scan metadata: a guid by position if there is none, identity rotation and zero translation where a pose has gaps."""
    pose = lambda part, name, at: F.coalesce(F.col(f"pose.{part}.{name}"), F.lit(at)).alias(name)
    return scans.select(
        F.coalesce("guid", F.concat(F.lit("scan_"), "position")).alias("guid"), "name",
        F.struct(*[pose("rotation", k, 1.0 if k == "w" else 0.0) for k in "wxyz"]).alias("rotation"), F.struct(*[pose("translation", k, 0.0) for k in "xyz"]).alias("translation"),
    )


def image_rows(images: DataFrame) -> DataFrame:
    """Image metadata: without a pose the position stays unknown."""
    has = F.col("pose").isNotNull()
    at = lambda k: F.when(has, F.coalesce(F.col(f"pose.translation.{k}"), F.lit(0.0))).alias(k)
    return images.select(F.coalesce("guid", F.concat(F.lit("img_"), "position")).alias("guid"), *[at(k) for k in "xyz"])


def representation() -> Column:
    """Which picture of an image is taken: spherical, then pinhole, then cylindrical; JPEG before PNG."""
    return F.coalesce(*[F.col(f"{kind}.{coding}") for kind in ("spherical", "pinhole", "cylindrical") for coding in ("jpeg", "png")])


def detect(pictures: DataFrame, model: str) -> DataFrame:
    """Detections of pictures (image_id, width, height): the mock finds one box in the middle, no model finds nothing."""
    mid = {"x": F.col("width") / 2, "y": F.col("height") / 2}
    sides = [(mid[k] + d).cast("double").alias(f"{k}{n}") for n, d in ((0, -50), (1, 50)) for k in "xy"]
    return pictures.where(F.lit(model == "mock")).select("image_id", F.lit("relay").alias("class"), F.lit(0.92).alias("confidence"), *sides)
