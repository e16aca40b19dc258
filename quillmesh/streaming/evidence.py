"""Detections that arrive in batches update what is known of cabinets.

The meaning is that of one batch after another: a batch sees the cabinets as the last one left them, and several pieces of
evidence for one cabinet fold to the strongest. The same DataFrame code serves a stored table and, inside foreachBatch, a
stream. The stream's state is a committed table: a batch rewrites the buckets of the cabinets that it has evidence for, and
commits under its number, so a repeated batch changes nothing and a failed one leaves the state before it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillmesh.operators import spatial
from quillmesh.sinks.versions import VersionedTable

#: What the state of a stream holds.
STATE = "id long, x double, y double, z double, confidence double, models array<string>"


def strongest(cabinets: DataFrame, detections: DataFrame, panel: str, reach: float, least: float) -> DataFrame:
    """(_id, _conf) of the cabinets that detections (id, class, conf, x, y, z) are evidence for."""
    asked = detections.where((F.col("class") == panel) & (F.col("conf") >= least))
    near = spatial.nearest(asked, cabinets.select("id", "x", "y", "z"), "id").where(F.col("dist") <= reach)
    return near.groupBy(F.col("near").alias("_id")).agg(F.max("conf").alias("_conf"))


def fold(cabinets: DataFrame, detections: DataFrame, panel: str, model: str, reach: float = 0.6, least: float = 0.25, how: str = "left") -> DataFrame:
    """cabinets (STATE) after a batch of detections; how="inner": those alone that have evidence."""
    best = strongest(cabinets, detections, panel, reach, least)
    out = cabinets.join(best, cabinets["id"] == best["_id"], how)
    hit = F.col("_id").isNotNull()
    return out.select(
        "id", "x", "y", "z", F.when(hit, F.greatest("_conf", F.coalesce("confidence", F.lit(0.0)))).otherwise(F.col("confidence")).alias("confidence"),
        F.when(hit, F.array_union("models", F.array(F.lit(model)))).otherwise(F.col("models")).alias("models"),
    )


def follow(stream: DataFrame, state: VersionedTable, checkpoint: str, panel: str, model: str) -> StreamingQuery:
    """Run until what is there is read; the state (STATE, by id) has a version for each batch with evidence."""

    def apply(batch: DataFrame, n: int) -> None:
        base = state.manifest()
        if f"batch {n}" not in base.tokens:
            changed = fold(state.read(base.version), batch, panel, model, how="inner")
            state.upsert(changed.withColumn("order", F.lit(0)), "order", f"batch {n}", base)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
