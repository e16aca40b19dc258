"""Bringing new rows into a table: upserts, seeds, patches, re-ingest by hash. Each is one shuffle on the key."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """Of each key the row of the highest order, as an aggregate that combines before the shuffle."""
    rest = [c for c in rows.columns if c not in (key, order)]
    return rows.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_row")).select(key, f"_row.{order}", *[f"_row.{c}" for c in rest])


def upsert(base: DataFrame, news: DataFrame, key: str, order: str) -> DataFrame:
    """base with the latest news: values of known keys replaced, unknown keys added. touched: whether news had the key."""
    new = latest(news, key, order).drop(order)
    values = [c for c in base.columns if c != key]
    new = new.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_{c}") for c in values])
    out = base.join(new, base[key] == new["_key"], "full_outer")
    touched = F.col("_key").isNotNull()
    return out.select(F.coalesce(key, "_key").alias(key), *[F.when(touched, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in values], touched.alias("touched"))


def insert_missing(base: DataFrame, seed: DataFrame, key: str) -> DataFrame:
    return base.unionByName(seed.join(base.select(key), key, "left_anti").select(base.columns))


def backfill(base: DataFrame, values: dict[str, Column]) -> DataFrame:
    return base.withColumns({c: F.coalesce(F.col(c), v) for c, v in values.items()})


def patch(base: DataFrame, patches: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """`sets` of a patch says for each field whether the patch sets it, be it to null."""
    p = patches.select(F.col(key).alias("_key"), "sets", *[F.col(f).alias(f"_{f}") for f in fields])
    out = base.join(p, base[key] == p["_key"], "left")
    return out.select(key, *[F.when(F.coalesce(F.col(f"sets.{f}"), F.lit(False)), F.col(f"_{f}")).otherwise(F.col(f)).alias(f) for f in fields])


def ingest_states(incoming: DataFrame, known: DataFrame, key: str, digest: Column) -> DataFrame:
    """incoming with `sha256` and `state`: added, unchanged (same hash as known), or replaced."""
    old = known.select(F.col(key).alias("_key"), F.col("sha256").alias("_sha256"))
    new = incoming.withColumn("sha256", digest)
    state = F.when(F.col("_key").isNull(), "added").when(F.col("_sha256") == F.col("sha256"), "unchanged").otherwise("replaced")
    return new.join(old, new[key] == old["_key"], "left").select(new["*"], state.alias("state"))


def load_if_empty(base: DataFrame, rows: DataFrame) -> DataFrame:
    return rows if base.isEmpty() else base


def rechunked(chunks: DataFrame, incoming: DataFrame, key: str, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The chunks after an ingest of documents with `state`: those of unchanged documents as they are, those of others cut anew; all others go."""
    same = chunks.join(incoming.where("state = 'unchanged'").select(key), key, "left_semi").withColumn("state", F.lit("kept"))
    new = cut(incoming.where("state <> 'unchanged'").drop("state", "sha256")).withColumn("state", F.lit("written"))
    return same.unionByName(new)


def refused(asked: DataFrame) -> DataFrame:
    """Requests (conf, box, k, width) outside their limits, with the names of what is wrong; a null is not given and not wrong."""
    box, rules = F.col("box"), {}
    rules["conf"] = ~F.col("conf").between(0, 1)
    rules["box"] = F.when(box.isNotNull(), F.size(box) != 4)
    rules["size"] = F.when(F.size(box) == 4, (F.element_at(box, 3) <= 0) | (F.element_at(box, 4) <= 0))
    rules["k"] = ~F.col("k").between(1, 20)
    rules["width"] = ~F.col("width").between(128, 4096)
    wrong = F.filter(F.array(*[F.when(test, name) for name, test in rules.items()]), lambda r: r.isNotNull())
    return asked.withColumn("wrong", wrong).where(F.size("wrong") > 0)


def import_tags(tags: DataFrame, items: DataFrame, order: str, least: float = 0.25) -> DataFrame:
    """tags (id, name, x, confidence) after an import: values of the last item of an id replace what is there, names stay, new ids are added."""
    new = latest(items, "id", order).select(F.col("id").alias("_id"), F.col("name").alias("_name"), F.col("x").alias("_x"), F.col("confidence").alias("_confidence"))
    out, given = tags.join(new, tags["id"] == new["_id"], "full_outer"), F.col("_id").isNotNull()
    value = lambda k: F.when(given, F.col(f"_{k}")).otherwise(F.col(k)).alias(k)
    review = F.when(given, F.coalesce(F.col("_confidence") < least, F.lit(False)))
    return out.select(
        F.coalesce("id", "_id").alias("id"), F.coalesce("name", "_name", F.col("_id").cast("string")).alias("name"), value("x"), value("confidence"),
        review.alias("needs_review"), given.alias("found"), F.when(F.col("id").isNull(), "import").alias("created_by"),
    )
