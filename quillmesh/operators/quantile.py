"""Exact medians of groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.operators.lineage import checkpointed
from quillmesh.operators.parallel import joined_to_few

#: Values of a group that one task sorts; larger groups are narrowed down first.
SORTED = 10_000
#: Splitters of a round: about so many times fewer values of a group are left after it, however they are distributed.
SPLITS = 64


def medians(rows: DataFrame, by: list[str], columns: list[str], most: int | None = None, weight: str | None = None) -> DataFrame:
    """by, and for each column the median of its finite values in the group (null without one), under the column's name.
    A row counts as often as its `weight` says, a whole number of at least 1; without one, once.

    A group of up to SORTED values is sorted in one task. A larger one is never gathered: each round takes splitters from a
    mergeable sketch, counts exactly the values at and between them, and keeps those among which the middle lies; it ends where the
    middle falls between two ranges, a range holds one value, or few enough are left. Only sketches and counts are shuffled
    until then; the sketch decides how fast it goes, never the result.
    """
    most = SORTED if most is None else most
    key = [*by, "axis"]
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    long = rows.select(*by, times.alias("w"), F.explode(F.array(*[F.struct(F.lit(k).alias("axis"), F.col(k).cast("double").alias("v")) for k in columns])).alias("e")).select(*by, "w", "e.axis", "e.v")
    left = long.where("v is not null and not isnan(v) and abs(v) < double('infinity')")
    if weight is not None:  # each value once, with its weight
        left = checkpointed(left.groupBy(*key, "v").agg(F.sum("w").alias("w")))
    extent = [F.sum("w").alias("n"), F.count(F.lit(1)).alias("rows"), F.min("v").alias("low"), F.max("v").alias("high")]
    state = checkpointed(left.groupBy(*key).agg(*extent).withColumns({"k1": F.floor((F.col("n") - 1) / 2), "k2": F.floor(F.col("n") / 2)}))
    found = []
    while True:
        same, small = F.col("low") == F.col("high"), F.col("rows") <= most
        found.append(state.where(same).select(*key, F.col("low").alias("m")))
        few_left, many = state.where(~same & small), state.where(~same & ~small)
        rest = joined_to_few(left, few_left, key).where("v between low and high")
        values = rest.groupBy(*key, "k1", "k2").agg(F.sort_array(F.collect_list(F.struct("v", "w"))).alias("vs"))
        at = ranked if weight is not None else lambda k: F.element_at("vs", (F.col(k) + 1).cast("int"))["v"]
        found.append(values.select(*key, ((at("k1") + at("k2")) / 2).alias("m")))
        if many.isEmpty():
            break
        many = many.select(*key, "low", "high", "k1", "k2")
        inner = joined_to_few(left, many, key).where("v between low and high")
        cuts = inner.groupBy(*key, "low", "high", "k1", "k2").agg(F.array_distinct(F.percentile_approx("v", [k / SPLITS for k in range(SPLITS + 1)], 1000)).alias("cuts"))
        cut = joined_to_few(left, checkpointed(cuts), key).where("v between low and high")
        bin_ = 2 * F.size(F.filter("cuts", lambda c: c < F.col("v"))) + F.array_contains("cuts", F.col("v")).cast("int")
        counted = cut.groupBy(*key, "k1", "k2", bin_.alias("bin")).agg(*extent)
        before = F.sum("n").over(Window.partitionBy(*key).orderBy("bin")) - F.col("n")  # a row for each range
        placed = counted.withColumn("before", before)
        holds = lambda k: (F.col(k) >= F.col("before")) & (F.col(k) < F.col("before") + F.col("n"))
        middle = checkpointed(placed.where(holds("k1") | holds("k2")))
        apart = middle.where(holds("k1") != holds("k2")).groupBy(*key).agg(F.max(F.when(holds("k1"), F.col("high"))).alias("a"), F.min(F.when(holds("k2"), F.col("low"))).alias("b"))
        found.append(apart.select(*key, ((F.col("a") + F.col("b")) / 2).alias("m")))
        inside = middle.where(holds("k1") & holds("k2"))
        state = inside.select(*key, "n", "rows", "low", "high", (F.col("k1") - F.col("before")).alias("k1"), (F.col("k2") - F.col("before")).alias("k2"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.groupBy(*by).agg(*[F.max(F.when(F.col("axis") == k, F.col("m"))).alias(k) for k in columns])


def ranked(rank: str) -> Column:
    """The value at a rank, from 0, among `vs`, sorted values (v) that count w times each."""
    start = F.struct(F.col(rank).cast("long").alias("left"), F.lit(None).cast("double").alias("v"))
    step = lambda s, x: F.struct((s["left"] - x["w"]).alias("left"), F.when((s["left"] >= 0) & (s["left"] < x["w"]), x["v"]).otherwise(s["v"]).alias("v"))
    return F.aggregate("vs", start, step, lambda s: s["v"])
