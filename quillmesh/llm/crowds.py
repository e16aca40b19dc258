"""Comparing the members of groups that no task can hold.

Members of a group must be compared with each other, but those that are known to be linked need not be. So a long group is
first compared with some of its members, the hubs, which takes a time in proportion to the group. Members that hubs join
are one crowd and never meet again; the rest, and crowds that are apart, are dealt out in blocks, and each pair of blocks
that could hold an unknown link is compared in a task of its own. Nothing is left out: two members are compared with each
other, or a chain of links joins them.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpointed
from quillmesh.operators.graph import components, joined_by_parts
from quillmesh.operators.parallel import joined_to_few

#: Members of a long group that all others are compared with first, about.
HUBS = 32
LINKS, LINKS_ARROW = "a long, b long", pa.schema([("a", pa.int64()), ("b", pa.int64())])
Compare = Callable[[pa.Table, pa.Table | None], tuple]


def _linked(found: tuple) -> pa.Table:
    return pa.table([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], schema=LINKS_ARROW)


def _sides(table: pa.Table, column: str, value: int) -> tuple[pa.Table, pa.Table]:
    left = pc.equal(table[column], value)
    return table.filter(left), table.filter(pc.invert(left))


def links(members: DataFrame, inside: Compare, across: Compare, fetch: Callable[[DataFrame], DataFrame] = lambda m: m) -> DataFrame:
    """(a, b) that join the members which are alike: members have grp, node, and load (the share of a task's capacity).

    fetch adds what is compared to members, so that sizes are known before it moves. inside(rows, None) links the members of
    one table, across(left, right) those of two; both may link by way of others.
    """
    members = checkpointed(members)
    sizes = members.groupBy("grp").agg(F.greatest(F.lit(1), F.ceil(F.sum("load"))).cast("int").alias("blocks"), F.count(F.lit(1)).alias("members"))
    own = joined_by_parts(members, sizes.where("members > 1"), "grp", "node")
    out = fetch(own.where("blocks = 1").select("grp", "node")).groupBy("grp").applyInArrow(lambda t: _linked(inside(t, None)), LINKS)
    long = own.where("blocks > 1")
    if long.isEmpty():
        return out
    long = checkpointed(fetch(long))
    near = checkpointed(_with_hubs(long, across))
    return out.unionByName(near).unionByName(_apart(long.drop("blocks", "members"), components(near), inside, across))


def _with_hubs(long: DataFrame, across: Compare) -> DataFrame:
    hub = F.pmod(F.xxhash64("node", F.lit(7)), F.greatest(F.lit(1), F.floor(F.col("members") / HUBS))) == 0
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    each = long.where(hub).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).withColumn("side", F.lit(0))
    dealt = each.unionByName(long.withColumns({"block": block, "side": F.lit(1)})).drop("blocks", "members")
    return dealt.groupBy("grp", "block").applyInArrow(lambda t: _linked(across(*_sides(t, "side", 0))), LINKS)


def _apart(long: DataFrame, roots: DataFrame, inside: Compare, across: Compare) -> DataFrame:
    named = long.join(roots.withColumnRenamed("root", "crowd"), "node", "left")
    # crowds that fill a task or more have blocks of their own; smaller ones, and members without, share the others
    large = named.where("crowd is not null").groupBy("grp", "crowd").agg(F.sum("load").alias("all")).where("all >= 1").select("grp", "crowd", F.lit(True).alias("large"))
    named = joined_to_few(named, checkpointed(large), ["grp", "crowd"], "left").withColumn("crowd", F.when(F.col("large"), F.col("crowd"))).drop("large")
    parts = named.groupBy("grp", "crowd").agg(F.greatest(F.lit(1), F.ceil(F.sum("load"))).cast("int").alias("parts"))
    ranges = parts.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("crowd", "parts"))).alias("r"))
    first = F.transform("r", lambda x, i: F.struct(x["crowd"].alias("crowd"), F.aggregate(F.slice("r", F.lit(1), i), F.lit(0), lambda n, y: n + y["parts"]).alias("first"), x["parts"].alias("parts")))
    placed = joined_to_few(named, checkpointed(ranges.select("grp", first.alias("r"))), ["grp"])
    mine = F.filter("r", lambda x: x["crowd"].eqNullSafe(F.col("crowd")))[0]
    block = (mine["first"] + F.pmod(F.xxhash64("node"), mine["parts"])).cast("int")
    others = F.filter("r", lambda x: F.col("crowd").isNull() | ~x["crowd"].eqNullSafe(F.col("crowd")))
    meets = F.flatten(F.transform(others, lambda x: F.sequence(x["first"], x["first"] + x["parts"] - 1)))
    dealt = placed.withColumns({"block": block, "other": F.explode(meets)}).withColumns({"p": F.least("block", "other"), "q": F.greatest("block", "other")}).drop("r", "crowd", "other")

    def compare(table: pa.Table) -> pa.Table:
        p, q = table["p"][0].as_py(), table["q"][0].as_py()
        return _linked(inside(table, None) if p == q else across(*_sides(table, "block", p)))

    return dealt.groupBy("grp", "p", "q").applyInArrow(compare, LINKS)
