"""Long groups: every link of a plain comparison is found, whatever the sizes of groups, crowds and blocks."""

import numpy as np
import pyarrow as pa
import pytest

from quillmesh.llm import crowds
from quillmesh.operators import graph as components


def brute(nodes, near=2):
    root, low = {}, None
    for k, x in enumerate(sorted(nodes)):
        low = x if not k or x - last > near else low
        root[x], last = low, x
    return root


def comparer():
    def pairs(left, right):  # a local function goes to the workers by value
        import numpy as np

        a, b = np.asarray(left["node"]), np.asarray(right["node"])
        i, j = np.nonzero((np.abs(a[:, None] - b[None, :]) <= 2) & (a[:, None] != b[None, :]))
        return a[i], b[j]

    return pairs


@pytest.mark.parametrize("share", [0.2, 0.02])
@pytest.mark.parametrize("step", [1, 3])
def test_members_of_long_groups(spark, share, step):
    r = np.random.default_rng(3)
    runs = [*range(0, 120), *range(1000, 1100 * step, step), *(int(x) for x in r.integers(2000, 9000, 60))]
    groups = {1: sorted(set(runs)), 2: [5, 6, 50], 3: [7]}
    rows = spark.createDataFrame([(g, n, share) for g, nodes in groups.items() for n in nodes], "grp long, node long, load double")
    pairs = comparer()
    found = crowds.links(rows, lambda t, _: pairs(t, t), pairs, lambda m: m.withColumn("payload", m.node.cast("string")))
    got = {x.node: x.root for x in components.components(found).collect()}
    expected = brute(groups[1])
    assert {n: got.get(n, n) for n in groups[1]} == expected
    seen = {(x.a, x.b) for x in found.collect()}
    assert all(abs(a - b) <= 2 for a, b in seen)


def test_crowds_do_not_meet_again(spark):
    rows = spark.createDataFrame([(1, n // 100, 0.05) for n in range(0, 40000, 100)], "grp long, node long, load double").dropDuplicates(["node"])
    everything = lambda left, right: tuple(np.repeat(np.asarray(left["node"]), right.num_rows) if k else np.tile(np.asarray(right["node"]), left.num_rows) for k in (0, 1))
    found = crowds.links(rows, lambda t, _: everything(t, t), everything)  # all are alike: hubs join all of them
    assert found.count() < 400 * 2 * crowds.HUBS and components.components(found).select("root").distinct().count() == 1


def test_least_of_large_groups(spark):
    rows = spark.createDataFrame([(i % 3, (i * 7919) % 1000 + i % 3) for i in range(3000)], "k long, v long")
    got = {(r.k, r.m) for r in components.with_least(rows, "k", "v", "m").collect()}
    assert got == {(0, 0), (1, 1), (2, 2)} and components.with_least(rows, "k", "v", "m").count() == 3000
    assert isinstance(crowds.LINKS_ARROW, pa.Schema)
