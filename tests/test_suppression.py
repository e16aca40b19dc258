"""Suppression in groups of any size against a plain loop."""

import random

import pytest

from quillmesh.operators import greedy

SCHEMA = "image long, class int, n long, x0 double, y0 double, x1 double, y1 double, score double"


def plain(rows, limit):
    out, groups = [], {}
    for r in rows:
        groups.setdefault(r[:2], []).append(r)
    for own in groups.values():
        kept = []
        for r in sorted(own, key=lambda r: (-r[7], r[2])):
            if all(greedy._iou(k[3:7], r[3:7]) <= limit for k in kept):
                kept.append(r)
        out += kept
    return sorted(out)


def made(seed, n, spread, images=1):
    r = random.Random(seed)
    out = []
    for k in range(n):
        x, y, w, h = r.uniform(-spread, spread), r.uniform(-spread, spread), r.choice([0.5, 4, 20, 30]) * r.uniform(0.6, 1.7), r.choice([3, 20, 30]) * r.uniform(0.6, 1.7)
        out.append((k % images, 0, k, x, y, x + w, y + h, round(r.random(), 2)))
    return out


@pytest.mark.parametrize("limit, spread", [(0.5, 3), (0.3, 40)])
def test_all_boxes_in_one_image(spark, monkeypatch, limit, spread):
    rounds, settled = [], greedy._settled
    monkeypatch.setattr(greedy, "_settled", lambda *a: rounds.append(1) or settled(*a))
    rows = made(1, 500, spread) + [(0, 0, 5000 + k, 1.0, 1.0, 11.0, 11.0, 0.5) for k in range(200)] + [(0, 0, 6000, 4.0, 4.0, 4.0, 9.0, 0.9), (1, 0, 1, 0.0, 0.0, 5.0, 5.0, 0.1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, greedy.non_maximum_suppression(df, ["image", "class"], limit, most=250).collect()))
    assert got == plain(rows, limit) and 1 <= len(rounds) < 12


def test_small_groups_in_one_task_each(spark):
    rows = made(2, 600, 20, images=7)
    assert sorted(map(tuple, greedy.non_maximum_suppression(spark.createDataFrame(rows, SCHEMA), ["image", "class"]).collect())) == plain(rows, 0.5)
