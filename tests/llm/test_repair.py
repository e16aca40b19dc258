"""Repaired conversations against a plain search over all edits."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from quillmesh.llm import repair
from quillmesh.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, Kind int, _CONV int"
NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
NAMES = {"u": "user", "a": "assistant"}


def space(x):
    return " " if x is None else str(x)


def plain(rows):
    """The contract by hand: every edit string that is cheapest, the least of them."""
    convs = {}
    for conv, turn, role, text in rows:
        role, text, out = space(role), space(text), convs.setdefault(conv, [])
        kind = zlib.crc32(f"{space(conv)}:{space(turn)}".encode()) % 20
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        out += [(turn, role, text)] * (2 if kind == 3 else 1)
    return sorted((one(conv, sorted(x, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))) for conv, x in convs.items()), key=repr)


def one(conv, rows):
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        solid = re.sub("[ \t-\r]", "", text)
        faults.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:], strict=False))

    @lru_cache(maxsize=None)
    def best(i, last, puts):
        options = []
        if i == len(rows):
            if last in ("", "a"):
                options.append((0, "", ()))
        else:
            _, role, text = rows[i]
            more = 3 if faults[i] == "truncated" else 0
            c, a, x = best(i + 1, last, 0)
            options.append((c + 4, "D" + a, x))
            if faults[i] not in ("blank", "duplicate"):
                if (last, role[:1]) in NEXT:
                    c, a, x = best(i + 1, role[:1], 0)
                    options.append((c + more, "K" + a, (f"{role}:{text}", *x)))
                for to in "ua":
                    if (last, to) in NEXT:
                        c, a, x = best(i + 1, to, 0)
                        options.append((c + more + 3, "R" + a, (f"{NAMES[to]}:{text}", *x)))
        if puts < 3:
            for to in "ua":
                if (last, to) in NEXT:
                    c, a, x = best(i, to, puts + 1)
                    options.append((c + 3, "I" + a, (f"{NAMES[to]}:", *x)))
        return min(options, default=(1 << 40, "", ()))

    cost, audit, lines = best(0, "", 0)
    n = [faults.count(k) for k in ("blank", "duplicate", "truncated")]
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *n, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def made(seed, convs=60, turns=9):
    r = random.Random(seed)
    texts = ["", " ", "Yes.", "No!", "what", "é?", "a\nb. ", ".!?", "fine. \t", None]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None, "utter", "s"]
    out = []
    for conv in [*range(-5, convs), None]:
        for k in range(r.randrange(turns)):
            turn = None if r.random() < 0.05 else k + r.randrange(3) if r.random() < 0.3 else k
            out.append((conv, turn, ("user", "assistant")[k % 2] if r.random() < 0.6 else r.choice(roles), r.choice(texts) if r.random() < 0.5 else f"own {r.randrange(6)}."))
    return out


def got(spark, rows):
    docs = spark.createDataFrame([(*row, 1, 2) for row in rows], SCHEMA)
    return sorted(map(tuple, repair.repaired(docs).collect()), key=repr)


@pytest.mark.parametrize("seed", range(4))
def test_equals_a_plain_search(spark, seed):
    rows = made(seed)
    assert got(spark, rows + rows[:30]) == plain(rows + rows[:30])


@pytest.fixture
def many_ranges(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("few", [0, 100_000])
def test_long_conversations_over_many_ranges(spark, many_ranges, monkeypatch, seed, few):
    monkeypatch.setattr(repair, "PIECE", 50)
    monkeypatch.setattr(repair, "FEW_AGAIN", few)
    rows = made(seed, 12, 120) + made(seed + 50, 0, 200)
    assert got(spark, rows) == plain(rows)


def test_ranges_that_hold_no_rows_after_the_damage(spark, many_ranges):
    gone = [t for t in range(4000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0]
    rows = [(7, t, "user", "x.") for t in gone] + [(8, t, "assistant", "y") for t in range(3)]
    assert got(spark, rows) == plain(rows)


def test_an_empty_table_and_a_very_long_text(spark):
    assert got(spark, []) == []
    rows = [(1, 0, "user", "word " * 400_000), (1, 1, "assistant", "end.")]
    assert got(spark, rows) == plain(rows)


def test_query_over_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op12_repair"](spark, sf).collect()), key=repr) == plain(rows)
