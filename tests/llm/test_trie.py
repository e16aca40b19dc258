"""Tries of conversations against a plain dictionary of prefixes."""

import hashlib
import random
import zlib

import pytest

from quillmesh.llm import trie
from quillmesh.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, ID int, _PART int"


def plain(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            told = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            convs.setdefault(conv, []).append(((turn is not None, turn or 0, role.encode(), told), (role, text)))
    own = {c: tuple(t for _, t in sorted(x)) for c, x in convs.items()}
    made = {}
    for c, turns in own.items():
        base, h = c - int(abs(c) % 5) * (1 if c >= 0 else -1), zlib.crc32(str(c).encode()) % 9
        made[c] = own.get(base, ())[:h] + turns[h:]
    members = {}
    for c, seq in made.items():
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    sums = {}
    for p in sorted(members, key=len, reverse=True):
        below = [sums[k] for k in kids.get(p, [])]
        value = (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        sums[p] = (sum(b[0] for b in below) or 1, value + sum(b[1] for b in below))
    out = []
    for p, cs in members.items():
        ends = ",".join(str(c) for c in sorted(c for c in cs if made[c] == p))
        out.append((min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(kids.get(p, [])), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, rows, local=None):
    docs = spark.createDataFrame([(*row, 1, 2) for row in rows], SCHEMA)
    df = trie.nodes(docs, local)
    assert df.schema.simpleString() == "struct<" + trie.NODES.replace(", ", ",").replace(" ", ":").replace("long", "bigint") + ">"
    return sorted(map(tuple, df.collect()), key=repr)


def made(seed, convs=40, turns=14):
    r = random.Random(seed)
    texts = ["a", "b", "ü", "", None]
    out = []
    for conv in [*range(-7, convs), 10**12, 10**12 + 3]:
        if r.random() < 0.15:
            continue
        copied = r.random() < 0.3
        for k in range(r.randrange(turns)):
            turn = None if r.random() < 0.05 else k
            out.append((conv, turn, ("user", "assistant")[k % 2] if r.random() < 0.9 else None, "same" if copied else r.choice(texts)))
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed, local", [(0, 25), (1, 60), (2, None), (3, None)])
def test_equals_a_dictionary_of_prefixes(spark, seed, local):
    rows = made(seed)
    assert got(spark, rows + rows[:20], local) == plain(rows + rows[:20])


@pytest.mark.parametrize("local", [150, None])
def test_over_many_ranges(spark, monkeypatch, local):
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")}
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    monkeypatch.setattr(trie, "SPAN", 4)
    monkeypatch.setattr(trie, "PIECE", 6)
    try:
        rows = made(5, 6, 40) + [(c, t, "user", f"x{t}") for c in (50, 51, 52, 55) for t in range(30)]
        assert got(spark, rows, local) == plain(rows)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_buckets_are_salted_where_they_are_many(spark, monkeypatch):
    monkeypatch.setattr(trie, "few", lambda df: df)
    rows = made(9)
    assert got(spark, rows, 60) == plain(rows)


def test_long_shared_chains_take_one_round(spark, monkeypatch):
    rounds, agreeing = [], trie._agreeing
    monkeypatch.setattr(trie, "_agreeing", lambda *a: rounds.append(1) or agreeing(*a))
    rows = [(c, t, "user", f"turn {t}") for c in range(0, 50, 5) for t in range(60 if c else 61)]
    assert got(spark, rows, 20) == plain(rows) and len(rounds) == 1


def test_empty_and_turnless(spark):
    assert got(spark, []) == []
    assert got(spark, [(None, 1, "user", "x")]) == []
    rows = [(c, 0, "user", "only") for c in range(1, 5)] + [(7, 0, "user", "w" * 3_000_000)]
    assert got(spark, rows) == plain(rows)


def test_query_over_the_whole_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted(map(tuple, QUERIES["op13_trie"](spark, sf).collect()), key=repr) == plain(rows)
