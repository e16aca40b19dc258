"""The near-copy stage against the plain rule: Jaccard similarity of 0.8 or more over shingles of five words."""

import random

import pytest

import corpus_pipeline
from quillmesh.llm import nearcopies


def plain_shingles(text):
    w = (text or "").lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    """Smallest id of each group; rows of (doc_id, ASCII text)."""
    sets = {i: plain_shingles(t) for i, t in rows}
    root = {i: i for i in sets}
    while True:
        before = dict(root)
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if root[a] != root[b] and (sets[a] == sets[b] or 5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                    low, high = sorted((root[a], root[b]))
                    root = {i: low if r == high else r for i, r in root.items()}
        if root == before:
            return sorted(set(root.values()))


def edited(seed):
    """Texts with copies that differ in a few words, so that similarities lie on both sides of 0.8."""
    r = random.Random(seed)
    rows = [(0, None), (1, ""), (2, "two words"), (3, "Two  words")]
    for _ in range(25):
        words = [f"w{r.randrange(5000)}" for _ in range(r.randint(60, 300))]
        for _ in range(r.randint(1, 5)):
            copy = list(words)
            for _ in range(r.randint(0, len(words) // 25)):
                copy[r.randrange(len(copy))] = f"x{r.randrange(5000)}"
            rows.append((len(rows), " ".join(copy)))
    return rows


@pytest.mark.parametrize("group", [1024, 2])
def test_stage_finds_all_near_copies(spark, monkeypatch, group):
    monkeypatch.setattr(nearcopies, "GROUP", group)
    rows = edited(7)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == plain_kept(rows)


def test_pigeonring_links_are_candidates(spark, monkeypatch):
    """Without the keys of minima, copies whose fingerprints are within four bits still go, and likeness still decides."""
    words = [f"w{k}" for k in range(300)]
    rows = [(k, " ".join(words[k : k + 296])) for k in range(5)]
    rows += [(10 + k, f"quite another text {k}") for k in range(3)]
    prints = [nearcopies.majority(nearcopies.shingles(t)) for _, t in rows]
    assert all((prints[k] ^ prints[k + 1]).bit_count() <= 4 for k in range(4))
    monkeypatch.setattr(nearcopies, "stars", lambda keyed, stars=nearcopies.stars: stars(keyed.where("key not in (select key from band_keys)")))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    nearcopies.signatures(docs).selectExpr("explode(keys) as key").createOrReplaceTempView("band_keys")
    assert sorted(r.doc_id for r in nearcopies.one_of_each(docs).collect()) == plain_kept(rows) == [0, 10, 11, 12]


def test_linked_fingerprints_of_unlike_sets_stay(spark, monkeypatch):
    """Linked fingerprints make candidates only: the sets are compared."""
    docs = spark.createDataFrame([(1, "one two three four five six"), (2, "seven eight nine ten eleven twelve")], "doc_id long, text string")
    own = nearcopies.signatures
    monkeypatch.setattr(nearcopies, "signatures", lambda d: own(d).selectExpr("doc_id", "print", "text_key", "load", "0L as fingerprint", "keys"))
    assert nearcopies.one_of_each(docs).count() == 2


def test_bounds_are_met_exactly():
    a = nearcopies.shingles(" ".join(f"w{i}" for i in range(13)))  # 9 shingles
    assert len(a) == 9
    assert len(nearcopies.similar([a, a[:8]])[0]) == 1 and len(nearcopies.similar([a, a[:7]])[0]) == 0
    assert len(nearcopies.similar([a[:5], a[:4]])[0]) == 1  # 4 of 5


def test_repeated_and_missing_ids(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, "no id here")], "doc_id long, text string")
    assert sorted(map(str, (r.doc_id for r in nearcopies.one_of_each(docs).collect()))) == ["1", "None"]
    assert nearcopies.one_of_each(docs.where("false")).count() == 0
