"""Tags with any number of aliases against a plain ranking."""

import random
from difflib import SequenceMatcher

import numpy as np
import pytest

from quillmesh.functions.text import folded
from quillmesh.operators import labels
from quillmesh.plans import retrieval as _  # noqa: F401  it registers its queries
from quillmesh.plans.registry import QUERIES


def plain(text, tags):
    own = folded(text or "")
    if len(own) < 2:
        return None, 0.0
    score = lambda a: 1.0 if a == own else 0.95 if len(a) >= 3 and a in own else SequenceMatcher(None, own, a).ratio()
    ranked = sorted(((max(map(score, map(folded, aliases))), tag) for tag, aliases in tags.items()), reverse=True)
    best, second = ranked[0], ranked[1] if len(ranked) > 1 else (0.0, None)
    return (best[1] if best[0] >= 0.65 and best[0] - second[0] >= 0.05 else None), best[0]


def check(spark, texts, tags, **kw):
    rows = [(tag, k, a) for tag, aliases in tags.items() for k, a in enumerate(aliases)]
    df = labels.best_tags(spark.createDataFrame([(t,) for t in texts], "read string"), spark.createDataFrame(rows + [(None, 0, "x"), ("t", 0, None)], "tag string, place int, alias string"), **kw)
    got = {r.read: (r.label, round(r.score, 9)) for r in df.collect()}
    own = {t: a[:1] for t, a in tags.items()} if kw else tags
    want = {t: plain(t, own) for t in texts}
    assert got == {t: (x, round(s, 9)) for t, (x, s) in want.items()}
    return got


def test_two_aliases_of_one_tag_do_not_reject_each_other(spark):
    tags = {"H05": ["H-05", "PANEL H05", "H 05 X"], "H06": ["H06"]}
    got = check(spark, ["panel h05", "H05", "hO5", "H0", None, "z", "PANEL-H05-H06"], tags)
    assert got["panel h05"] == ("H05", 1.0) and got["PANEL-H05-H06"][0] is None
    assert check(spark, ["panel h05", "H05"], tags, first_only=True)["panel h05"] == ("H05", 0.95)
    assert check(spark, ["H05"], {"one": ["H05"]})["H05"] == ("one", 1.0)


@pytest.mark.parametrize("block", [5, 4096])
def test_any_number_of_tags(spark, monkeypatch, block):
    monkeypatch.setattr(labels, "ALIASES", block)
    monkeypatch.setattr(labels, "TEXTS", 16)
    r = random.Random(3)
    word = lambda: "".join(r.choice("ABCDEFO0I1ÄЖ") for _ in range(r.randrange(1, 9)))
    tags = {f"t{k}": [word() for _ in range(r.randrange(1, 4))] for k in range(150)}
    texts = {a + r.choice(["", "X", "7"]) if r.random() < 0.5 else word() + word() for aliases in tags.values() for a in aliases}
    check(spark, sorted(texts), tags)


def test_similarity_is_computed_where_it_can_matter():
    r = random.Random(1)
    aliases = ["".join(r.choice("ABCDEFGHJKMNPQRTUVWXY3467") for _ in range(8)) for _ in range(4000)]
    texts = [a[:7] for a in aliases[:40]]
    ranked = [labels.Ranked() for _ in texts]
    done = labels.compare(texts, ranked, aliases, aliases, labels.counts(aliases))
    assert [x.tag for x in ranked] == aliases[:40] and done < 0.02 * 40 * 4000
    assert np.all(labels.bounds(labels.counts(["AB"]), labels.counts(["AB", "BA", "CD"])) == [[1, 1, 0]])


def test_query_over_all_parts(spark, sf):
    parts = spark.read.parquet(f"{sf}/part.parquet").collect()
    turn = lambda s: " ".join(s.split(" ")[::-1])
    both, first = {r.p_name: [r.p_name, turn(r.p_name)] for r in parts}, {r.p_name: [r.p_name] for r in parts}
    got = {r.p_partkey: r for r in QUERIES["f24_w2_several_aliases"](spark, sf).collect()}
    assert len(got) == len(parts)
    for r in parts:
        k = r.p_partkey % 4
        read = turn(r.p_name) if k == 0 else r.p_name[:-2] if k == 1 else f"{r.p_size}{turn(r.p_name)}" if k == 2 else r.p_name.translate(str.maketrans("olisz", "01152"))
        for (label, score), (a, b) in ((plain(read, both), ("label", "score")), (plain(read, first), ("first_label", "first_score"))):
            assert got[r.p_partkey][a] == label and abs(got[r.p_partkey][b] - score) < 1e-4
