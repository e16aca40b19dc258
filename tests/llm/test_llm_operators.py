"""The training-data operators against plain versions, round trips and held-out accuracy, with awkward rows in every table."""

import base64
import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import regex
import tiktoken
import xxhash

from quillmesh.llm import bpe, decontaminate, extract, grams, phrases, pii, quality, secrets, simhash, suffixes, toxicity
from quillmesh.llm.fingerprint import fingerprint
from quillmesh.operators import graph as components

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
#: A clash with names that operators make, and rows that are null, empty, of white space, long, repeated, or have no id.
EXTRA = "doc_id long, text string, block int, print long, _key string"


def awkward(spark):
    words = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()
    r = random.Random(4)
    long = " ".join(r.choice(words) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, long), (5, "same text of some few words"), (6, "same text of some few words"), (6, "same text of some few words"), (None, "no id here"), (7, long[:400] + "é" + long[400:]), (8, "x" * 5000)]
    return spark.createDataFrame([(i, t, 1, 2, "k") for i, t in rows], EXTRA)


def empty(spark):
    return spark.createDataFrame([], EXTRA)


def documents(sf):
    import pyarrow.parquet as pq

    return pq.read_table(f"{sf}/documents.parquet").select(["doc_id", "text"]).to_pydict()


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library():
    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(encoder, library, sf):
    r = random.Random(1)
    odd = ["", " ", "  a  b ", "foo \n bar\n baz", "日本語 ½ １２", "😀's we'll", "x" * 2000, "ab" * 700, " \n", "a b  c"]
    odd += ["".join(r.choice(" \n\tab'1.é½日s") for _ in range(40)) for _ in range(500)] + documents(sf)["text"]
    for text, ids in zip(odd, encoder.encode(odd), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_bpe_trees_agree(encoder):
    r = random.Random(2)
    pieces = [bytes(r.choice(b"abcdehinorst") for _ in range(r.randint(1, 64))) for _ in range(300)]
    grouped = bpe.merge_group(pieces, 64, encoder.v)
    assert grouped == [bpe.merge_one(p, encoder.v) for p in pieces]


def test_bpe_of_a_very_long_piece(encoder, library):
    import tracemalloc

    r = random.Random(8)
    text = "".join(r.choice("abcdehinorst") for _ in range(200_000))
    tracemalloc.start()
    ids = encoder.encode([text])[0]
    assert tracemalloc.get_traced_memory()[1] < 120 * len(text)
    tracemalloc.stop()
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text)


def test_bpe_plain_words_are_the_patterns_pieces(encoder):
    r = random.Random(4)
    letters = regex.compile(r"\p{L}")
    assert all(bool(bpe._WORD.fullmatch(c)) <= bool(letters.fullmatch(c)) for c in map(chr, range(0x110000)))
    words = ["".join(r.choice(" aébZßʰ.,;:!?'0-\n中\u0301") for _ in range(r.randint(1, 7))) for _ in range(20_000)]
    plain = [(w, p) for w in words if (p := encoder.word(w))]
    assert len(plain) > 500 and all([x for x in (p, w[len(p) :]) if x] == encoder.pattern.findall(w) for w, p in plain)


def test_bpe_merges_a_usual_words_pieces_once(monkeypatch):
    """A word is merged once, whatever stops follow it, and is still known after many words that occur once."""
    encoder, merged, plain = bpe.Encoder(PATH, public_tokenizers.PATTERN, memo=40_000), [], bpe.merge_group
    monkeypatch.setattr(bpe, "merge_group", lambda pieces, width, v: merged.extend(pieces) or plain(pieces, width, v))
    fresh = bpe.Encoder(PATH, public_tokenizers.PATTERN)
    for k in range(30):
        text = "a zqusualxword zqusualxword" + ".,;:!?"[k % 6] + "".join(f" q{chr(97 + k % 26)}{chr(97 + j % 26)}zx{chr(97 + j // 26)}{chr(97 + k // 26)}" for j in range(60))
        assert encoder.encode([text]) == fresh.encode([text])
        assert encoder.held <= 40_000
    assert merged.count(b" zqusualxword") <= 2  # once by either encoder


def test_bpe_forgets_without_changing(sf):
    small = bpe.Encoder(PATH, public_tokenizers.PATTERN, memo=50)
    texts = documents(sf)["text"][:40]
    assert small.encode(texts) == bpe.Encoder(PATH, public_tokenizers.PATTERN).encode(texts)


def test_secret_bases_and_random_strings():
    e = secrets.tokens(PATH, public_tokenizers.PATTERN)
    text = 'Password = "hunter22" api_key:abc TOKEN=x1y2z3 AKIA' + "A" * 16 + " AKIA1 " + "0123456789abcdef" * 2 + " é deadbeef"
    found = [(text[a:b], k) for a, b, k in secrets.ordered(secrets.base_spans(text))]
    assert found == [('Password = "hunter22', "assign"), ("TOKEN=x1y2z3", "assign"), ("AKIA" + "A" * 16, "access"), ("0123456789abcdef" * 2, "hex")]
    r = random.Random(3)
    keys = ["".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(32)) for _ in range(50)]
    assert sum(bool(secrets.random_spans(f"the {k} end", e)) for k in keys) >= 47
    for plain in ("internationalisation", "some_long_snake_case_name", "CamelCaseIdentifierName", "123e4567-e89b-12d3-a456-426614174000", "d41d8cd98f00b204e9800998ecf8427e", "1234567890123456789012"):
        assert not secrets.random_spans(plain, e), plain


def brute_repeat_words(words, n=5):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i : i + n]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def test_quality_counts(sf):
    texts = [*documents(sf)["text"][:80], "", " ", "a b\na b\n\n \na b", "one " * 30, "é#* ü x"]
    for text in texts:
        c, words = quality.count(text), re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (len(c.words), c.word_chars, c.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert c.n_dup_lines == len(lines) - len(set(lines)) and c.n_repeat_words == brute_repeat_words(words)


def test_cascade_order_does_not_change_verdicts(sf):
    counts = [quality.count(t) for t in documents(sf)["text"]]
    order = quality.ordered(quality.measured(counts))
    assert sorted(order) == sorted(n for n, _ in quality.RULES)
    for cascade in (quality.Cascade(order), quality.Cascade(order[::-1])):
        assert [bool(cascade.rejects(c)) for c in counts] == [any(test(c) for _, test in quality.RULES) for c in counts]


def test_cascade_asks_by_rejections_per_second(spark, sf):
    assert quality.ordered({"dear": (2.0, 10), "cheap": (0.1, 10), "idle": (0.5, 0), "idle and cheap": (0.1, 0)}) == ["cheap", "dear", "idle and cheap", "idle"]
    asked = []
    rules = [(n, lambda c, n=n: asked.append(n) or n == "b") for n in "abc"]
    assert quality.Cascade(["c", "b", "a"], rules).rejects(quality.count("x")) == "b" and asked == ["c", "b"]
    assert sorted(quality.plan(spark.read.parquet(f"{sf}/documents.parquet"))) == sorted(n for n, _ in quality.RULES) and quality.plan(empty(spark)) == [n for n, _ in quality.RULES]


def test_quality_keeps_good_and_drops_bad(sf):
    import pyarrow.parquet as pq

    of = pq.read_table("/root/testdata/sf0.01/labels.parquet").to_pydict()
    label, docs = dict(zip(of["doc_id"], of["quality"], strict=True)), documents("/root/testdata/sf0.01")
    kept = {0: [], 1: []}
    for i, t in zip(docs["doc_id"], docs["text"], strict=True):
        c = quality.count(t)
        if i in label and not quality.base_failed(c):
            kept[label[i]].append(not quality.Cascade([n for n, _ in quality.RULES]).rejects(c))
    assert np.mean(kept[1]) > 0.98 and np.mean(kept[0]) < 0.3


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def test_fingerprints(sf):
    for text in [*documents(sf)["text"][:40], "", "a", "A b C", "a b c d", "Ä b  c\td e"]:
        assert fingerprint(text) == brute_fingerprint(text)


def brute_components(prints, distance=4):
    root = list(range(len(prints)))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1 :]) <= distance).tolist():
            a, b = sorted((find(i), find(i + 1 + j)))
            root[b] = a
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("group", [1024, 5])
def test_ring_links_lose_nothing(spark, monkeypatch, group):
    r = np.random.default_rng(6)
    centres = r.integers(0, 1 << 63, 12, np.uint64)
    prints = set(centres.tolist()) | {0}
    for c in centres.tolist():
        for _ in range(14):
            prints.add(c ^ sum(1 << int(b) for b in r.choice(64, r.integers(1, 7), replace=False)))
    prints = np.array(sorted(prints), np.uint64)
    monkeypatch.setattr(simhash, "GROUP", group)
    df = spark.createDataFrame([(int(p),) for p in prints.view(np.int64)], "print long")
    got = {x.node: x.root for x in components.components(simhash.links(df)).collect()}
    expected, by = brute_components(prints), {}
    for p, root in zip(prints.view(np.int64).tolist(), expected, strict=True):
        by.setdefault(root, []).append(p)
    for members in by.values():
        assert {got.get(p, p) for p in members} == {min(members)}


def test_ring_keys_cover_all_close_pairs():
    r = np.random.default_rng(8)
    a = r.integers(0, 1 << 63, 4000, np.uint64)
    b = np.array([int(x) ^ sum(1 << int(k) for k in r.choice(64, n % 5, replace=False)) for n, x in enumerate(a)], np.uint64)
    assert ((simhash.ring_keys(a) == simhash.ring_keys(b)).any(1)).all()


def test_long_chain_of_components(spark):
    links = [(i, i + 1) for i in range(150)] + [(500, 501), (9, 9)]
    got = {x.node: x.root for x in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(151), 0), 500: 500, 501: 500}


def test_near_duplicates_of_awkward_rows(spark):
    docs = awkward(spark)
    rows = [r.asDict() for r in simhash.near_duplicates(docs).collect()]
    assert len(rows) == docs.count()
    by = {(r["doc_id"], r["print"]): r["component_id"] for r in rows}
    assert {v for (i, p), v in by.items() if p == 0} == {1} and {by[i, p] for i, p in by if i in (5, 6)} == {5}
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=lambda v: (v is None, v)) == sorted({v for v in by.values() if v is not None}) + [None]
    assert simhash.near_duplicates(empty(spark)).count() == 0 and simhash.one_of_each(empty(spark)).count() == 0


def brute_windows(ids, texts, n):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    first = {}
    key = [float("inf") if i is None else i for i in ids]
    for i, w in zip(key, words, strict=True):
        for k in range(len(w) - n + 1):
            first[tuple(w[k : k + n])] = min(first.get(tuple(w[k : k + n]), i), i)
    out = []
    for i, shown, w in zip(key, ids, words, strict=True):
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            if first[tuple(w[k : k + n])] < i:
                gone[k : k + n] = [True] * n
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((shown, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def passages(seed, n_docs=60):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    shared = [[r.choice(vocabulary) for _ in range(r.randint(8, 140))] for _ in range(12)]
    texts = []
    for _ in range(n_docs):
        parts = []
        for _ in range(r.randint(0, 6)):
            p = r.choice(shared) if r.random() < 0.5 else [r.choice(vocabulary) for _ in range(r.randint(1, 60))]
            cut = r.randint(0, len(p) // 3)
            parts += p[cut:] if r.random() < 0.5 else p
        texts.append("".join(w + r.choice((" ", "  ", "\n", " \t")) for w in parts))
    ids = [r.randint(0, 50) if r.random() < 0.9 else None for _ in texts]
    return ids, [*texts[:-1], None]


@pytest.mark.parametrize(("blocks", "fan"), [((1, 1), 1 << 14), ((7, 5), 1 << 14), ((30, 20), 4)])
def test_phrases_match_brute_force(spark, monkeypatch, blocks, fan):
    monkeypatch.setattr(phrases, "layout", lambda docs: blocks)
    monkeypatch.setattr(grams, "FAN", fan)
    ids, texts = passages(1)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in phrases.without_repeats(df, digests=True).collect()]
    assert sorted(got, key=repr) == brute_windows(ids, texts, 13)


def phrases_in_process(ids, texts, blocks, buckets):
    """The steps of the operator, one after another in this process."""
    import pyarrow as pa
    import pyarrow.compute as pc

    to_buckets, to_blocks = grams.Exchange(buckets, hash="delta", doc="i8", block="i4"), grams.Exchange(blocks, hash="delta", asker="i4")
    own = {}
    for k, (i, t) in enumerate(zip(ids, texts, strict=True)):
        own.setdefault((k if i is None else i) % blocks, []).append((i, t or "", (k if i is None else i) % blocks))
    own = {b: pa.Table.from_pylist([dict(zip(("doc_id", "text", "block"), r, strict=True)) for r in rows], schema=pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("block", pa.int32())])) for b, rows in own.items()}
    parts = lambda table, key: {k: table.filter(pc.equal(table[key], k)) for k in set(table[key].to_pylist())}
    sent = pa.concat_tables([phrases.send(t, 13, buckets, to_buckets) for t in own.values()])
    asks = parts(pa.concat_tables([phrases.confirm(t, to_buckets, to_blocks) for t in parts(sent, "at").values()]), "at")
    told = parts(pa.concat_tables([phrases.answer(t, asks.get(b, to_blocks.table([])), 13, buckets, to_blocks) for b, t in own.items()]), "block")
    schema = phrases.out_schema(True)[1]
    rows = pa.concat_tables([phrases.finish(t, told.get(b, phrases._PASSAGES.empty_table()), 13, buckets, schema, True) for b, t in own.items()]).to_pylist()
    return sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows), key=repr)


def test_phrases_come_from_the_automaton(monkeypatch):
    ids, texts = passages(5)
    expected = brute_windows(ids, texts, 13)
    assert phrases_in_process(ids, texts, 5, 3) == expected
    with monkeypatch.context() as m:  # no automaton, no answer
        m.setattr(phrases.Shard, "found", lambda self, words, doc: [])
        assert not any(r[2] for r in phrases_in_process(ids, texts, 5, 3))
    with monkeypatch.context() as m:  # a holder of many askers answers through others
        m.setattr(phrases, "ASKERS", 1)
        assert phrases_in_process(ids, texts, 9, 3) == expected
    whole = grams.windows
    with monkeypatch.context() as m:  # different windows of one hash take nothing out wrongly
        m.setattr(phrases, "windows", lambda words, n: ((h := whole(words, n))[0] & np.uint64(0xFF << 56), h[1]))
        got = {(r[0], r[1]): r[2] for r in phrases_in_process(ids, texts, 5, 3)}
        assert all(got[r[0], r[1]] <= r[2] for r in expected if sum(x[:2] == r[:2] for x in expected) == 1)


def test_phrases_of_periodic_text():
    text = "a " * 20000 + "b c " * 5000
    rows = phrases_in_process([1, 2, 3], [text, text, "c " * 13 + "a"], 2, 2)
    assert [r[2] for r in rows] == [0, 30000, 0]


@pytest.mark.parametrize(("blocks", "crowd", "fan"), [((1, 1), 64, 1 << 14), ((7, 5), 64, 1 << 14), ((7, 5), 3, 1 << 14), ((30, 20), 3, 4)])
def test_suffixes_match_brute_force(spark, monkeypatch, blocks, crowd, fan):
    monkeypatch.setattr(suffixes, "layout", lambda docs: blocks)
    monkeypatch.setattr(suffixes, "CROWD", crowd)
    monkeypatch.setattr(grams, "FAN", fan)
    ids, texts = passages(2)
    df = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string")
    got = [(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in suffixes.without_passages(df, digests=True).collect()]
    expected = brute_windows(ids, texts, 50)
    assert sorted(got, key=repr) == expected and any(e[2] for e in expected)


def test_dedup_of_awkward_rows(spark):
    for f in (phrases.without_repeats, suffixes.without_passages):
        got = [(r.doc_id, r.n_words, r.n_removed) for r in f(awkward(spark)).collect()]
        assert len(got) == 10 and (4, 3000, 0) in got and (7, 3000, 0) not in got and (1, 0, 0) in got
        assert f(empty(spark)).count() == 0


def test_word_hashes_do_not_depend_on_place(spark):
    import pyarrow as pa

    texts = pa.array(["", "b a", "a  b\nlonger-word", " a", "xé é"])
    w = grams.words_of(texts)
    assert [w.text(i, i + 1)[0].decode() for i in range(len(w.hash))] == ["b", "a", "a", "b", "longer-word", "a", "xé", "é"]
    assert w.row.tolist() == [1, 1, 2, 2, 2, 3, 4, 4] and w.hash[1] == w.hash[2] == w.hash[5] and w.hash[0] == w.hash[3] and len(set(w.hash.tolist())) == 5
    again = grams.words_of(texts.slice(2, 2))
    assert again.hash.tolist() == w.hash[2:6].tolist()
    way = grams.Exchange(9, hash="delta", n="i4", pair="raw:u1:2")
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, np.uint64))
    n, pair = np.arange(-25, 25, dtype=np.int32), np.arange(100, dtype=np.uint8).reshape(-1, 2)
    back = way.columns(way.table(way.rows(np.repeat([3, 8], 25), 1, hash=x, n=n, pair=pair)))
    assert (back["hash"] == x).all() and (back["n"] == n).all() and (back["pair"] == pair).all()


def brute_hits(text, items):
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    w, hit, found = low(text), set(), set()
    for item, t in items:
        v = low(t)
        n = min(10, len(v))
        for k in range(len(v) - n + 1) if v else ():
            for j in range(len(w) - n + 1):
                if w[j : j + n] == v[k : k + n]:
                    hit |= set(range(j, j + n))
                    found.add(item)
    return len(w), len(hit), sorted(map(str, found))


@pytest.mark.parametrize("shard", [8 << 20, 60])
def test_decontamination_matches_brute_force(spark, shard):
    items = [(1, "One two, three four five six seven eight nine ten eleven twelve"), (2, "short ITEM"), (10, "short item"), (3, None), (4, "!!"), (5, "é-x Ünder 7"), (None, "no id")]
    docs = [(1, "say: one TWO three-four five six seven eight nine ten eleven... end"), (2, "a short item, short item"), (3, None), (4, ""), (5, "É-x é x Ünder 7 ünder"), (6, "shortitem one two three"), (7, "a short item, short item")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: r for r in decontaminate.overlaps(d, b, shard).collect()}
    for i, text in docs:
        assert (got[i].n_words, got[i].n_hit, got[i].item_ids) == brute_hits(text, [x for x in items if x[0] is not None]), i
    assert docs[0][1][got[1].spans[0].start : got[1].spans[0].end] == "one TWO three-four five six seven eight nine ten eleven"
    assert {r.doc_id for r in decontaminate.clean(d, b, shard).collect()} == {3, 4, 6}
    assert decontaminate.overlaps(awkward(spark), b.where("false")).where("contaminated").count() == 0
    assert decontaminate.overlaps(empty(spark), b).count() == 0


def test_toxicity_on_held_out_labels(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels)
    rows = toxicity.scored(docs, model, evidence=True).join(labels, "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert np.mean([r.predicted for r in toxic]) > 0.85 and np.mean([r.predicted for r in clean]) < 0.03
    assert all(e.cosine <= 1 + 1e-9 and not toxicity.held_out(e.doc_id) for r in toxic for e in r.evidence)
    some = {r.doc_id: r for r in rows}
    texts = {r.doc_id: r.text for r in docs.where(docs.doc_id.isin([r.doc_id for r in toxic[:25]])).collect()}
    everything = np.zeros((len(model.labels), len(model.terms)))
    for i, lists in enumerate(model.rows):
        for b, (at, w) in lists.items():
            everything[b * toxicity.BLOCK + at, i] = w
    for i, text in texts.items():  # block-max search against all examples
        counts = toxicity.Scorer(model).counts(text)
        if counts:
            t, w = model.vector(counts)
            cosines = everything[:, t] @ w
            order = np.lexsort((np.arange(len(cosines)), -cosines))[: toxicity.NEAREST]
            assert np.allclose([c for _, c in model.nearest(counts)], [cosines[k] for k in order if cosines[k] > 0])
            assert [e.cosine for e in some[i].evidence] == [c for _, c in model.nearest(counts)]


def test_toxicity_query_recomputed(spark):
    """Scores, verdicts and held-out rows of the query from a search of all examples."""
    from quillmesh.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    dense = np.zeros((len(model.labels), len(model.terms)))
    for i, lists in enumerate(model.rows):
        for b, (at, w) in lists.items():
            dense[b * toxicity.BLOCK + at, i] = w
    texts = dict(zip(*documents(sf).values(), strict=True))
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        counts: dict[int, int] = {}
        for term, n in toxicity.terms_of(texts[r.doc_id] or "").items():
            if term in model.terms:
                counts[model.terms[term]] = n
        score = model.none
        if counts:
            t = np.array(sorted(counts))
            w = np.array([1 + np.log(counts[k]) for k in t]) * model.idf[t]
            cosine = dense[:, t] @ (w / np.sqrt((w * w).sum()))
            near = [k for k in np.lexsort((np.arange(len(cosine)), -cosine))[: toxicity.NEAREST] if cosine[k] > 0]
            if near:
                votes = model.weight[near] / (1.02 - cosine[near])
                score = np.interp((votes * model.labels[near]).sum() / votes.sum(), *model.steps)
        assert abs(r.score - score) < 1e-6 and r.predicted == int(r.score >= 0.3), r.doc_id
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_edges(spark):
    none = toxicity.train(empty(spark), spark.createDataFrame([], "doc_id long, toxic int"))
    assert {r.score for r in toxicity.scored(awkward(spark), none).collect()} == {0.0}
    x, y = toxicity.monotone(np.array([0.1, 0.2, 0.2, 0.9]), np.array([0.0, 1.0, 0.0, 1.0]), np.ones(4))
    assert (np.diff(y) >= 0).all() and (np.diff(x) >= 0).all()
    assert toxicity.accepted(awkward(spark), none).columns == awkward(spark).columns


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><a href=/>Home</a> Site</header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site to make it work well for you and all of your friends.</div><article><h1>The  Title</h1><p>First &amp; <b>bold</b>
words of the &eacute; article.<p>Second.<script>var x = "</p>";</script><form><label>Name</label><input name="n"></form><ul><li>Point one <a href=x>with link</a> here</li></ul></article>
<section id="comments"><p>A reader writes a long comment about all of this, with many words in it, to be sure it is long.</p></section><aside class="sidebar"><p>Side</p></aside><footer>&copy; me</footer>"""


def test_extraction():
    assert extract.main_text(PAGE) == "The Title\nFirst & bold words of the é article.\nSecond.\nPoint one with link here"
    assert extract.main_text("") == "" and extract.main_text("<nav><a href=x>y</a></nav>") == "" and extract.main_text("<!-- open <p>a") == ""
    plain = "<div><p>" + "word " * 40 + "</p><p>" + "more " * 30 + "</p></div>"
    assert extract.main_text(plain).count("\n") == 1
    for names in ("<article class='social'>", "<div class='ad-free-story'>", "<main id='sponsored'>"):  # names that mislead
        assert extract.main_text(names + "<p>" + "word " * 40 + "</p>") == ("word " * 40).strip()
    comments = "<article><h1>Title</h1><p>" + "word " * 50 + "</p></article><section id='comments'><article class='comment'><p>" + "reply " * 60 + "</p></article></section>"
    assert "reply" not in extract.main_text(comments) and extract.main_text(comments).count("word") == 50
    assert extract.main_text("<article><p>&#" + "9" * 5000 + "; &#00065;&nbsp;b") == "\ufffd A b"


def test_extraction_of_pages_not_trained_on():
    wrong = total = 0
    for seed in range(5000, 5150):
        page, labels = extract.layout(seed)
        found = extract.blocks(page)
        wrong += sum(extract.is_content(extract.tree(), row) != label for row, label in zip(extract.features(found).tolist(), labels, strict=True))
        total += len(labels)
    assert wrong < 0.01 * total


@pytest.mark.parametrize("page", ["<a " * 400_000, "<a x='" * 150_001, "<div>a" * 150_000, "<div>" * 100_000 + "</p>a" * 100_000, "<!--" * 250_000, "<script>" * 120_000, "<b c='>' " * 120_000, "&#" * 400_000, "<article class=ad>" * 60_000 + "x"])
def test_extraction_in_linear_time(page):
    began = time.process_time()
    extract.main_text(page)
    assert time.process_time() - began < 10


def test_extraction_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "u", PAGE, "t", 5)] * 2 + [(2, None, "<p>" + "long " * 200_000, "t", 5)]
    got = extract.extracted(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long"))
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    n = len("The Title\nFirst & bold words of the é article.\nSecond.\nPoint one with link here")
    assert sorted(r.n_chars for r in got.collect()) == [n, n, 999_999] and extract.extracted(got.withColumn("html", got.text).where("false")).count() == 0


def test_extraction_of_the_given_pages(spark, sf):
    for r in extract.extracted(spark.read.parquet(f"{sf}/pages.parquet")).join(spark.read.parquet(f"{sf}/pages.parquet"), "page_id").collect():
        article = regex.search("<article>(.*?)</article>", r.html, regex.DOTALL)[1]
        plain = [" ".join(extract.html.unescape(re.sub(r"<br>|</?b>", " ", p)).split()) for p in re.split(r"</?p>|</?h1>", article)]
        assert r.text == "\n".join(p for p in plain if p) and r.n_chars == len(r.text)
    rows = spark.createDataFrame([(1, None, None), (1, "u", "<p>x"), (None, "u", "")], "page_id long, url string, html string")
    assert {r.text for r in extract.extracted(rows).collect()} == {""}


def test_pii_bases():
    kinds = [k for _, _, k in pii.ordered(pii.base_spans("+1 (202) 555-0143, 4111 1111 1111 1111; 1.2.3.4 q@w.de"))]
    assert kinds == ["phone", "card", "ip", "email"]
    assert pii.base_spans("256.1.1.1 4111111111111112 x@y +12 3") == []


def test_pii_gradients():
    tagger = pii.Tagger(3)
    tagger.p = {k: v.astype(np.float64) for k, v in tagger.p.items()}
    text, spans = pii.labelled_text(1, 30)
    x, y, at = pii.classes(text), pii.tags_of(len(text), spans), np.array([[0], [40]]) + np.arange(20)
    _, grads = tagger.loss(x[at], y[at])
    for k, g in grads.items():
        i = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, out = tagger.p[k][i], []
        for d in (1e-4, -1e-4):
            tagger.p[k][i] = old + d
            out.append(tagger.loss(x[at], y[at])[0])
        tagger.p[k][i] = old
        assert abs((out[0] - out[1]) / 2e-4 - g[i]) < 2e-3, k


def test_pii_on_held_out_text(spark):
    model = pii.tagger()
    text, spans = pii.labelled_text(4242, 600)
    found = set(pii.predicted([text], model)[0])
    assert len(found & set(spans)) / len(found) > 0.95 and len(found & set(spans)) / len(spans) > 0.8
    assert pii.predicted(["no digits at all " * 50, ""], model) == [[], []]
    out = pii.personal_data(awkward(spark)).collect()
    assert len(out) == 10 and all(r.n_added == 0 for r in out)
    base, every = pii.found(["mail a.b@c.de or ring +1 (202) 555-0143 now"], model)[0]
    assert [k for *_, k in base] == ["email", "phone"] and set(base) <= set(every)
    assert pii.masked("ab 1.2.3.4 c", [(3, 10, "ip")]) == "ab [IP] c" and pii.reconcile([(0, 5, "ip", 1.0), (3, 9, "card", 3.0), (9, 12, "ip", 1.0)]) == [(3, 9, "card"), (9, 12, "ip")]


def test_windows_cover_every_character():
    for n in (0, 1, pii.LENGTH, pii.LENGTH + 1, pii.LENGTH + pii.STRIDE, 5000):
        starts = list(pii.window_starts(n))
        assert {i for a in starts for i in range(a, min(n, a + pii.LENGTH))} == set(range(n))
        assert all(b - a == pii.STRIDE for a, b in zip(starts, starts[1:], strict=False)) and (not n or starts[-1] == 0 or starts[-1] < n)


def test_every_window_is_run(monkeypatch):
    seen, model = [], pii.tagger()
    whole = pii.Tagger.scores
    monkeypatch.setattr(pii.Tagger, "scores", lambda self, x: seen.append(x) or whole(self, x))
    texts = ["no trigger at all in these words " * 90, "short", "", "x" * (pii.LENGTH + 1)]
    pii.predicted(texts, model)
    assert sum(int((x != pii.PAD).sum()) for x in seen) >= sum(map(len, texts))


def test_nothing_beyond_a_short_window_is_decoded(monkeypatch):
    """What the network makes of the padding of a shorter window is no reason to decode it, and a span at its own end is one."""
    model, decoded, plain = pii.tagger(), [], pii.Tagger.viterbi
    words = "the words of an ordinary line go on and on " * 24
    texts = [words[:n] for n in range(40, 1000, 5)]
    monkeypatch.setattr(pii.Tagger, "viterbi", lambda self, scores: decoded.append(scores.shape[1]) or plain(self, scores))
    assert pii.predicted(texts, model) == [[]] * len(texts) and sum(decoded) <= len(texts) // 20, sum(decoded)
    ends = [words[:n] + tail for n in range(40, 1000, 9) for tail in (" (202) 555-0143", " 4111.1111.1111.1111", " anna at mail dot com")]
    found = pii.predicted(ends, model)
    monkeypatch.setattr(pii.Tagger, "most_gain", lambda self, scores, *_: (np.full(scores.shape[1], np.inf),) * 2)
    assert sum(map(bool, found)) > 200 and found == pii.predicted(ends, model)  # as when every window is decoded


def test_scores_and_bounds_of_the_network():
    model, (text, _) = pii.tagger(), pii.labelled_text(5, 400)
    c = pii.classes(text)
    x = np.stack([c[i * 7 : i * 7 + 100] for i in range(150)])
    scores = model.scores(x)
    assert np.allclose(scores, model.run(x), atol=1e-3)
    (whole, cut), (tags, over) = model.most_gain(scores), model.viterbi(scores)
    for k in range(len(x)):
        for a, b, _, score, *_ in pii.tagged_spans(tags[k], over[k], 0, 100):
            if tags[k][a] % 2:  # the bounds are for spans that begin in the window
                assert score <= (cut if b == 100 else whole)[k] + 1e-3, k


def test_gates_need_no_tanh(monkeypatch):
    """The scores of use are those of the plain run, without its dear tanh, for gates at their limits too."""
    text, _ = pii.labelled_text(6, 100)
    x = pii.classes(text)[: 40 * 50].reshape(40, 50)
    for times in (1, 30, 1000):
        model = pii.Tagger()
        model.p = {k: v * times if k in ("x", "u") else v for k, v in pii.tagger().p.items()}
        plain = model.run(x)
        with monkeypatch.context() as m, np.errstate(invalid="raise"):
            m.setattr(np, "tanh", None)
            scores = model.scores(x)
        assert np.isfinite(scores).all() and (times > 1 or np.allclose(scores, plain, atol=1e-3)) and (scores.argmax(2) == plain.argmax(2)).mean() > 0.99


def test_windows_share_rows(monkeypatch):
    """Nearly every step is a character of a window, whatever the windows' lengths, and what stands beside a window is nothing to it."""
    model, text = pii.tagger(), pii.labelled_text(8, 400)[0]
    sizes = [1 + 37 * k % pii.LENGTH for k in range(900)]
    rows = pii.in_rows(sizes)
    assert sorted(k for row in rows for k in row) == list(range(900)) and max(sum(sizes[k] + 1 for k in row) - 1 for row in rows) == max(sizes)
    assert pii.in_rows([]) == [] and pii.in_rows([5]) == [[0]]
    a, b = pii.classes(text[:300]), pii.classes(text[300:350])
    x = np.full((2, 400), pii.PAD, np.uint8)
    x[0, :300], x[0, 301:351], x[1, :50] = a, b, b
    got = model.scores(x)
    for w, its in ((a, got[:300, 0]), (b, got[301:351, 0]), (b, got[:50, 1])):
        assert np.allclose(its, model.run(w[None])[:, 0], atol=1e-3)
    assert (got[[300, 351, 399], 0, 1:] <= -1e4).all() and (got[[300, 351, 399], 0, 0] == 0).all()
    steps, plain = [], pii.Tagger.scores
    texts = [text[k : k + n] for k, n in enumerate(sizes)]
    alone = [pii.predicted([t], model)[0] for t in texts[:60]]
    monkeypatch.setattr(pii.Tagger, "scores", lambda self, x: steps.append(x.size) or plain(self, x))
    assert pii.predicted(texts, model)[:60] == alone and any(alone)
    assert sum(steps) <= 1.1 * sum(sizes), sum(steps) / sum(sizes)


@pytest.mark.parametrize("shift", [930, 955, 1000, 1020, 1950])
def test_spans_across_windows(shift):
    model = pii.tagger()
    plain = "the words of an ordinary line go on and on "
    lead = (plain * 60)[:shift]
    for span, kind in (("john.smith @ mail5.example.com", "email"), ("(202) 555-0143", "phone")):
        text = lead + " " + span + " " + plain * 30
        assert (shift + 1, shift + 1 + len(span), kind) in pii.predicted([text], model)[0], (shift, span)


def test_parts_of_long_spans_are_joined():
    text = "1" * 2000
    long = [(500, 640, 3, 9.0, False, True), (576, 700, 3, 8.0, True, False)]
    assert [s[:2] for s in pii.whole_spans(text.replace("1" * 150, "1" * 12 + " " * 138), long)] in ([(500, 700)], [])
    assert pii.whole_spans("1.2.3.4" + "x" * 900, [(0, 7, 1, 5.0, False, False), (3, 7, 1, 4.0, True, False)]) == [(0, 7, "ip", 5.0)]
    assert pii.whole_spans("x", [(576, 600, 0, 9.0, True, False)]) == []  # the window before did not see it go on


def test_addresses_in_words():
    model = pii.tagger()
    (found,) = pii.predicted(["please write to anna_berg at mail dot example dot com for more"], model)
    assert [k for *_, k in found] == ["email"]


@pytest.mark.parametrize("text", ["1" * 1_000_000, "a" * 1_000_000 + " @", "1." * 500_000, "a@" * 500_000, "+1 " * 300_000, "+1" + " " * 1_000_000, "0" * 6000 + ".1.1.1", "Ab0/" * 250_000])
def test_patterns_in_linear_time(text):
    began = time.process_time()
    pii.base_spans(text)
    assert time.process_time() - began < 5


def test_patterns_equal_the_plain_ones():
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"}
    r = random.Random(9)
    for _ in range(20_000):
        text = "".join(r.choice("a1.@_-2 ") for _ in range(r.randint(1, 30)))
        assert [m.span() for m in re.finditer(plain["email"], text)] == [m.span() for m in pii._EMAIL.finditer(text) if m[1]], text
        assert [m.span() for m in re.finditer(plain["ip"], text)] == [m.span() for m in pii._IP.finditer(text)], text


def brute_base(text):
    """Base spans by the patterns as they are given, ordered by start and kind."""
    out = [(m.start(), 0, m.end(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if max(map(int, m[0].split("."))) <= 255]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        double = [sum(divmod(2 * v, 10)) for v in d[-2::-2]]
        if 14 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(double)) % 10 == 0:
            out.append((m.start(), 2, m.end(), "card"))
    out += [(m.start(), 3, m.end(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(re.findall("[0-9]", m[0])) <= 15]
    return [(a, b, k) for a, _, b, k in sorted(out)]


def test_pii_query_against_plain_patterns(spark):
    from quillmesh.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    texts = dict(zip(*documents(sf).values(), strict=True))
    rows = QUERIES["op1_pii"](spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute_base(texts[r.doc_id] or "")
        shown = [f"{k}:{a}:{b}" for a, b, k in base]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(k == x for *_, k in base) for x in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        every = r.spans.split(",") if r.spans else []
        assert set(shown) <= set(every) and len(every) == len(base) + r.n_added


def test_secret_query_against_plain_patterns(spark):
    from quillmesh.llm.queries import QUERIES

    sf, e = "/root/testdata/sf0.01", secrets.tokens(PATH, public_tokenizers.PATTERN)
    texts = dict(zip(*documents(sf).values(), strict=True))
    rows = QUERIES["op5_secrets"](spark, sf).collect()
    assert len(rows) == len(texts) and sum(r.n_assign + r.n_hex for r in rows)
    for r in rows:
        t = texts[r.doc_id] or ""
        key = "(" + "|".join("".join(f"[{c}{c.upper()}]" for c in w) for w in ("password", "passwd", "secret", "token", "api")).replace("[aA][pP][iI]", "[aA][pP][iI]_?[kK][eE][yY]") + ")"
        found = [(m.start(), 0, m.end(), "assign") for m in re.finditer(key + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        shown = [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(x[1] == k for x in found) for k in range(3))
        assert r.base_sha256 == hashlib.sha256(",".join(shown).encode()).hexdigest()
        extra = [(int(a), int(b)) for k, a, b in (x.split(":") for x in r.spans.split(",") if x) if k == "random"]
        assert len(extra) == r.n_random and all(len(t[a:b]) < secrets.MOST_CHARS_PER_TOKEN * len(e.encode_ordinary(t[a:b])) for a, b in extra)


def test_bpe_query_against_the_library(spark, library):
    from quillmesh.llm.queries import QUERIES

    texts = dict(zip(*documents("/root/testdata/sf0.01").values(), strict=True))
    for r in QUERIES["op3_bpe"](spark, "/root/testdata/sf0.01").collect():
        ids = library.encode_ordinary(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest())


def test_simhash_query_against_all_pairs(spark):
    from quillmesh.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    ids, texts = documents(sf).values()
    prints = np.array([brute_fingerprint(t or "") for t in texts], np.uint64)
    root = brute_components(prints)
    least: dict[int, int] = {}
    for i, k in zip(ids, root, strict=True):
        least[k] = min(i, least.get(k, i))
    expected = {(i, f"{int(p):016x}", least[k]) for i, p, k in zip(ids, prints, root, strict=True)}
    assert {tuple(r) for r in QUERIES["op6_simhash"](spark, sf).select("doc_id", "fingerprint", "component_id").collect()} == expected


def test_bpe_and_secrets_and_quality_of_awkward_rows(spark, library):
    docs = awkward(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    for r in bpe.encoded(docs, PATH).collect():
        assert r.ids == library.encode_ordinary(texts[r.doc_id]) and r.decoded == texts[r.doc_id]
    for f in (lambda d: bpe.encoded(d, PATH), lambda d: secrets.secrets(d, PATH, public_tokenizers.PATTERN), quality.quality, pii.redacted, lambda d: bpe.tokenised(d, PATH)):
        assert f(docs).count() == 10 and f(empty(spark)).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    start = {r.doc_id for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, sf)
        if name != "bpe":
            assert docs.columns == before.columns, name
        docs = docs.checkpoint()
    ran = corpus_pipeline.run(spark, sf)
    assert ran.columns == docs.columns and sorted(r.doc_id for r in ran.collect()) == sorted(r.doc_id for r in docs.collect())
    assert 0.5 * len(start) < docs.count() < len(start)


def plain_first_copies(docs):
    """The smallest id of each group that similarities of 0.8 or more over five words link, each pair compared."""
    sets = {}
    for i, t in docs.items():
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t).encode().split()
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    ids, root = sorted(docs), {i: i for i in docs}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return sorted({find(i) for i in ids})


def clashing(docs):
    """Documents with extra columns of names that stages make, and of types that cannot be ordered."""
    from pyspark.sql import functions as F

    names = ("ids", "n_tokens", "_toxic", "_hit", "_masked", "_key", "_id", "_row", "print", "root", "node", "block")
    return docs.withColumns({**{n: F.lit(1) for n in names}, "tags": F.create_map(F.lit("a"), F.lit(1)), "lang": F.lit("en"), "n_chars": F.length("text").cast("long")})


def test_every_stage_of_awkward_rows(spark, sf):
    import corpus_pipeline

    for make in (awkward, empty):
        docs = clashing(make(spark)).checkpoint()
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert len(set(out.columns)) == len(out.columns)
            rows = out.collect()
            if name != "bpe":
                assert out.columns == docs.columns and len(rows) <= docs.count()
                docs = spark.createDataFrame(rows, out.schema)
            else:
                assert len(rows) == docs.count()
        assert {r.doc_id for r in rows} == ({1, 4, 5, 8, None} if make is awkward else set())


def test_pipeline_of_awkward_tables(spark, sf, tmp_path):
    import shutil

    import corpus_pipeline

    for name, make in (("a", awkward), ("e", empty)):
        folder = tmp_path / name
        clashing(make(spark)).drop("tags").write.parquet(str(folder / "documents.parquet"))
        for t in ("labels", "benchmark"):
            shutil.copy(f"{sf}/{t}.parquet", folder / f"{t}.parquet")
        assert corpus_pipeline.run(spark, str(folder)).count() == (5 if name == "a" else 0)


def test_pipeline_matches_a_plain_version(spark, sf, library):
    import pyarrow.parquet as pq

    import corpus_pipeline

    docs = {i: t or "" for i, t in zip(*documents(sf).values(), strict=True)}
    model = toxicity.train(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    scorer = toxicity.Scorer(model)
    docs = {i: t for i, t in docs.items() if model.score(scorer.counts(t))[0] < toxicity.THRESHOLD}
    docs = {i: docs[i] for i in plain_first_copies(docs)}
    low = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in s or ""))
    items = set()
    for text in pq.read_table(f"{sf}/benchmark.parquet").to_pydict()["text"]:
        w = low(text)
        items |= {tuple(w[k : k + 10]) for k in range(max(1, len(w) - 9))} if w else set()
    sizes = {len(x) for x in items}
    docs = {i: t for i, t in docs.items() if not any(tuple(w[k : k + n]) in items for w in [low(t)] for n in sizes for k in range(len(w) - n + 1))}
    tagger = pii.tagger()
    expected = {i: library.encode_ordinary(pii.masked(t, pii.found([t], tagger)[0][1])) for i, t in docs.items()}
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, sf).collect()} == expected and 100 < len(expected) < 200
