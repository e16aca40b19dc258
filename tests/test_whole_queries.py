"""Registered queries work on the whole table, against plain versions."""

import math
import re
from collections import defaultdict

import pytest

from quillmesh.operators import greedy
from quillmesh.plans import inputs, relational, retrieval, services, spatial  # noqa: F401  they register their queries
from quillmesh.plans.registry import QUERIES


def test_suppression_of_all_images(spark, sf):
    groups = defaultdict(list)
    for r in inputs.boxes(spark, sf).collect():
        groups[r.image, r["class"]].append(r)
    expected = []
    for rows in groups.values():
        kept = []
        for r in sorted(rows, key=lambda r: (-r.score, r.n, r.part)):
            b = (r.x0, r.y0, r.x1, r.y1)
            if all(greedy._iou((k.x0, k.y0, k.x1, k.y1), b) <= 0.5 for k in kept):
                kept.append(r)
        expected += [(r.image, r["class"], r.n, r.part) for r in kept]
    got = [(r.image, r["class"], r.n, r.part) for r in QUERIES["k1_non_maximum_suppression"](spark, sf).collect()]
    assert sorted(got) == sorted(expected) and any(i % 10 for i, *_ in got)


def test_common_words_of_long_documents(spark, sf):
    words = lambda s: set(re.findall("[a-z0-9_]+", (s or "").lower()))
    docs = {r.doc_id: words(r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = {r.item_id: words(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    expected = {(i, d, len(a & b)) for i, a in asked.items() for d, b in docs.items() if a & b}
    assert {(r.item_id, r.doc_id, r.common) for r in QUERIES["o4_common_words"](spark, sf).collect()} == expected


@pytest.mark.parametrize("name", ["w4_f43_greedy_chunks", "w5_breadcrumbs", "w6_page_markers", "a11_body_font", "f42_margin_filter"])
def test_every_copy_of_a_text_has_its_rows(spark, tmp_path, name):
    text = "\n".join(f"line {k} has words enough to make a chunk" for k in range(12))
    spark.createDataFrame([(i, text) for i in (1, 2, 3)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = defaultdict(list)
    for r in QUERIES[name](spark, str(tmp_path)).collect():
        rows[r.doc_id].append(tuple(r)[1:])
    assert sorted(rows) == [1, 2, 3] and sorted(rows[1]) == sorted(rows[2]) == sorted(rows[3])


def test_margins_are_whole_lines(spark, tmp_path):
    pages = [[f"th{k}e head that differs {chr(97 + k)}", *(f"line {n}" for n in "abcdefghijklm"), f"Page  {k} of the book"] for k in range(4)]
    text = "\n".join(line for page in pages for line in page)
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert QUERIES["f42_margin_filter"](spark, str(tmp_path)).first().kept == 56  # the four last lines of pages go


def test_text_keys_of_whole_texts(spark, tmp_path):
    text = "Word  12 " * 20 + "END 7"
    spark.createDataFrame([(3, text)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = QUERIES["f26_text_keys"](spark, str(tmp_path)).first()
    assert (got.collapsed, got.margin, got.title) == ("word 12 " * 20 + "end 7", "#.# page " + "word # " * 20 + "end #", text)


def test_every_order_has_its_place(spark, sf):
    orders = spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_totalprice").collect()
    ranked = sorted(orders, key=lambda r: (r.o_orderkey % 3 != 0, r.o_totalprice if r.o_orderkey % 3 else 0, r.o_orderkey))
    assert {r.o_orderkey: r.place for r in QUERIES["t1_t2_nulls_first"](spark, sf).collect()} == {r.o_orderkey: k for k, r in enumerate(ranked, 1)}


def test_an_empty_list_of_documents_filters_nothing(spark, sf):
    keys = sorted(r.p_partkey for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect())
    got = QUERIES["p3_p4_in_lists"](spark, sf).where("asked = 'unfiltered'")
    assert sorted(r.p_partkey for r in got.collect()) == keys


def boxes_of(spark, sf):
    return [r.asDict() for r in inputs.boxes(spark, sf).collect()]


def plain_assignment(rows):
    """Detections by falling confidence take the best expected box that is free, overlaps 0.3 or more and is of like width."""
    out = {}
    by = defaultdict(list)
    for r in rows:
        by[r["image"]].append(r)
    for image, own in by.items():
        used = set()
        for r in sorted(own, key=lambda r: (-r["score"], r["n"] * 10_000_000 + r["part"])):
            best = None
            for k in range(3):
                e = (k * 90 + image % 20, image % 40, k * 90 + image % 20 + 100, image % 40 + 100)
                overlap, ratio = greedy._iou((r["x0"], r["y0"], r["x1"], r["y1"]), e), (r["x1"] - r["x0"]) / 100
                if k not in used and overlap >= 0.3 and 0.6 <= ratio <= 1.6 and (best is None or overlap > best[1]):
                    best = (k, overlap)
            if best:
                used.add(best[0])
                out[image, r["n"], r["part"]] = best
    return out


def test_assignment_of_all_images(spark, sf):
    expected = plain_assignment(boxes_of(spark, sf))
    got = {(r.image, r.n, r.part): (r.target, r.iou) for r in QUERIES["j14_gate_assignment"](spark, sf).collect()}
    assert set(got) == set(expected) and all(got[k][0] == t and abs(got[k][1] - v) < 1e-4 for k, (t, v) in expected.items())


def test_export_records_of_all_images(spark, sf):
    kept, by = [], defaultdict(list)
    for r in boxes_of(spark, sf):
        by[r["image"], r["class"]].append(r)
    for own in by.values():
        done = []
        for r in sorted(own, key=lambda r: (-r["score"], r["n"], r["part"])):
            if all(greedy._iou((k["x0"], k["y0"], k["x1"], k["y1"]), (r["x0"], r["y0"], r["x1"], r["y1"])) <= 0.5 for k in done):
                done.append(r)
        kept += done
    given = plain_assignment([r for r in kept if r["class"] == 0])
    got = {(r.image, r.n, r.part, r["class"]): r for r in QUERIES["k2_export_records"](spark, sf).collect()}
    assert set(got) == {(r["image"], r["n"], r["part"], r["class"]) for r in kept}
    placed = 0
    for r in kept:
        out, mine = got[r["image"], r["n"], r["part"], r["class"]], given.get((r["image"], r["n"], r["part"])) if r["class"] == 0 else None
        assert out.accepted == (mine is not None) and out.exported == (r["class"] == 0) and out.cabinet == (mine[0] if mine else None)
        assert all(abs(a - b) < 0.051 for a, b in zip(out.box, (r["x0"], r["y0"], r["x1"] - r["x0"], r["y1"] - r["y0"]), strict=True)) and abs(out.conf - min(max(r["score"], 0.0), 1.0)) < 1e-4
        if not mine:
            assert out.position is None
            continue
        half, k = math.radians(r["image"] * 37 % 360) / 2, r["image"]
        w, x, y, z = (v * math.sqrt(0.5) for v in (math.cos(half), math.cos(half), math.sin(half), math.sin(half)))
        m = [[1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)], [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)], [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)]]
        a, b = ((r["x0"] + r["x1"]) / 2 - 500) / 500, ((r["y0"] + r["y1"]) / 2 - 500) / 500
        d = [(m[j][0] * a - m[j][1] * b - m[j][2]) / math.sqrt(a * a + b * b + 1) for j in range(3)]
        at = (k % 11, k % 7, 1.2)
        t = (mine[0] * 0.07 + 12.0 - at[0]) / d[0] if abs(d[0]) >= 1e-6 else -1
        if t <= 0:
            assert out.position is None
        else:
            placed += 1
            assert all(abs(v - (at[j] + t * d[j])) < 2e-3 * max(1, abs(v)) for j, v in enumerate(out.position))
    assert placed > 10


def test_label_matches_of_all_parts(spark, sf):
    from difflib import SequenceMatcher

    parts = {r.p_partkey: r for r in spark.read.parquet(f"{sf}/part.parquet").collect()}
    fold = lambda s: "".join(c for c in s.upper() if c.isalnum()).translate(str.maketrans("OILSZB", "011528"))
    names = sorted({r.p_type for r in parts.values()})
    got = {r.p_partkey: r for r in QUERIES["f24_w2_label_match"](spark, sf).collect()}
    assert set(got) == set(parts)
    seen = set()
    for key, r in parts.items():
        read = r.p_type[: key % 6] + f" {r.p_size}" if r.p_size % 3 else r.p_type[:1]
        own = fold(read)
        if len(own) < 2:
            assert (got[key].label, got[key].score) == (None, 0.0)
            continue
        scores = sorted(((1.0 if own == fold(n) else 0.95 if len(fold(n)) >= 3 and fold(n) in own else SequenceMatcher(None, own, fold(n)).ratio()), n) for n in names)[::-1]
        best = max(s for s, _ in scores)
        first = min(n for s, n in scores if s == best)
        second = max((s for s, n in scores if n != first), default=0.0)
        label = first if best >= 0.65 and best - second >= 0.05 else None
        assert got[key].label == label and abs(got[key].score - best) < 1e-4
        seen.add(label)
    assert None in seen


def test_paragraphs_of_all_documents(spark, sf):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    item = re.compile(r"(•|▪|●|-|–|[0-9]+[.)]|[a-z][.)])\s")
    for r in QUERIES["f28_paragraphs"](spark, sf).collect():
        joined = ""
        for line in texts[r.doc_id].split("\n"):
            line = line.strip()
            if not line:
                continue
            if not joined or item.match(line):
                joined += "\n" * bool(joined) + line
            elif re.search(r"[a-zà-ÿ]-$", joined.rpartition("\n")[2]) and line[0].islower():
                joined = joined[:-1] + line
            else:
                joined += " " + line
        assert r.n_chars == len(joined), r.doc_id


def test_stemmed_search_of_all_questions(spark, sf):
    import math as m
    from collections import Counter

    from quillmesh.functions import text as t
    from quillmesh.functions.stem import stem

    low = lambda s: re.findall("[a-z0-9_]+", (s or "").lower())
    docs = {r.doc_id: (low((r.text or "").split("\n")[0]), low(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    asked = {r.item_id: sorted(set(low(r.text)) - set(t.STOP_WORDS)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    tf = {d: Counter() for d in docs}
    for d, (section, body) in docs.items():
        for w in section:
            tf[d][stem(w)] += 4
        for w in body:
            tf[d][stem(w)] += 1
    df = Counter(w for own in tf.values() for w in own)
    dl = {d: len(s) + len(b) for d, (s, b) in docs.items()}
    mean = sum(dl.values()) / len(dl)
    expected = set()
    for q, words in asked.items():
        scores = {}
        for d, own in tf.items():
            parts = [max(m.log((len(docs) - df[s] + 0.5) / (df[s] + 0.5)), 1e-6) * own[s] * 2.2 / (own[s] + 1.2 * (0.25 + 0.75 * dl[d] / mean)) for s in {stem(w) for w in words} if own[s]]
            if parts:
                scores[d] = -sum(parts)
        first = sorted(scores, key=lambda d: (round(scores[d], 9), d))[:30]
        need = max(1, m.ceil(round(0.6 * len(words), 9)))
        kept = [d for d in first if len(set(words) & (set(docs[d][0]) | set(docs[d][1]))) >= need][:3]
        expected |= {(q, place, d) for place, d in enumerate(kept, 1)}
    got = QUERIES["f37_stemmed_search"](spark, sf).collect()
    assert {(r.question, r.place, r.chunk) for r in got} == expected and expected


def test_answers_of_tags(spark, sf):
    rows = QUERIES["api_ask"](spark, sf).collect()
    texts = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.question for r in rows} == {r.item_id for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    for r in rows:
        assert r.found == (r.note is None) and (not r.found or (r.passage == texts[r.document].text[:1200] and r.model == texts[r.document].lang and r.link == f"/documents/{r.document}/file#page=1"))
    assert any(r.note and r.note.endswith("has no documents") for r in rows)


def test_section_chunks_of_all_documents(spark, sf):
    units = defaultdict(list)
    for r in retrieval.units(spark, sf).collect():
        units[r.doc_id, r.section].append(r)
    expected = set()
    for (doc, section), own in units.items():
        own.sort(key=lambda r: r.ord)
        if re.fullmatch("(table of )?contents|list of (figures|tables)", " ".join((own[0].top or "").lower().split())):
            continue
        chunks, now = [], None
        for r in own:
            rows = r.text.split("\n")
            pieces = [r.text]
            if r.kind == "table" and len(r.text) > 2200 and rows[2:]:
                pieces, body = [], []
                for line in [*rows[2:], None]:
                    if line is None or (body and len("\n".join([*rows[:2], *body, line])) > 2200):
                        pieces.append("\n".join([*rows[:2], *body]))
                        body = []
                    body.append(line)
            for piece in pieces:
                if now is None or len(now["text"]) + len(piece) > 2200:
                    now = {"text": piece, "kind": r.kind, "pages": [r.page]}
                    chunks.append(now)
                else:
                    now["text"] += "\n\n" + piece
                    now["pages"].append(r.page)
                    now["kind"] = "mixed" if r.kind == "table" else now["kind"]
        expected |= {(doc, section, k, own[0].path, min(x["pages"]), max(x["pages"]), x["kind"], len(x["text"].strip(" "))) for k, x in enumerate(chunks) if len(x["text"].strip(" ")) >= 40}
    got = {tuple(r) for r in QUERIES["f43_f35_section_chunks"](spark, sf).collect()}
    assert got == expected and {r[6] for r in got} >= {"text"}
