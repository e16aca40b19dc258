import json
import math
import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillmesh.functions.stem import stem
from quillmesh.operators import chunking, fulltext, graph, greedy, learning, merge, order, parallel, retrieval, spatial
from quillmesh.sinks import render
from quillmesh.sinks.versions import VersionedTable
from quillmesh.sources import readers
from quillmesh.streaming import evidence

POINTS = "tag_id long, label string, x double, y double, z double, confidence double, image int, scan int"


def points(n, seed=1, spread=3.0):
    r = random.Random(seed)
    return [(i, r.choice("AB"), *(round(r.uniform(0, spread), 3) for _ in range(3)), round(r.random(), 3), i % 7, i % 3) for i in range(n)]


def brute_clusters(rows, radius):
    parent = {r[0]: r[0] for r in rows}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for p in rows:
        for q in rows:
            if p[0] < q[0] and p[1] == q[1] and p[2] is not None and q[2] is not None and math.dist(p[2:5], q[2:5]) < radius:
                a, b = sorted((find(p[0]), find(q[0])))
                parent[b] = a
    return {k: find(k) for k in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_clusters_match_union_find_in_any_order(spark, seed):
    rows = points(120, seed)
    expected = brute_clusters(rows, 0.5)
    for order in (rows, rows[::-1]):
        got = {r.tag_id: r.cluster for r in spatial.clusters(spark.createDataFrame(order, POINTS), 0.5, ["label"]).collect()}
        assert got == expected


def test_cluster_edges(spark):
    at = lambda i, x: (i, "A", x, 0.0, 0.0, 0.5, 1, 1)
    chain = [at(0, 0.0), at(1, 1.0), at(2, 2.0), at(3, 3.5), (4, "A", None, None, None, 0.5, 1, 1)]
    got = {r.tag_id: r.cluster for r in spatial.clusters(spark.createDataFrame(chain, POINTS), 1.5, ["label"]).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 3, 4: 4}  # a chain is one, a distance of exactly the radius and no position are apart
    assert spatial.clusters(spark.createDataFrame([], POINTS), 1.5, ["label"]).count() == 0


def test_golden_weighted_centroid(spark):
    rows = [(0, "A", 0.0, 0.0, 0.0, 0.2, 1, 1), (1, "A", 1.0, 0.0, 0.0, 0.6, 2, 1)]
    (tag,) = spatial.physical_tags(spatial.clusters(spark.createDataFrame(rows, POINTS), 1.5, ["label"]), ["label"]).collect()
    assert math.isclose(tag.x, 0.75) and tag.confidence == 0.6 and tag.observations == 2 and tag.images == [1, 2] and tag.scans == [1]


def test_nearest_by_cells_equals_broadcast(spark, monkeypatch):
    rows, targets = spark.createDataFrame(points(80, 3, 9.0), POINTS), spark.createDataFrame(points(50, 4, 3.0), POINTS)
    for by in ([], ["label"]):
        small = {r.tag_id: (r.near, r.dist) for r in spatial.nearest(rows, targets, "tag_id", "tag_id", by).collect()}
        monkeypatch.setattr(spatial, "SMALL_ROWS", 3)
        large = {r.tag_id: (r.near, r.dist) for r in spatial.nearest(rows, targets, "tag_id", "tag_id", by).collect()}
        monkeypatch.undo()
        assert small == large and len(small) == 80


def test_nearest_ties_and_gaps(spark):
    rows = spark.createDataFrame([(1, 0.0, 0.0, 0.0), (2, None, None, None)], "id long, x double, y double, z double")
    targets = spark.createDataFrame([(5, 1.0, 0.0, 0.0), (4, -1.0, 0.0, 0.0), (3, None, 0.0, 0.0)], "id long, x double, y double, z double")
    assert {r.id: r.near for r in spatial.nearest(rows, targets, "id").collect()} == {1: 4, 2: None}
    assert {r.id: r.near for r in spatial.nearest(rows, targets.where("id > 9"), "id").collect()} == {1: None, 2: None}


def test_suppression_over_batches(spark):
    r = random.Random(3)
    rows = [(i // 9, i % 2, i, float(x := r.randint(0, 30)), float(y := r.randint(0, 30)), float(x + 20), float(y + 20), round(r.random(), 2)) for i in range(400)]
    df = spark.createDataFrame(rows, "image int, class int, n int, x0 double, y0 double, x1 double, y1 double, score double")
    expected = set()
    for key in {(a[0], a[1]) for a in rows}:
        kept = []
        for b in sorted((a for a in rows if (a[0], a[1]) == key), key=lambda a: (-a[7], a[2])):
            if all(greedy._iou(k[3:7], b[3:7]) <= 0.5 for k in kept):
                kept.append(b)
        expected |= {b[2] for b in kept}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert {x.n for x in greedy.non_maximum_suppression(df, ["image", "class"]).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_greedy_assignment(spark):
    rows = [(1, 1, 7, 0.9, 0.5), (1, 1, 8, 0.9, 0.4), (1, 2, 7, 0.8, 0.9), (1, 2, 8, 0.8, 0.35), (1, 3, 7, 0.7, 0.9), (2, 1, 7, 0.1, 0.3)]
    df = spark.createDataFrame(rows, "image int, det int, target int, conf double, iou double")
    got = {(r.image, r.det, r.target) for r in greedy.assign_greedily(df, "image", "det", "target", "conf", "iou").collect()}
    assert got == {(1, 1, 7), (1, 2, 8), (2, 1, 7)}  # the third detection finds both taken


@pytest.mark.parametrize("pivot_rows", [8, 4096])
@pytest.mark.parametrize("others", [False, True])
def test_knn_equals_all_pairs(spark, monkeypatch, pivot_rows, others):
    r = np.random.default_rng(1)
    near = (r.normal(size=(6, 8))[r.integers(0, 6, 300)] + r.normal(size=(300, 8)) * 0.05).round(3).tolist()
    rows = [(i, v) for i, v in enumerate(near)] + [(400 + i, near[7]) for i in range(40)]  # a hot group of copies
    rows += [(500, None), (501, [0.0] * 8), (502, [0.0] * 8), (503, [float("nan")] * 8), (504, [float("inf")] + [0.0] * 7)]
    for name, v in (("PIVOT_ROWS", pivot_rows), ("BALL_ROWS", 16), ("BLOCK", 7), ("BATCH", 16)):
        monkeypatch.setattr(retrieval, name, v)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = df.where("vec_id % 5 = 0 or vec_id > 490")
    got = {}
    for x in retrieval.knn(df, asked, 6, others_only=others).collect():
        got.setdefault(x.query, {})[x["rank"]] = (x.vec_id, round(x.score, 9))
    own = [(i, v) for i, v in rows if v is not None and np.isfinite(v).all()]
    ids, e = np.array([i for i, _ in own]), retrieval.unit(np.array([v for _, v in own], np.float32).astype(float))
    for q in [i for i, _ in own if i % 5 == 0 or i > 490]:
        s = e @ e[ids == q][0]
        order = [k for k in np.lexsort((ids, -np.round(s, 12))) if not (others and ids[k] == q)][:6]
        assert [got[q][k + 1] for k in range(6)] == [(ids[k], round(s[k], 9)) for k in order]
    assert set(got) == {i for i, _ in own if i % 5 == 0 or i > 490}


def test_knn_reads_few_balls_where_rows_lie_apart(tmp_path):
    r = np.random.default_rng(3)
    pivots = retrieval.unit(r.normal(size=(40, 16)))
    opened = []
    reach = np.full(41, 0.05)
    reach[-1] = -1
    retrieval_listed, retrieval.listed = retrieval.listed, lambda path, _: opened.append(path) or []
    try:
        retrieval._searched(np.arange(1), pivots[:1], pivots, reach, "x", 1, False)
        all_balls = len(opened)
        opened.clear()
        best = retrieval.Best(1, 1)
        best.add(np.array([0]), np.array([[0.9999]]), np.array([5]))
        held, retrieval.Best = retrieval.Best, lambda n, k: best
        try:
            retrieval._searched(np.arange(1), pivots[:1], pivots, reach, "x", 1, False)
        finally:
            retrieval.Best = held
    finally:
        retrieval.listed = retrieval_listed
    assert all_balls == 40 and len(opened) == 1


def test_search_edges(spark):
    chunks = spark.createDataFrame([(1, "Relay settings", "trip value"), (2, None, "the relay trip"), (3, "x", None)], "id long, section string, text string")
    asked = spark.createDataFrame([(1, "relay trip"), (2, "of the"), (3, "nothing here")], "q long, text string")
    got = [(r.question, r.place, r.chunk) for r in fulltext.search(chunks, asked, "id", "q", 3).orderBy("question", "place").collect()]
    assert {g[2] for g in got} == {1, 2} and {g[0] for g in got} == {1}


def test_chunk_limits(spark):
    df = spark.createDataFrame([(1, "a" * 50 + "\n" + "b" * 49), (2, "a" * 50 + "\n" + "b" * 50), (3, "short"), (4, None)], "doc_id long, text string")
    got = [(r.doc_id, r.chunk, len(r.text)) for r in chunking.chunks(df, limit=100).orderBy("doc_id", "chunk").collect()]
    assert got == [(1, 0, 100), (2, 0, 50), (2, 1, 50)]


def test_line_rules(spark):
    assert chunking.join_lines(["volt-", "age is", "- one", "2. two", "three"]) == "voltage is\n- one\n2. two three"
    df = spark.createDataFrame([("h\n--\naaa\nbbb\nccc",), ("h\n--",), ("short",), (None,)], "text string")
    assert [r[0] for r in df.select(chunking.table_parts(F.col("text"), 12)).collect()] == [["h\n--\naaa\nbbb", "h\n--\nccc"], ["h\n--"], ["short"], [""]]
    lines = spark.createDataFrame([(1, k, s, x) for k, (s, x) in enumerate(((18, "Title"), (10, "Body."), (14, "Part"), (14, "ends."), (10, "no"), (12, "x" * 95)))], "doc_id long, ord int, size int, line string")
    got = chunking.sized_headings(lines, spark.createDataFrame([(1, 10)], "doc_id long, body int")).orderBy("ord").collect()
    assert [r.level for r in got] == [1, None, 2, None, None, None]


def test_headings_of_a_table_of_contents(spark):
    lines = spark.createDataFrame([(1, 1, k, x) for k, x in enumerate(("Relay", "settings of  the line", "trip", "A longer heading here and more", "Trip"))], "doc_id long, page int, ord int, line string")
    entries = [(1, 1, 0, 2, "2.1 Relay settings of the line"), (1, 1, 1, 6, "3 A longer heading here"), (1, 1, 2, 1, "Trip"), (1, 1, 3, 1, "Absent"), (1, 2, 0, 1, "Alone")]
    got = chunking.listed_headings(lines, spark.createDataFrame(entries, "doc_id long, page int, at int, level int, title string"))
    assert sorted(tuple(r)[1:] for r in got.collect()) == [(1, 0, 2, "2.1 Relay settings of the line", True), (1, 2, 1, "Trip", True), (1, 3, 4, "3 A longer heading here", True), (1, 5, 1, "Absent", False), (2, 0, 1, "Alone", False)]


def test_headings_of_many_pages_are_few_objects_at_a_time():
    pages = 6000
    texts = pa.array([[f"{p} line {k} " + "x" * 240 for k in range(6)] for p in range(pages)])
    wants = pa.array([[f"{p} line 3 xxx", "Absent"] for p in range(pages)])
    tracemalloc.start()
    got = chunking.placed(texts, wants, 10)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.to_pylist() == [[{"entry": 0, "line": 3}, {"entry": 1, "line": -1}]] * pages and chunking.placed(texts[:0], wants[:0], 10).to_pylist() == []
    assert peak < 4 << 20, peak  # the texts alone are 9 MB


def test_section_chunk_kinds(spark):
    def unit(section, ord_, kind, text, page=1, top="Part"):
        return (1, section, top, top, ord_, kind, text, page)

    rows = [unit(1, 0, "table", "t" * 50), unit(1, 1, "text", "w" * 50, 2), unit(2, 2, "text", "w" * 50), unit(2, 3, "table", "t" * 50), unit(3, 4, "text", "w" * 50), unit(4, 5, "text", "short"), unit(5, 6, "text", "w" * 90, top="Table of  Contents"), unit(6, 7, "table", "h\n-\n" + "\n".join("r" * 30 for _ in range(9)), 3)]
    df = spark.createDataFrame(rows, "doc_id long, section int, path string, top string, ord int, kind string, text string, page int")
    got = {(r.section, r.chunk): r for r in chunking.section_chunks(df, limit=120).collect()}
    assert {k: r.kind for k, r in got.items() if k[0] < 6} == {(1, 0): "table", (2, 0): "mixed", (3, 0): "text"} and (got[1, 0].page_start, got[1, 0].page_end) == (1, 2)
    parts = [got[k].text for k in sorted(got) if k[0] == 6]
    assert len(parts) > 2 and all(p.startswith("h\n-\n") and len(p) <= 120 for p in parts)


def test_stemmer():
    pairs = "caresses:caress ponies:poni agreed:agre motoring:motor conflated:conflat hopping:hop filing:file happy:happi relational:relat conditional:condit radicalli:radic sensitiviti:sensit triplicate:triplic electrical:electr adjustable:adjust replacement:replac adoption:adopt controll:control generalizations:gener relays:relai sky:sky is:is"
    assert all(stem(a) == b for a, b in (p.split(":") for p in pairs.split()))


def test_search_by_stems_counts_words_as_they_are(spark):
    chunks = spark.createDataFrame([(1, 10, "", "the relays tripped and the relay settings"), (2, 20, "", "one relay only"), (3, 20, "", "setting trips"), (4, 30, "", "other words")], "id long, document long, section string, text string")
    asked = spark.createDataFrame([(1, "relays"), (2, "relay trip"), (3, "settings relay")], "q long, text string")
    got = {(r.question, r.chunk) for r in fulltext.search(chunks, asked, "id", "q", 3, stemmed=True).collect()}
    # stems bring a chunk in, but it must hold the words as they are asked for
    assert got == {(1, 1), (3, 1)}
    plain = {(r.question, r.chunk) for r in fulltext.search(chunks, asked, "id", "q", 3).collect()}
    assert plain == {(1, 1), (3, 1)} and (2, 3) not in got
    allowed = spark.createDataFrame([(1, 20), (3, 10)], "question long, document long")
    assert {(r.question, r.chunk) for r in fulltext.search(chunks, asked, "id", "q", 3, stemmed=True, allowed=allowed).collect()} == {(3, 1)}


def test_upsert_takes_the_latest(spark):
    base = spark.createDataFrame([(1, "a"), (2, "b")], "id long, value string")
    news = spark.createDataFrame([(2, "old", 1), (2, None, 2), (3, "new", 1)], "id long, value string, seq int")
    assert {tuple(r) for r in merge.upsert(base, news, "id", "seq").collect()} == {(1, "a", False), (2, None, True), (3, "new", True)}
    again = merge.ingest_states(base.withColumnRenamed("value", "text"), base.select("id", F.sha2("value", 256).alias("sha256")), "id", F.sha2("text", 256))
    assert {r.state for r in again.collect()} == {"unchanged"}


def test_scan_metadata_defaults(spark):
    pose = "struct<rotation:struct<w:double,x:double,y:double,z:double>,translation:struct<x:double,y:double,z:double>>"
    scans = spark.createDataFrame([(0, None, "a", None), (1, "g", "b", (None, (1.0, 2.0, 3.0)))], f"position int, guid string, name string, pose {pose}")
    a, b = readers.scan_rows(scans).orderBy("guid").collect()[::-1]
    assert a.guid == "scan_0" and a.rotation.w == 1 and a.translation.x == 0 and b.translation.z == 3 and b.rotation.w == 1
    x, y = readers.image_rows(scans).orderBy("guid").collect()[::-1]
    assert x.guid == "img_0" and x.x is None and y.x == 1
    kinds = "struct<jpeg:string,png:string>"
    pictures = spark.createDataFrame([((None, "s"), ("p", None), None), (None, ("p", None), ("c", None)), (None, None, None)], f"spherical {kinds}, pinhole {kinds}, cylindrical {kinds}")
    assert [r[0] for r in pictures.select(readers.representation()).collect()] == ["s", "p", None]


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', [1, 2]), (2, None, [])], "id int, name string, images array<int>")
    render.write_csv(df, str(tmp_path / "c"))
    back = readers.read_csv(spark, str(tmp_path / "c"), "id int, name string, images string")
    assert {(r.id, r.images) for r in back.collect()} == {(1, "1 2"), (2, None)}
    render.write_json(df, str(tmp_path / "j"))
    assert {r.id for r in spark.read.json(str(tmp_path / "j")).collect()} == {1, 2}
    (tmp_path / "list.json").write_text(json.dumps([{"file": "img_000.jpg", "width": 3}]))
    assert readers.read_json_records(spark, str(tmp_path / "list.json"), "file string, width int").first().width == 3
    assert [r.line for r in render.csv(df, ["id", "name", "images"]).orderBy("line").collect()] == ['1,"a ""b"", c",1 2', "2,,"]


def test_stream_equals_batches(spark, tmp_path):
    cabinets = spark.createDataFrame([(1, 0.0, 0.0, 0.0, None, ["m"]), (2, 5.0, 0.0, 0.0, 0.9, [])], "id long, x double, y double, z double, confidence double, models array<string>")
    rows = [(1, "panel", 0.5, 0.1, 0.0, 0.0), (2, "panel", 0.7, 0.0, 0.2, 0.0), (3, "panel", 0.6, 5.0, 0.0, 0.3), (4, "relay", 0.9, 0.0, 0.0, 0.0), (5, "panel", 0.9, 50.0, 0.0, 0.0)]
    schema = "id long, class string, conf double, x double, y double, z double"
    for k, part in enumerate((rows[:2], rows[2:])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    state = VersionedTable(spark, str(tmp_path / "state"), evidence.STATE, "id", 8)
    first = state.upsert(cabinets.withColumn("order", F.lit(0)), "order")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    evidence.follow(stream, state, str(tmp_path / "offsets"), "panel", "M").awaitTermination(120)
    key = lambda df: {(r.id, r.confidence, tuple(r.models)) for r in df.collect()}
    at_once = evidence.fold(cabinets, spark.createDataFrame(rows, schema), "panel", "M")
    assert key(state.read()) == key(at_once) == {(1, 0.7, ("m", "M")), (2, 0.9, ("M",))}
    # the first batch has evidence for one cabinet, and leaves the bucket of the other as it was
    second = state.manifest(2)
    assert state.versions() == [1, 2, 3] and sum(second.folders[b] != f for b, f in first.folders.items()) == 1
    evidence.follow(stream, state, str(tmp_path / "other_offsets"), "panel", "M").awaitTermination(120)  # the same batches again
    assert state.versions() == [1, 2, 3]


@pytest.mark.parametrize("alone", [1 << 20, 3])
def test_components_in_a_task_and_in_rounds(spark, monkeypatch, alone):
    monkeypatch.setattr(graph, "TASK_LINKS", alone)
    r = random.Random(5)
    links = [(i, i + 1) for i in range(150)] + [(300, k) for k in range(301, 420)] + [(500, 501), (9, 9)] + [(r.randint(1000, 1100), r.randint(1000, 1100)) for _ in range(60)]
    root = {n: n for pair in links for n in pair}
    for _ in root:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    got = {x.node: x.root for x in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: x for n, x in root.items() if any(n in p and p[0] != p[1] for p in links)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_places_in_groups(spark):
    df = spark.createDataFrame([(i % 3, (i * 7) % 50) for i in range(50)], "g long, v long").repartition(7)
    got = {(x.g, x.v): (x.place, x["size"]) for x in order.placed_in_groups(df, ["g"], ["v"]).collect()}
    for g in range(3):
        values = sorted(v for k, v in got if k == g)
        assert [got[g, v] for v in values] == [(n, len(values)) for n in range(1, len(values) + 1)]
    assert order.placed(df.where("false"), ["v"]).count() == 0


def test_few_rows_go_to_every_task(spark):
    df = spark.range(20)
    assert "ResolvedHint" in str(parallel.few(df)._jdf.queryExecution().analyzed()) and "ResolvedHint" not in str(parallel.few(df, 10)._jdf.queryExecution().analyzed())


def test_classifier_of_embeddings(spark):
    r = np.random.default_rng(2)
    centres = r.normal(size=(3, 8)) * 2
    rows = [(i, int(i % 3), (centres[i % 3] + r.normal(size=8) * 0.3).tolist()) for i in range(150)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    model = learning.train(df.where("vec_id % 5 <> 0"), hidden=8)
    held = learning.predicted(df.where("vec_id % 5 = 0"), model).collect()
    assert sum(x.predicted == x.label for x in held) >= 28 and all(1 / 3 <= x.confidence <= 1 for x in held)


def test_a_hot_key_is_joined_in_parts(spark):
    rows = [(1, k) for k in range(500)] + [(2, 900), (3, 901), (None, 902)]
    table = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "key long, v string")
    df = spark.createDataFrame(rows, "key long, node long")
    left = {(r.node, r.v) for r in graph.joined_by_parts(df, table, "key", "node", "left").collect()}
    assert left == {(k, "a") for k in range(500)} | {(900, None), (901, "c"), (902, None)}
    assert graph.joined_by_parts(df, table, "key", "node").count() == 501


def test_a_large_input_is_not_asked_for_its_files(spark, monkeypatch, tmp_path):
    spark.range(10).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    monkeypatch.setattr(parallel, "FEW_BYTES", 0)
    monkeypatch.setattr(type(df), "inputFiles", lambda self: 1 / 0)
    assert parallel.spread(df) is df
