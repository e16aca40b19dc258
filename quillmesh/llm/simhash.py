"""SimHash near-duplicates with pigeonring filtering.

Fingerprints of 64 bits lie in a ring of five segments. If two differ in at most four bits, some segment starts a chain
whose first l segments together differ in at most floor(4 l / 5) bits, for every l: none in the first, one in the first
two, two in the first three, three in the first four. So either the first two segments are equal, or one half of the
second and one half of the third are (a bit may differ in each). These are five keys of about 26 bits for each start;
fingerprints meet under equal keys alone, must pass the whole chain, and only then is the full distance taken.

Fingerprints count once however many documents have them. Under a key, what is found is handed on as a tree (each
fingerprint with the smallest of its component), never as all pairs. A task compares at most `GROUP` fingerprints of a key
by itself; longer groups go to `crowds`.

Cases: a null or empty text has fingerprint zero and links like any other; texts of fewer words than a shingle are one
shingle; repeated rows and ids keep their rows; a null doc_id never names a component; an empty table gives an empty result;
columns other than doc_id and text may have any name and type, and `one_of_each` returns them as they were.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillmesh.llm import crowds
from quillmesh.llm.common import checkpointed, id_text, map_texts, unused
from quillmesh.operators.graph import components, forest, with_least
from quillmesh.llm.fingerprint import fingerprint

DISTANCE = 4
#: First bit and width of each segment of the ring.
SEGMENTS = ((0, 13), (13, 13), (26, 13), (39, 13), (52, 12))
#: Most fingerprints of a key that a task compares by itself.
GROUP = 1024


def _bits(x: np.ndarray, start: int, width: int) -> np.ndarray:
    return (x >> np.uint64(start)) & np.uint64((1 << width) - 1)


def ring_keys(prints: np.ndarray) -> np.ndarray:
    """Keys of each fingerprint, one column for each start and way; the column's number is in the top bits."""
    out = []
    for i in range(len(SEGMENTS)):
        (a, wa), (b, wb), (c, wc) = (SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(3))
        first = _bits(prints, a, wa)
        ways = [(first << np.uint64(wb)) | _bits(prints, b, wb)]
        for hb in ((b, wb // 2), (b + wb // 2, wb - wb // 2)):
            for hc in ((c, wc // 2), (c + wc // 2, wc - wc // 2)):
                ways.append((((first << np.uint64(hb[1])) | _bits(prints, *hb)) << np.uint64(hc[1])) | _bits(prints, *hc))
        out += [w | np.uint64((5 * i + k) << 48) for k, w in enumerate(ways)]
    return np.stack(out, 1)


def linked(a: np.ndarray, b: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Of pairs that met under a key of a start: those that pass the chain, and then the full check."""
    diff = a ^ b
    by_segment = np.stack([np.bitwise_count(_bits(diff, s, w)) for s, w in SEGMENTS], 1).astype(np.int64)
    chain = np.take_along_axis(by_segment, (start[:, None] + np.arange(4)) % len(SEGMENTS), 1).cumsum(1)
    passed = (chain <= DISTANCE * np.arange(1, 5) // len(SEGMENTS)).all(1)
    passed[passed] = np.bitwise_count(diff[passed]) <= DISTANCE
    return passed


def tree(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same fingerprints: each with the smallest of its component."""
    nodes, root = forest(a, b)
    other = root != nodes
    return nodes[other], root[other]


def pairs_within(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links among the fingerprints of each key; keys are sorted."""
    left, right = [], []
    at, step = np.arange(len(keys)), 1
    while True:
        at = at[at + step < len(keys)]
        at = at[keys[at] == keys[at + step]]
        if not len(at):
            break
        ok = at[linked(prints[at], prints[at + step], (keys[at] >> np.uint64(48)).astype(np.int64) // 5)]
        left.append(prints[ok])
        right.append(prints[ok + step])
        step += 1
    if not left:
        return np.array([], np.uint64), np.array([], np.uint64)
    return tree(np.concatenate(left), np.concatenate(right))


_FOUND, _FOUND_ARROW = "a long, b long, key long", pa.schema([(n, pa.int64()) for n in ("a", "b", "key")])


def _found(a: np.ndarray, b: np.ndarray | None, key: np.ndarray | None) -> pa.RecordBatch:
    columns = [pa.array(a.view(np.int64)), pa.nulls(len(a), pa.int64()) if b is None else pa.array(b.view(np.int64)), pa.nulls(len(a), pa.int64()) if key is None else pa.array(key.view(np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=_FOUND_ARROW)


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (key, print) sorted by key: links (a, b) of short groups, rows (a, key) of long ones."""
    keys, prints, long_key = np.array([], np.uint64), np.array([], np.uint64), None
    for batch in batches:
        keys = np.concatenate([keys, np.asarray(batch.column(0)).view(np.uint64)])
        prints = np.concatenate([prints, np.asarray(batch.column(1)).view(np.uint64)])
        if len(keys):
            cut = int(np.searchsorted(keys.view(np.int64), keys.view(np.int64)[-1]))
            yield from _groups(keys[:cut], prints[:cut], long_key)
            if cut:
                long_key = None
            keys, prints = keys[cut:], prints[cut:]
            if len(keys) > GROUP:  # the last key's group goes on; what is there leaves now
                long_key = keys[0]
                yield _found(prints, None, keys)
                keys, prints = keys[:0], prints[:0]
    yield from _groups(keys, prints, long_key)


def _groups(keys: np.ndarray, prints: np.ndarray, long_key) -> Iterator[pa.RecordBatch]:
    if not len(keys):
        return
    _, at, size = np.unique(keys, return_inverse=True, return_counts=True)
    is_long = (size[at] > GROUP) | (keys == long_key if long_key is not None else False)
    if is_long.any():
        yield _found(prints[is_long], None, keys[is_long])
    several = ~is_long & (size[at] > 1)
    a, b = pairs_within(keys[several], prints[several])
    if len(a):
        yield _found(a, b, None)


def _across(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Links between the fingerprints of two tables of one key."""
    if not left.num_rows or not right.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    start = np.array([(left["grp"][0].as_py() >> 48) // 5])
    own, other = np.asarray(left["node"]).view(np.uint64), np.asarray(right["node"]).view(np.uint64)
    a, b = [], []
    for x in own:
        ok = linked(np.full(len(other), x), other, np.repeat(start, len(other)))
        a.append(np.full(int(ok.sum()), x))
        b.append(other[ok])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = tree(a[a != b], b[a != b])
    return a.view(np.int64), b.view(np.int64)


def _inside(table: pa.Table, _: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    return _across(table, table)


def links(prints: DataFrame) -> DataFrame:
    """(a, b) that join the fingerprints (column print, each once) of every component at the set distance."""
    key_arrow = pa.schema([("key", pa.int64()), ("print", pa.int64())])

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).view(np.uint64)
            keys = ring_keys(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1).view(np.int64)), pa.array(own.repeat(keys.shape[1]).view(np.int64))], schema=key_arrow)

    met = prints.select("print").mapInArrow(keyed, "key long, print long").repartition("key").sortWithinPartitions("key").mapInArrow(_meet, _FOUND)
    met = checkpointed(met)
    out, rest = met.where("key is null").select("a", "b"), met.where("key is not null")
    if rest.isEmpty():
        return out
    return out.unionByName(crowds.links(rest.select(F.col("key").alias("grp"), F.col("a").alias("node"), F.lit(1 / GROUP).alias("load")), _inside, _across))


def fingerprints(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, print (64 bits as a signed integer), text_key (a hash of the text)."""

    def make():
        return lambda keys, texts: [[k["doc_id"] for k in keys], np.array([fingerprint(t, shingle) for t in texts], np.uint64).view(np.int64), [k["text_key"] for k in keys]]

    own = id_text(docs)
    return map_texts(own.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("of"), "text"), make, "doc_id long, print long, text_key long")


def grouped(docs: DataFrame, shingle: int = 4) -> tuple[DataFrame, DataFrame]:
    """Fingerprints of the documents; and (print, least, root) for each fingerprint: its smallest doc_id, and its component."""
    own = checkpointed(fingerprints(docs, shingle))
    nodes = checkpointed(own.groupBy("print").agg(F.min("doc_id").alias("least")))
    roots = components(links(nodes))
    return own, nodes.join(roots, nodes["print"] == roots["node"], "left").select("print", "least", F.coalesce("root", "print").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """doc_id, print, component_id: the smallest doc_id among the documents that links reach, itself included."""
    own, nodes = grouped(docs, shingle)
    named = with_least(nodes.select(F.col("print").alias("of"), "root", F.struct(F.col("least").isNull().alias("none"), "least").alias("least")), "root", "least", "first")
    return own.join(named.select("of", F.col("first.least").alias("component_id")), own["print"] == F.col("of"), "left").select("doc_id", "print", "component_id")


def one_of_each(docs: DataFrame, shingle: int = 4) -> DataFrame:
    """The documents without those whose component has one of a smaller doc_id (a null one is the largest), or, ids being equal, of a smaller hash of the text."""
    own, nodes = grouped(docs, shingle)
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    return firsts(docs, own.groupBy("print").agg(F.min(rank).alias("first")).join(nodes, "print").groupBy("root").agg(F.min("first").alias("first")))


def firsts(docs: DataFrame, first: DataFrame) -> DataFrame:
    """The documents that `first` (doc_id, text_key) names, each once: whole rows are dealt out once, by id and text."""
    of_id, key, row = (unused(docs, n) for n in ("_id", "_key", "_row"))
    kept = first.select(F.xxhash64("first.doc_id").alias(of_id), F.col("first.text_key").alias(key))
    keyed = docs.withColumns({of_id: F.xxhash64(F.col("doc_id").cast("long")), key: F.xxhash64(F.coalesce("text", F.lit("")))}).join(kept, [of_id, key], "left_semi")
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    order = F.to_json(F.struct(*others)) if others else F.lit(0)
    return keyed.withColumn(row, F.row_number().over(Window.partitionBy(of_id, key).orderBy(order))).where(F.col(row) == 1).select(*docs.columns)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")
