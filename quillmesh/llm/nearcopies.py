"""The near-copy form of the SimHash stage: sets of five-word shingles that agree in 0.8 or more (Jaccard) are linked.

1. Texts of one shingle set are one node, with the SimHash fingerprint of its set. The pigeonring of `simhash` links all
   fingerprints within four bits; nodes whose fingerprints are linked are candidates.
2. Sets above 0.8 differ in up to two dozen of 64 bits, and a pigeonring of so wide a budget has segments of three bits,
   under which nearly all texts meet. So pairs beyond four bits become candidates by bands of minima: a node has 48 keys,
   each made of five minima of its set's hashes. Two sets of similarity s share a key with probability
   1 - (1 - s^5)^48: at 0.8 a pair is missed once in 2 * 10^8.
3. Nodes under one key are joined as a star, never as all pairs; components of stars hold all pairs that can be linked.
   The pigeonring and the first eight keys join most copies, so that the other forty are kept once for each component of
   the first.
4. A component's texts meet, and sets are compared exactly; `crowds` compares components that no task can hold. Components
   of these links are the groups.

Words are those of the fingerprint: split at ASCII white space, ASCII letters in lower case. Cases: a text of fewer words
than a shingle is one shingle; null and empty texts have the empty set and are copies of each other; repeated rows and ids
are as in `simhash.one_of_each`; an empty table gives an empty result; all columns come back, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm import crowds, simhash
from quillmesh.llm.common import checkpointed, id_text, map_texts
from quillmesh.operators.graph import components, joined_by_parts
from quillmesh.llm.fingerprint import _LOWER, majority
from quillmesh.llm.grams import mix
from quillmesh.llm.simhash import firsts, tree

SHINGLE, BANDS, ROWS, FIRST = 5, 48, 5, 8
#: Most nodes, and bytes of text, of a component that a task compares by itself.
GROUP, GROUP_BYTES = 1024, 8 << 20
_RANDOM = np.random.default_rng(20250807)
_TIMES = _RANDOM.integers(1, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _RANDOM.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
#: Hashes whose images are made at a time.
_PART = 512


def shingles(text: str, shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    words = text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    line, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()][:n]
    last = ends[shingle - 1 :].tolist() if len(words) >= shingle else [len(line)]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(line[a:b]) for a, b in zip(starts, last, strict=True)], np.uint64))


def minima(hashes: np.ndarray) -> np.ndarray:
    out = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), _PART):
        np.minimum(out, (_TIMES * hashes[None, i : i + _PART] + _PLUS).min(1), out)
    return out


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """Keys of each set, one column for each band."""
    least = np.stack([minima(h) for h in sets]).reshape(len(sets), BANDS, ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(sets), BANDS))
    for r in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) ^ least[:, :, r])
    return keys.view(np.int64)


def node_of(hashes: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(hashes.tobytes())).view(np.int64))


def signatures(docs: DataFrame) -> DataFrame:
    """doc_id, print (the node: a hash of the shingle set), text_key (a hash of the text), load (the share of a task's capacity), fingerprint, keys."""

    def make():
        def kernel(keys, texts):
            sets = [shingles(t) for t in texts]
            load = [max(1 / GROUP, len(t) / GROUP_BYTES) for t in texts]
            prints = np.array([majority(h) for h in sets], np.uint64).view(np.int64)
            return [[k["doc_id"] for k in keys], [node_of(h) for h in sets], [k["text_key"] for k in keys], load, prints, list(band_keys(sets))]

        return kernel

    own = id_text(docs)
    return map_texts(own.select(F.struct("doc_id", F.xxhash64("text").alias("text_key")).alias("of"), "text"), make, "doc_id long, print long, text_key long, load double, fingerprint long, keys array<long>")


def stars(keyed: DataFrame) -> DataFrame:
    """(a, b): of rows (node, key), each node with the least node of each key that it shares."""
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z").select("key", "a")
    return keyed.join(shared, "key").where("a <> node").select("a", F.col("node").alias("b"))


def alike(nodes: DataFrame) -> DataFrame:
    """(node, key): each node under the least fingerprint that the pigeonring's links reach from its own."""
    roots = components(simhash.links(nodes.select(F.col("fingerprint").alias("print")).distinct())).select(F.col("node").alias("fingerprint"), "root")
    return nodes.join(roots, "fingerprint", "left").select(F.col("print").alias("node"), F.coalesce("root", "fingerprint").alias("key"))


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, root) for the nodes that linked fingerprints or shared keys join to others."""
    own = nodes.select(F.col("print").alias("node"), "keys")
    first = components(stars(alike(nodes)).unionByName(stars(own.select("node", F.explode(F.slice("keys", 1, FIRST)).alias("key")))))
    named = checkpointed(own.select("node").join(first, "node", "left").select("node", F.coalesce("root", "node").alias("root"), F.col("root").isNotNull().alias("linked")))
    rest = own.join(named, "node").select(F.col("root").alias("node"), F.explode(F.slice("keys", FIRST + 1, BANDS)).alias("key")).distinct()
    last = components(stars(rest)).select(F.col("node").alias("root"), F.col("root").alias("last"))
    # one large group may hold a third of all nodes: they meet what its root became in parts
    ended = joined_by_parts(named, last, "root", "node", "left")
    return ended.where("linked or last is not null").select("node", F.coalesce("last", "root").alias("root"))


def similar(sets: list[np.ndarray], hubs: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Links that join every two sets of similarity 0.8 or more, by way of others or at once: places of both ends.

    hubs: only those to each of the first so many sets, at once.
    """
    if len(sets) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([len(h) for h in sets])
    row = np.repeat(np.arange(len(sets)), size)
    codes, at = np.unique(np.concatenate(sets), return_inverse=True)
    begin = np.concatenate([[0], np.cumsum(size)])
    left, right, free, mark = [], [], np.ones(len(sets), bool), np.zeros(len(codes), bool)
    for first in range(len(sets) if hubs is None else hubs):
        reached = [first] if free[first] or hubs is not None else []
        free[first] = False
        while reached and free.any():
            i = reached.pop()
            own = at[begin[i] : begin[i + 1]]
            mark[own] = True
            both = np.bincount(row[mark[at]], minlength=len(sets))
            mark[own] = False
            alike = 5 * both >= 4 * (size + size[i] - both)
            new = np.flatnonzero(alike if hubs is not None else free & alike)
            free[new] = hubs is not None
            left.append(np.full(len(new), i))
            right.append(new)
            reached += new.tolist() if hubs is None else []
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _inside(table: pa.Table, _: pa.Table | None) -> tuple[np.ndarray, np.ndarray]:
    return _tree(table, *similar([shingles(t) for t in table["text"].to_pylist()]))


def _across(left: pa.Table, right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    both = pa.concat_tables([left, right])
    hubs = left.num_rows if "side" in left.column_names else None
    return _tree(both, *similar([shingles(t) for t in both["text"].to_pylist()], hubs))


def _tree(table: pa.Table, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    prints = np.asarray(table["node"])
    a, b = prints[a], prints[b]
    return tree(a[a != b], b[a != b])


def links(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(a, b) that join the nodes (print, fingerprint, keys, rank of one row that has it, load) of each group of near copies."""
    of = nodes.select(F.col("print").alias("node"), F.col("rank.doc_id").alias("of_id"), F.col("rank.text_key").alias("of_key"))
    members = nodes.join(candidates(nodes), nodes["print"] == F.col("node")).select(F.col("root").alias("grp"), "node", "load")
    own = id_text(docs).withColumn("text_key", F.xxhash64("text"))

    def with_text(asked: DataFrame) -> DataFrame:
        texts = own.join(asked.join(of, "node"), F.col("doc_id").eqNullSafe(F.col("of_id")) & (F.col("text_key") == F.col("of_key")))
        texts = texts.select(*asked.columns, "text")
        if "blocks" not in asked.columns:  # groups that a task holds: dealt out by group, they need not move again
            texts = texts.repartition("grp")
        return texts.dropDuplicates(["grp", "node"])  # rows of one id and text count once

    return crowds.links(members, _inside, _across, with_text)


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each group: that of the smallest doc_id (a null one is the largest), or, ids being equal, of the smallest hash of the text."""
    rank = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    nodes = checkpointed(signatures(docs).groupBy("print").agg(F.min(rank).alias("rank"), F.max("load").alias("load"), F.first("fingerprint").alias("fingerprint"), F.first("keys").alias("keys")))
    roots = components(links(docs, nodes))
    grouped = nodes.join(roots, nodes["print"] == roots["node"], "left").select("rank", F.coalesce("root", "print").alias("root"))
    return firsts(docs, grouped.groupBy("root").agg(F.min("rank").alias("first")))
