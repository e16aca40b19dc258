"""Substring dedup with sparse suffix arrays.

A window is 50 words of one document. A word goes if some window over it also starts in a document of a smaller doc_id.

Every window of 50 words has 41 runs of ten words; the one of the least hash (the leftmost of equals) is its minimiser, a
choice by content alone, so equal windows choose the same place. Only suffixes at such places are retained, about one in
twenty.

1. Blocks of documents send each minimiser's hash with the number of documents that have it; buckets tell the blocks which
   are held by more than one document.
2. Those suffixes go to buckets with 50 words to the right and 40 to the left, as far as a window can reach. A bucket sorts
   the suffixes and, with an array of its own, their left contexts read backwards, and compares neighbours. The common
   lengths of neighbours give the classes of suffixes that agree over r words to the right, and over l to the left, for
   every l + r = 50: a window that starts l words before a suffix is extended left by l and right by 50 - l, and equals
   another if and only if both agree. The window is told to go wherever its class has a smaller doc_id.
3. Blocks take out the words that these windows cover.

A bucket must fit into a task, so a minimiser in more than `CROWD` documents (some ten megabytes of suffixes) is split: its
windows are dealt out by the hash of the whole window, each once for a block, and windows of one hash (64 bits) are equal.
That leads to the same windows, so the bound changes where they meet and nothing else.

Cases: a null or empty text has no words; a text below 50 words stays whole; a null doc_id counts as the largest; rows that
repeat a doc_id are not smaller than each other; repeated passages inside one document stay; an empty table gives an empty
result; columns other than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm.grams import Exchange, Words, among, block_rows, bucket_of, in_blocks, layout, least_of_equal, mix, removed, table_of, windows
from quillmesh.llm.phrases import out_schema, row

WINDOW, GRAM = 50, 10
#: Documents with a minimiser from which its windows are dealt out one by one.
CROWD = 20_000
#: Kinds of rows: suffixes, and windows of crowded minimisers.
SUFFIX, SINGLE = 0, 1


def minimisers(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window that lies in one text, its start, the place of its minimiser, and that run's hash."""
    g, _ = windows(words, gram)
    m = window - gram + 1
    if len(g) < m:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    value, place, width = mix(g.copy()), np.arange(len(g)), 1

    def lower(shift: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        right = value[shift : shift + n] < value[:n]
        return np.where(right, value[shift : shift + n], value[:n]), np.where(right, place[shift : shift + n], place[:n])

    while 2 * width <= m:
        value, place = lower(width, len(value) - width)
        width *= 2
    value, place = lower(m - width, len(g) - m + 1)
    starts = np.flatnonzero(words.row[: len(place)] == words.row[window - 1 : window - 1 + len(place)])
    return starts, place[starts], g[place[starts]]


class Ways:
    """The exchanges between blocks and buckets."""

    def __init__(self, blocks: int, buckets: int, window: int, gram: int):
        self.blocks, self.buckets, self.window, self.gram, self.crowd = blocks, buckets, window, gram, CROWD
        self.counted = Exchange(buckets, hash="delta", documents="i4", block="i4")
        self.shared = Exchange(blocks, hash="delta", crowded="u1")
        self.suffixes = Exchange(buckets, hash="delta", doc="i8", most="i8", block="i4", place="i4", reach="raw:u1:2", context=f"raw:>u4:{2 * window - gram}")
        self.told = Exchange(blocks, hash="delta", least="i8", place="i4", left="u1")


def count(table: pa.Table, way: Ways) -> pa.Table:
    ids, _, words = block_rows(table)
    _, place, g = minimisers(words, way.window, way.gram)
    pairs = np.unique(np.stack([g, ids[words.row[place]].view(np.uint64)], 1), axis=0) if len(g) else np.zeros((0, 2), np.uint64)
    h, n = np.unique(pairs[:, 0], return_counts=True)
    block = table["block"][0].as_py()
    return way.counted.table(way.counted.rows(bucket_of(h, way.buckets), block, hash=h, documents=n.astype(np.int32), block=np.full(len(h), block, np.int32)))


def share(table: pa.Table, way: Ways) -> pa.Table:
    """To each block, which of its minimisers several documents have, and whether they are a crowd."""
    own = way.counted.columns(table)
    _, at = np.unique(own["hash"], return_inverse=True)
    total = np.bincount(at, own["documents"].astype(np.float64))[at]
    keep = np.flatnonzero(total > 1)
    keep = keep[np.lexsort((own["hash"][keep], own["block"][keep]))]
    return way.shared.table(way.shared.rows(own["block"][keep].astype(np.int64), table["at"][0].as_py(), hash=own["hash"][keep], crowded=(total[keep] > way.crowd).astype(np.uint8)))


def retain(docs: pa.Table, shared: pa.Table, way: Ways) -> pa.Table:
    """Suffixes at shared minimisers with their contexts; windows at crowded ones."""
    if not docs.num_rows or not shared.num_rows:
        return way.suffixes.table([])
    ids, _, words = block_rows(docs)
    start, place, g = minimisers(words, way.window, way.gram)
    known = way.shared.columns(shared)
    order = np.argsort(known["hash"])
    h, crowded = known["hash"][order], known["crowded"][order] > 0
    block, rows = docs["block"][0].as_py(), []
    # suffixes: a minimiser's windows start in an unbroken run of words
    mine = among(h[~crowded], g)
    if mine.any():
        p, at = np.unique(place[mine], return_index=True)
        last = len(place[mine]) - 1 - np.unique(place[mine][::-1], return_index=True)[1]
        reach = np.stack([p - start[mine][last], p - start[mine][at]], 1).astype(np.uint8)
        own, left = g[mine][at], way.window - way.gram
        order = np.argsort(own, kind="stable")
        p, reach, own = p[order], reach[order], own[order]
        short = (words.hash & np.uint64(0xFFFFFFFF)).astype(">u4")
        context = short[np.clip(p[:, None] + np.arange(-left, way.window)[None, :], 0, len(short) - 1)]
        rows += way.suffixes.rows(bucket_of(own, way.buckets), block, SUFFIX, hash=own, doc=ids[words.row[p]], block=np.full(len(p), block, np.int32), place=p.astype(np.int32), reach=reach, context=context)
    mine = among(h[crowded], g)
    if mine.any():
        w = windows(words, way.window)[0][start[mine]]
        order = np.argsort(w, kind="stable")
        w, doc = w[order], ids[words.row[start[mine]]][order]
        head = np.concatenate([[True], w[1:] != w[:-1]])
        w, doc, most = w[head], doc[head], doc[np.concatenate([head[1:], [True]])]
        rows += way.suffixes.rows(bucket_of(w, way.buckets), block, SINGLE, hash=w, doc=doc, most=most, block=np.full(len(w), block, np.int32))
    return way.suffixes.table(rows)


def neighbours(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows of big-endian words, and how many words each shares with the one before it."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"V{rows.shape[1] * rows.itemsize}").reshape(-1), kind="stable")
    s = rows[order]
    common = np.zeros(len(s), np.int64)
    differ = s[1:] != s[:-1]
    common[1:] = np.where(differ.any(1), differ.argmax(1), rows.shape[1])
    return order, common


def extend(table: pa.Table, way: Ways) -> pa.Table:
    """Of a bucket: to each block the windows that a smaller doc_id has, as places and lengths to the left, or hashes."""
    own, kind, bucket = way.suffixes.columns(table), table["kind"][0].as_py(), table["at"][0].as_py()
    ids, block = own["doc"], own["block"].astype(np.int64)
    if kind == SINGLE:
        least = least_of_equal(own["hash"], ids)
        late = np.flatnonzero(own["most"] > least)
        late = late[np.lexsort((own["hash"][late], block[late]))]
        return way.told.table(way.told.rows(block[late], bucket, SINGLE, hash=own["hash"][late], least=least[late]))
    window, left, place, reach, context = way.window, way.window - way.gram, own["place"], own["reach"], own["context"]
    right_order, right_common = neighbours(context[:, left:])
    left_order, left_common = neighbours(context[:, :left][:, ::-1])
    found_at, found_left = [], []
    for n in range(left + 1):
        has = (reach[:, 0] <= n) & (n <= reach[:, 1])
        if not has.any():
            continue
        of_right, of_left = np.empty(len(ids), np.int64), np.empty(len(ids), np.int64)
        of_right[right_order] = np.cumsum(right_common < window - n)
        of_left[left_order] = np.cumsum(left_common < n)
        i = np.flatnonzero(has)
        key = of_right[i] * (len(ids) + 1) + of_left[i]
        gone = i[ids[i] > least_of_equal(key, ids[i])]
        found_at.append(gone)
        found_left.append(np.full(len(gone), n, np.uint8))
    at, lefts = (np.concatenate([np.zeros(0, np.int64), *found_at]), np.concatenate([np.zeros(0, np.uint8), *found_left]))
    order = np.argsort(block[at], kind="stable")
    at, lefts = at[order], lefts[order]
    return way.told.table(way.told.rows(block[at], bucket, SUFFIX, place=place[at], left=lefts))


def finish(docs: pa.Table, told: pa.Table, way: Ways, schema: pa.Schema, digests: bool) -> pa.Table:
    ids, shown, words = block_rows(docs)
    starts = [np.zeros(0, np.int64)]
    if told.num_rows:
        own = way.told.columns(told)
        if "hash" in own:
            order = np.argsort(own["hash"])
            known, least = own["hash"][order], own["least"][order]
            h, whole = windows(words, way.window)
            at = np.flatnonzero(whole & among(known, h))
            starts.append(at[ids[words.row[at]] > least[np.searchsorted(known, h[at])]])
        if "place" in own:
            starts.append(own["place"].astype(np.int64) - own["left"])
    gone = removed(words, way.window, np.concatenate(starts))
    at = words.first.tolist()
    return table_of([row(i, words.text(a, b), gone[a:b], digests) for i, a, b in zip(shown, at, at[1:], strict=False)], schema)


def without_passages(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words joined by spaces (or their SHA-256), and spans of removed words."""
    blocks, buckets = layout(docs)
    own, way = in_blocks(docs, blocks), Ways(blocks, buckets, window, gram)
    ddl, schema = out_schema(digests)
    counted = way.counted.delivered(own.groupBy("block").applyInArrow(lambda t: count(t, way), way.counted.ddl))
    shared = way.shared.delivered(counted.groupBy("at").applyInArrow(lambda t: share(t, way), way.shared.ddl))
    suffixes = way.suffixes.delivered(own.groupBy("block").cogroup(shared.groupBy("at")).applyInArrow(lambda d, s: retain(d, s, way), way.suffixes.ddl))
    told = way.told.delivered(suffixes.groupBy("at", "kind").applyInArrow(lambda t: extend(t, way), way.told.ddl))
    return own.groupBy("block").cogroup(told.groupBy("at")).applyInArrow(lambda d, t: finish(d, t, way, schema, digests), ddl)
