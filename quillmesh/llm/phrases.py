"""Substring dedup with repeated-phrase automata.

A window is 13 words of one document. A word goes if some window over it also starts in a document of a smaller doc_id.

1. Documents are dealt into blocks. A block sends each of its window hashes once, with the smallest doc_id that has it, to
   the hash's bucket.
2. A bucket confirms windows that several blocks hold. Every holder but the first asks one of the holders before it, whose
   doc_id is smaller, for the words. Holders ask in a tree of `ASKERS` branches, so nobody answers for a window that all
   blocks hold.
3. A block that is asked answers with passages: the words of unbroken runs of asked windows, and the doc_id they stand in.
4. A block compiles the passages of other blocks, and those that repeat inside it, into an Aho-Corasick automaton over
   words, its shard, and streams all its documents through it. Keys are the passages cut into pieces of seven words: a
   window of 13 covers one of them whole. Each occurrence of a piece is followed left and right as far as passage and
   document agree, word by word, and 13 words or more of a passage from a smaller doc_id are taken out.

Hashes only choose what is asked for: a word goes because the automaton found it and its neighbours in the words of
another document. Two windows of one bucket may have one hash by chance (48 bits within a bucket: once in 10^8 repeated
windows at any size of the input); such a window could be missed, never taken out wrongly.

A shard holds only passages that its block asked for, so it is bounded by the block; a document meets every passage it can
contain because the buckets have seen all windows.

Cases: a null or empty text has no words; a text below 13 words has no window and stays whole; a null doc_id counts as the
largest; rows that repeat a doc_id are not smaller than each other; an empty table gives an empty result; columns other than
doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

from itertools import repeat

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm.common import sha256
from quillmesh.llm.grams import Exchange, Words, block_rows, bucket_of, in_blocks, layout, planes, runs, table_of, unplanes, windows

WINDOW = 13
#: Holders of a window that one holder answers.
ASKERS = 16
#: Letters that a word's spelling has to choose from at each place.
FANOUT = 32
#: Bits of a hash within its bucket.
BUCKET_BITS = 48
_PASSAGES = pa.schema([("block", pa.int32()), ("owners", pa.binary()), ("words", pa.binary())])


def first_windows(table: pa.Table, window: int, buckets: int) -> tuple[list, Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's ids and words, and its different windows, sorted by hash: hash, first place, and the doc_id there and at the last place."""
    ids, shown, words = block_rows(table)
    h, whole = windows(words, window)
    at = np.flatnonzero(whole)
    h = h[at] >> np.uint64(max(0, 64 - BUCKET_BITS - buckets.bit_length() + 1))
    order = np.argsort(h, kind="stable")  # documents are in the order of their ids
    h, at = h[order], at[order]
    head = np.concatenate([[True], h[1:] != h[:-1]]) if len(h) else np.zeros(0, bool)
    tail = np.concatenate([head[1:], [True]]) if len(h) else head
    doc = ids[words.row[at]]
    return shown, words, h[head], at[head], doc[head], doc[tail]


def send(table: pa.Table, window: int, buckets: int, out: Exchange) -> pa.Table:
    """A block's windows, each once with the smallest doc_id that has it."""
    _, _, h, _, doc, _ = first_windows(table, window, buckets)
    block = table["block"][0].as_py()
    shift = np.uint64(max(0, 64 - BUCKET_BITS - buckets.bit_length() + 1))
    return out.table(out.rows(bucket_of(h << shift, buckets), block, hash=h, doc=doc, block=np.full(len(h), block, np.int32)))


def confirm(table: pa.Table, sent: Exchange, out: Exchange) -> pa.Table:
    """Of a bucket: for each holder of a window but the first, whom it asks."""
    own = sent.columns(table)
    order = np.lexsort((own["doc"], own["hash"]))
    h, doc, block = own["hash"][order], own["doc"][order], own["block"][order]
    head = np.concatenate([[True], h[1:] != h[:-1]])
    start = np.flatnonzero(head)[np.cumsum(head) - 1]
    n = np.arange(len(h)) - start
    asked = start + np.maximum(n - 1, 0) // ASKERS
    asked = np.where(doc[asked] < doc, asked, start)
    late = np.flatnonzero(doc > doc[start])
    to = block[asked[late]]
    order = np.lexsort((h[late], to))
    late, to = late[order], to[order].astype(np.int64)
    return out.table(out.rows(to, table["at"][0].as_py(), hash=h[late], asker=block[late]))


def answer(docs: pa.Table, asks: pa.Table, window: int, buckets: int, asked: Exchange) -> pa.Table:
    """A block's passages for each block that asked it."""
    if not docs.num_rows or not asks.num_rows:
        return _PASSAGES.empty_table()
    _, words, h, place, doc, _ = first_windows(docs, window, buckets)
    wanted = asked.columns(asks)
    at = np.searchsorted(h, wanted["hash"])
    order = np.lexsort((place[at], wanted["asker"]))
    at, asker = at[order], wanted["asker"][order]
    rows = []
    for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(asker)) + 1):
        owners, text = passages_at(words, place[at[part]], doc[at[part]], window)
        rows.append((int(asker[part[0]]), planes(np.array(owners, np.int64)), b"\n".join(text)))
    return table_of(rows, _PASSAGES)


def passages_at(words: Words, place: np.ndarray, doc: np.ndarray, window: int) -> tuple[list[int], list[bytes]]:
    """The doc_id and the words of each unbroken run of windows; places are sorted."""
    if not len(place):
        return [], []
    cut = np.flatnonzero((np.diff(place) > 1) | (words.row[place[1:]] != words.row[place[:-1]])) + 1
    first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(place)]]) - 1
    a, b = place[first], place[last] + window - 1
    return doc[first].tolist(), [b" ".join(words.data[x:y].tobytes().split()) for x, y in zip(words.start[a].tolist(), words.end[b].tolist(), strict=True)]


class Letters:
    """Words as letters, a fixed number for each: nodes of the automaton have few branches, and a letter tells its place in the word.

    Only words of passages have letters of their own; all others share one spelling.
    """

    def __init__(self, words: set[bytes]):
        self.width = 1
        while FANOUT**self.width <= len(words):
            self.width += 1
        self.of = {w: self.spelt(n) for n, w in enumerate(sorted(words), 1)}
        self.other = self.spelt(0)

    def spelt(self, n: int) -> str:
        return "".join(chr(0x100 + k * FANOUT + n // FANOUT**k % FANOUT) for k in range(self.width))

    def spell(self, words: list[bytes]) -> str:
        return "".join(map(self.of.get, words, repeat(self.other)))


class Shard:
    """The automaton of a block's passages, each with the doc_id it stands in."""

    def __init__(self, owners: list[int], passages: list[list[bytes]], window: int):
        self.letters = Letters({w for p in passages for w in p})
        self.owner, self.spelt = owners, [self.letters.spell(p) for p in passages]
        self.machine = ahocorasick.Automaton()
        self.window, self.piece = window * self.letters.width, (window + 1) // 2 * self.letters.width
        where: dict[str, list[tuple[int, int]]] = {}
        for k, p in enumerate(self.spelt):
            for o in range(0, len(p) - self.piece + 1, self.piece):
                where.setdefault(p[o : o + self.piece], []).append((k, o))
        for key, places in where.items():
            self.machine.add_word(key, places)
        if where:
            self.machine.make_automaton()

    def found(self, words: list[bytes], doc: int) -> list[tuple[int, int]]:
        """[from, to) of a document's words that are also in a passage of a smaller doc_id."""
        out: list[tuple[int, int]] = []
        if not len(self.machine):
            return out
        text, width, piece, window, owner, every = self.letters.spell(words), self.letters.width, self.piece, self.window, self.owner, self.spelt
        done: dict[tuple[int, int], int] = {}
        for end, places in self.machine.iter(text):
            start = end + 1 - piece
            for k, o in places:
                if owner[k] >= doc or done.get((k, start - o), 0) > start:
                    continue
                passage = every[k]
                a, b = start, o
                while a and b and text[a - width : a] == passage[b - width : b]:
                    a, b = a - width, b - width
                to = end + 1 + agree(text, passage, end + 1, o + piece) // width * width
                done[k, start - o] = to
                if to - a >= window:
                    out.append((a // width, to // width))
        return out


def agree(x: str, y: str, i: int, j: int) -> int:
    """How many letters agree from x[i] and y[j] on."""
    n, most, step = 0, min(len(x) - i, len(y) - j), 64
    while n < most and x[i + n : i + n + step] == y[j + n : j + n + step]:
        n += step
    n = min(n, most)
    while n < most and x[i + n] == y[j + n]:
        n += 1
    return n


def finish(docs: pa.Table, told: pa.Table, window: int, buckets: int, schema: pa.Schema, digests: bool) -> pa.Table:
    shown, words, _, place, least, most = first_windows(docs, window, buckets)
    ids = [2**63 - 1 if i is None else i for i in shown]
    again = np.flatnonzero(least < most)
    again = again[np.argsort(place[again])]
    owners, texts = passages_at(words, place[again], least[again], window)
    for o, t in zip(told["owners"].to_pylist(), told["words"].to_pylist(), strict=True):
        owners += unplanes(o, "i8").tolist()
        texts += t.split(b"\n")
    shard = Shard(owners, [t.split() for t in texts], window)
    del texts
    rows = []
    for k, doc_id in enumerate(shown):
        own = words.text(int(words.first[k]), int(words.first[k + 1]))
        gone = np.zeros(len(own), bool)
        if len(own) >= window:
            for a, b in shard.found(own, ids[k]):
                gone[a:b] = True
        rows.append(row(doc_id, own, gone, digests))
    return table_of(rows, schema)


def row(doc_id: int | None, own: list[bytes], gone: np.ndarray, digests: bool) -> tuple:
    """A document's row: its words, and which of them go."""
    n = int(gone.sum())
    kept = b" ".join([w for w, x in zip(own, gone.tolist(), strict=True) if not x] if n else own)
    spans = runs(gone, np.zeros(len(gone), np.int64)) if n else []
    return doc_id, len(own), n, sha256(kept) if digests else kept.decode("utf-8", "replace"), ",".join(f"{x}:{y}" for x, y in spans) if digests else [{"start": x, "end": y} for x, y in spans]


def out_schema(digests: bool) -> tuple[str, pa.Schema]:
    kept, spans = ("kept_sha256", "removed_spans") if digests else ("kept", "removed_spans")
    span = pa.string() if digests else pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    ddl = f"doc_id long, n_words long, n_removed long, {kept} string, {spans} {'string' if digests else 'array<struct<start:long,end:long>>'}"
    return ddl, pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), (kept, pa.string()), (spans, span)])


def without_repeats(docs: DataFrame, window: int = WINDOW, digests: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, the kept words joined by spaces (or their SHA-256), and spans of removed words."""
    blocks, buckets = layout(docs)
    own = in_blocks(docs, blocks)
    ddl, schema = out_schema(digests)
    to_buckets, to_blocks = Exchange(buckets, hash="delta", doc="i8", block="i4"), Exchange(blocks, hash="delta", asker="i4")
    sent = to_buckets.delivered(own.groupBy("block").applyInArrow(lambda t: send(t, window, buckets, to_buckets), to_buckets.ddl))
    asks = to_blocks.delivered(sent.groupBy("at").applyInArrow(lambda t: confirm(t, to_buckets, to_blocks), to_blocks.ddl))
    passages = own.groupBy("block").cogroup(asks.groupBy("at")).applyInArrow(lambda d, a: answer(d, a, window, buckets, to_blocks), "block int, owners binary, words binary")
    return own.groupBy("block").cogroup(passages.groupBy("block")).applyInArrow(lambda d, p: finish(d, p, window, buckets, schema, digests), ddl)
