"""Byte-level BPE encoding and decoding.

A piece's bytes are the leaves of a segment tree. A leaf holds rank * width + position of the pair that starts there
(no live pair: a value above all others), an inner node the minimum of its children, so the root is the leftmost pair of
the lowest rank. A merge changes at most three leaves (the merged part, the part it swallows, the live part before it),
each with a logarithmic walk to the root. Many short pieces of one width are merged together, a step of each at a time,
with numpy, which takes all minima of a level anew at once; a long piece has a tree of its own, and walks.

Cases: a null or empty text has no ids and decodes to nothing; lone surrogates become U+FFFD as the library does; ties of
rank go to the leftmost pair; repeated rows give repeated results; an empty table gives an empty result. `encoded` reads no
column but doc_id and text; `tokenised` replaces columns named n_tokens or ids and returns all others.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache
from sys import getsizeof

import numpy as np
import public_tokenizers
import regex
from pyspark.sql import DataFrame

from quillmesh.llm.common import append_texts, id_text, map_texts, sha256

#: Pieces of up to so many bytes are merged in groups; a wider piece has its own tree.
GROUP_BYTES = 64
#: Bytes of chunks and their ids that a task remembers, besides those of the texts at hand. Only speed depends on it.
MEMO = 24 << 20
#: Characters of texts that are cut into chunks at a time.
TOGETHER = 1 << 20
#: A space beside other white space: there a text cannot be cut at its spaces.
_UNEVEN_SPACE = re.compile(r" \s|\s ")
#: A word of common letters, and what ends it without being part of it.
_WORD, _STOPS = re.compile(" ?[A-Za-zªµºÀ-ÖØ-öø-ˁ]+"), ".,;:!?"
NONE = np.int64(1) << 62
FAR = np.int32(2**31 - 1)


class Vocabulary:
    """Ranks of byte strings, and the rank that each pair of ids merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        self.pairs = {
            (left << 32) | right: rank
            for token, rank in self.ranks.items()
            for cut in range(1, len(token))
            if (left := self.ranks.get(token[:cut])) is not None and (right := self.ranks.get(token[cut:])) is not None
        }
        self._fill(np.array(list(self.pairs), np.int64), np.array(list(self.pairs.values()), np.int32))

    def _fill(self, keys: np.ndarray, ranks: np.ndarray) -> None:
        """The pairs in a table of four places each or more; a pair whose place is taken goes to the next free one."""
        self.bits = max(4, (4 * len(keys)).bit_length())
        self.pair_keys, self.pair_ranks = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        at = self._places(keys)
        while len(keys):
            _, one = np.unique(at, return_index=True)
            one = one[self.pair_keys[at[one]] < 0]
            self.pair_keys[at[one]], self.pair_ranks[at[one]] = keys[one], ranks[one]
            keys, ranks, at = np.delete(keys, one), np.delete(ranks, one), self._next(np.delete(at, one))

    def _places(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).view(np.int64)

    def _next(self, at: np.ndarray) -> np.ndarray:
        return (at + 1) & ((1 << self.bits) - 1)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's concatenation, or -1. An id below 0 has no pair."""
        keys = ((left.astype(np.int64) << 32) | right).ravel()
        at = self._places(keys)
        there = self.pair_keys.take(at)
        out = np.where(there == keys, self.pair_ranks.take(at), np.int32(-1))
        on = np.flatnonzero((there != keys) & (there >= 0))
        while len(on):
            at[on] = self._next(at[on])
            there = self.pair_keys.take(at[on])
            hit = there == keys[on]
            out[on[hit]] = self.pair_ranks.take(at[on[hit]])
            on = on[~hit & (there >= 0)]
        return out.reshape(left.shape)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def merge_group(pieces: list[bytes], width: int, v: Vocabulary) -> list[bytes]:
    """Ids of pieces of at most `width` bytes, a power of two, as little-endian 32-bit integers.

    Row k of an array holds node, or position, k of every piece, so a level of all trees is the minimum of two blocks of rows.
    The row after the last position stands for "no neighbour"; pieces that are done are left out when half are.
    """
    m, shift = len(pieces), width.bit_length() - 1
    size = np.array([len(p) for p in pieces], np.int32)
    raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(m, width).T
    place = np.arange(width, dtype=np.int32)[:, None]
    part = np.full((width + 1, m), -1, np.int32)
    part[:width] = np.where(place < size, v.byte_ids[raw], -1)
    after = np.where(place + 1 < size, place + 1, np.int32(width))
    before = np.repeat(np.arange(-1, width, dtype=np.int32)[:, None], m, 1)  # the last row is never read
    before[0] = width
    tree = np.full((2 * width + 1, m), FAR, np.int32)
    rank = v.merged(part[:width], part[1:])
    tree[width : 2 * width] = np.where(rank >= 0, rank * np.int32(width) + place, FAR)
    done, own = np.full((m, width), -1, np.int32), np.arange(m)
    while True:
        half = width
        while half > 1:
            half >>= 1
            np.minimum(tree[2 * half : 4 * half : 2], tree[2 * half + 1 : 4 * half : 2], out=tree[half : 2 * half])
        column = np.flatnonzero(tree[1] < FAR)
        if 2 * len(column) <= len(own):
            done[own] = part[:width].T
            if not len(column):
                break
            own, part, after, before, tree = own[column], *(x.take(column, 1) for x in (part, after, before, tree))
            column = np.arange(len(own))
        n, top = len(own), tree[1, column]
        flat_part, flat_after, flat_before, flat_tree = part.reshape(-1), after.reshape(-1), before.reshape(-1), tree.reshape(-1)
        rank, at = top >> shift, (top & np.int32(width - 1)) * n + column
        gone = flat_after[at] * n + column
        flat_part[at], flat_part[gone] = rank, -1
        right = flat_after[gone]
        flat_after[at] = right
        right = right * n + column
        flat_before[right] = at // n
        left = flat_before[at]
        left_at = left * n + column
        new = v.merged(np.concatenate([rank, flat_part[left_at]]), np.concatenate([flat_part[right], rank]))
        new_right, new_left = new[: len(column)], new[len(column) :]
        leaf = width * n
        flat_tree[gone + leaf] = FAR
        flat_tree[at + leaf] = np.where(new_right >= 0, new_right * np.int32(width) + (top & np.int32(width - 1)), FAR)
        flat_tree[left_at + leaf] = np.where(new_left >= 0, new_left * np.int32(width) + left, FAR)
    live = done >= 0
    flat, ends = done[live].astype("<u4").tobytes(), 4 * np.cumsum(live.sum(1))
    return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def merge_one(piece: bytes, v: Vocabulary) -> bytes:
    """Ids of one long piece: some fifty bytes of memory for each of its bytes, and logarithmic time for each merge."""
    n = len(piece)
    width = 1 << max(1, (n - 1).bit_length())
    none, pairs = int(NONE), v.pairs
    ids = v.byte_ids[np.frombuffer(piece, np.uint8)]
    rank = v.merged(ids[:-1], ids[1:]).astype(np.int64)
    filled = np.full(2 * width, NONE, np.int64)
    filled[width : width + n - 1] = np.where(rank >= 0, rank * width + np.arange(n - 1), NONE)
    half = width
    while half > 1:
        half //= 2
        np.minimum(filled[2 * half : 4 * half : 2], filled[2 * half + 1 : 4 * half : 2], out=filled[half : 2 * half])
    tree = array("q", filled.tobytes())
    part, after, before = array("i", ids.astype(np.int32).tobytes()), array("i", range(1, n + 1)), array("i", range(-1, n - 1))
    del filled, rank, ids

    def put(leaf: int, value: int) -> None:
        node = leaf + width
        tree[node] = value
        while node > 1:
            a, b = tree[node], tree[node ^ 1]
            node >>= 1
            low = a if a < b else b
            if tree[node] == low:
                return
            tree[node] = low

    while (top := tree[1]) < none:
        at, rank = top % width, top // width
        gone = after[at]
        right, left = after[gone], before[at]
        part[at], part[gone], after[at] = rank, -1, right
        put(gone, none)
        pair = pairs.get((rank << 32) | part[right]) if right < n else None
        put(at, none if pair is None else pair * width + at)
        if right < n:
            before[right] = at
        if left >= 0:
            pair = pairs.get((part[left] << 32) | rank)
            put(left, none if pair is None else pair * width + left)
    out = np.frombuffer(part, np.int32)
    return out[out >= 0].astype("<u4").tobytes()


class Encoder:
    """Texts to ids (little-endian 32-bit integers) and back."""

    def __init__(self, path: str, pattern: str, memo: int = MEMO):
        self.v, self.pattern, self.most = vocabulary(path), regex.compile(pattern), memo
        #: Chunks asked for since the last time that it was full, and those of the time before; bytes of the former and of both.
        self.memo, self.older, self.young, self.held = {}, {}, 0, 0
        self.own_pattern = pattern == public_tokenizers.PATTERN

    def chunks(self, text: str) -> list[str]:
        """Parts of a text that are encoded apart from each other.

        With the usual pattern a piece starts at every single space between other characters, and no piece looks
        further back, so such spaces part a text. Another pattern, or uneven spaces: the pattern's own pieces.
        """
        if not self.own_pattern or _UNEVEN_SPACE.search(text):
            return self.pattern.findall(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def word(self, chunk: str) -> str:
        """The usual word that a chunk is, but for stops after it; both are pieces of the usual pattern. Empty: the pattern has to cut it."""
        word = chunk.rstrip(_STOPS) if self.own_pattern else ""
        return word if _WORD.fullmatch(word) else ""

    def learn(self, chunks: set[str]) -> None:
        words: dict[str, str] = {}
        cut: dict[str, list[str]] = {}
        new: set[str] = set()
        for c in chunks:  # no list for a chunk that is a word: there are very many
            word = self.word(c)
            if not word:
                cut[c] = self.pattern.findall(c)
                new.update(cut[c])
            else:
                new.add(word)
                if len(word) < len(c):
                    words[c] = word
                    new.add(c[len(word) :])
        done: dict[str, bytes] = {}
        groups: dict[int, list[str]] = {}
        for text in new:
            known = self.own_pattern and (self.memo.get(text) or self.older.get(text))
            if known:  # a piece is a chunk as well
                done[text] = known
                continue
            piece = text.encode("utf-8", "surrogatepass")
            whole = self.v.ranks.get(piece)
            if whole is not None:
                done[text] = whole.to_bytes(4, "little")
            elif len(piece) > GROUP_BYTES:
                done[text] = merge_one(piece, self.v)
            else:
                groups.setdefault(1 << (len(piece) - 1).bit_length(), []).append(text)
        for width, texts in groups.items():
            for i in range(0, len(texts), 8192):
                part = texts[i : i + 8192]
                done.update(zip(part, merge_group([t.encode("utf-8", "surrogatepass") for t in part], width, self.v), strict=True))
        for c in chunks:
            if c in cut:
                self.remember(c, b"".join([done[p] for p in cut[c]]))
            elif c in words:
                self.remember(c, done[words[c]] + done[c[len(words[c]) :]])
            else:
                self.remember(c, done[c])

    def remember(self, chunk: str, ids: bytes) -> None:
        size = getsizeof(chunk) + getsizeof(ids) + 100
        self.memo[chunk] = ids
        self.young += size
        self.held += size

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text; a few texts at a time, so that few chunks live at once."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self.encode_together(held)
                held, size = [], 0
        return out + self.encode_together(held)

    def encode_together(self, texts: list[str]) -> list[bytes]:
        out = []
        for text in texts:
            if not text.isascii():
                text = text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")
            out.append(self.chunks(text))
        missing = set().union(*out).difference(self.memo) if out else set()
        if back := missing.intersection(self.older):
            for c in back:
                self.remember(c, self.older[c])
            missing -= back
        if missing:
            self.learn(missing)
        coded = [b"".join(map(self.memo.__getitem__, chunks)) for chunks in out]
        if self.young > self.most // 2 or self.held > self.most:  # what was asked for since the last time stays, the rest goes
            self.older, self.held = (self.memo, self.young) if self.young <= self.most else ({}, 0)
            self.memo, self.young = {}, 0
        return coded

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.v.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoded(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, and ids (array) and decoded text; with digests their SHA-256 instead."""
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def make():
        encoder = Encoder(path, pattern)

        def kernel(ids, texts):
            coded = encoder.encode(texts)
            counts = [len(c) // 4 for c in coded]
            if digests:
                return [ids, counts, [sha256(c) for c in coded], [sha256(encoder.decode(c)) for c in coded]]
            return [ids, counts, [np.frombuffer(c, "<i4") for c in coded], [encoder.decode(c).decode("utf-8", "replace") for c in coded]]

        return kernel

    return map_texts(id_text(docs), make, f"doc_id long, n_tokens long, {tail}")


def tokenised(docs: DataFrame, path: str, pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """The documents with n_tokens and ids in place of the text, each text having been decoded again and found the same.

    Columns that the documents already have under these names give way.
    """

    def make():
        encoder = Encoder(path, pattern)

        def kernel(ids, texts):
            coded = encoder.encode(texts)
            for text, c in zip(texts, coded, strict=True):
                if encoder.decode(c) != text.encode("utf-8", "replace"):
                    raise ValueError("ids do not decode to their text")
            return [[len(c) // 4 for c in coded], [np.frombuffer(c, "<i4") for c in coded]]

        return kernel

    return append_texts(docs.drop("n_tokens", "ids"), make, "n_tokens long, ids array<int>").drop("text")
