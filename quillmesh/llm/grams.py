"""Words of many texts at once: positions and hashes with numpy over Arrow's own buffers, and exchanges of packed items.

A word's hash is a polynomial over a random table of byte values, brought to the word's own start and mixed; a window's
hash is a polynomial over word hashes. Equal words and windows have equal hashes wherever they stand.

Documents are dealt into blocks and hashes into buckets, both in proportion to the input. Items go from blocks to buckets
and back in an Exchange: one row for each pair of sender and target while there are few targets, and beyond `FAN` of them
in two steps, by zones of targets first, so that rows grow with the items and never with the square of the input.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import id_text, input_bytes

#: Bytes whose powers are worked out at a time.
_SEGMENT = 1 << 20
_SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
_BASE, _STEP = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: A doc_id that is null counts as the largest.
NO_ID = np.int64((1 << 63) - 1)
#: Bytes of input files for each block of documents, and for each bucket of hashes.
BLOCK_BYTES = BUCKET_BYTES = 4 << 20
#: Most targets to which a sender has rows of its own; more are reached in two steps.
FAN = 1 << 14


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        n = max(n, _SEGMENT + (1 << 16))
        inverse = pow(_BASE, -1, 1 << 64)
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(n - 1, b, np.uint64)])) for b in (_BASE, inverse)]
    return _powers[0], _powers[1]


@dataclass
class Words:
    """Words of a block's texts, in the order of the texts."""

    data: np.ndarray  # bytes of all texts
    start: np.ndarray
    end: np.ndarray
    row: np.ndarray  # the text of each word
    first: np.ndarray  # the first word of each text, and the number of words
    hash: np.ndarray

    def text(self, a: int, b: int) -> list[bytes]:
        """Words a to b, end exclusive, of one text."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes().split() if b > a else []


def words_of(texts: pa.Array) -> Words:
    n = len(texts)
    offsets_type = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, offsets_type)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(values, np.uint8)[at[0] : at[-1]] if values is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    inside = ~_SPACE[data]
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    edge = at[1:-1][(at[1:-1] > 0) & (at[1:-1] < len(data))]
    begins[edge] = inside[edge]
    ends[edge - 1] = inside[edge - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    row = np.repeat(np.arange(n), np.diff(first))
    return Words(data, start, end, row, first, _hashes(data, start, end))


def _hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + _SEGMENT)))
        a, b = int(start[i]), int(end[j - 1])
        up, down = _power_tables(b - a)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(_VALUES[data[a:b]] * up[: b - a])])
        s, e = start[i:j] - a, end[i:j] - a
        out[i:j] = (sums[e] - sums[s]) * down[s]
        i = j
    return mix(out)


def windows(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the n words from each word on, and whether they are all of one text."""
    h = words.hash
    if len(h) < n:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    out, size, part, width = None, 0, h, 1
    while True:
        if n & width:
            out = part if out is None else out[: len(part) - size] + part[size:] * np.uint64(pow(_STEP, size, 1 << 64))
            size += width
        if size == n:
            break
        part = part[:-width] + part[width:] * np.uint64(pow(_STEP, width, 1 << 64))
        width *= 2
    m = len(h) - n + 1
    return mix(out[:m].copy()), words.row[:m] == words.row[n - 1 :]


def planes(x: np.ndarray) -> bytes:
    """Integers byte plane by byte plane, so that codecs find the zeros."""
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, x.dtype.itemsize).T.tobytes()


def unplanes(b: bytes, kind: str) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


class Exchange:
    """Items, columns of equal length, on their way to numbered targets.

    A field is "delta" (64-bit hashes, sent as differences), the name of an integer type, or "raw:type:width" (rows of
    `width` values). A row of the exchange holds the items of one sender for one target, a binary for each field.
    """

    def __init__(self, targets: int, **fields: str):
        self.zone = -(-targets // FAN)  # targets that share the rows of the first step
        self.salts = -(-self.zone // 8)  # tasks of a zone in the second
        self.fields = {**({"target": "i4"} if self.zone > 1 else {}), **fields}
        self.schema = pa.schema([("at", pa.int32()), ("kind", pa.int32()), ("salt", pa.int32()), *[(f, pa.binary()) for f in self.fields]])
        self.ddl = ", ".join(["at int, kind int, salt int", *[f"{f} binary" for f in self.fields]])

    def pack(self, at: np.ndarray, kind: int, salt: int, columns: dict[str, np.ndarray]) -> list[tuple]:
        """Rows of items whose `at` is sorted; a field that is not among the columns is null."""
        if not len(at):
            return []
        cut = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), len(at)]
        return [(int(at[i]), kind, salt, *[_encoded(columns[f][i:j], how) if f in columns else None for f, how in self.fields.items()]) for i, j in zip(cut, cut[1:], strict=False)]

    def rows(self, target: np.ndarray, sender: int, kind: int = 0, **columns: np.ndarray) -> list[tuple]:
        """Rows of one sender; targets are sorted."""
        if self.zone > 1:
            columns["target"] = target.astype(np.int32)
        return self.pack(target // self.zone, kind, sender % self.salts, columns)

    def table(self, rows: list[tuple]) -> pa.Table:
        return table_of(rows, self.schema)

    def columns(self, table: pa.Table) -> dict[str, np.ndarray]:
        """Items of a group of rows of one kind."""
        kept = {f: [b for b in table[f].to_pylist() if b is not None] for f in self.fields}
        return {f: np.concatenate([_decoded(b, self.fields[f]) for b in parts]) for f, parts in kept.items() if parts}

    def delivered(self, rows: DataFrame) -> DataFrame:
        """Rows whose `at` is the target itself, to be grouped by it."""
        return rows if self.zone == 1 else rows.groupBy("at", "kind", "salt").applyInArrow(lambda t: self._resent(t), self.ddl)

    def _resent(self, table: pa.Table) -> pa.Table:
        own = self.columns(table)
        order = np.argsort(own["target"], kind="stable")
        own = {f: x[order] for f, x in own.items()}
        return self.table(self.pack(own["target"], table["kind"][0].as_py(), table["salt"][0].as_py(), own))


def _encoded(x: np.ndarray, how: str) -> bytes:
    if how == "delta":
        return planes(np.diff(x.astype(np.uint64, copy=False), prepend=np.uint64(0)))
    return x.tobytes() if how.startswith("raw") else planes(x.astype(how, copy=False))


def _decoded(b: bytes, how: str) -> np.ndarray:
    if how == "delta":
        return np.cumsum(unplanes(b, "u8"), dtype=np.uint64)
    if how.startswith("raw"):
        _, kind, width = how.split(":")
        return np.frombuffer(b, kind).reshape(-1, int(width))
    return unplanes(b, how)


def table_of(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets are ranges of hashes, so they are sorted where the hashes are."""
    return ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def among(known: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Which x are among the sorted values."""
    return known[np.minimum(np.searchsorted(known, x), len(known) - 1)] == x if len(known) else np.zeros(len(x), bool)


def layout(docs: DataFrame) -> tuple[int, int]:
    """Numbers of blocks of documents and of buckets of hashes, in proportion to the input."""
    size = input_bytes(docs)
    return max(1, -(-size // BLOCK_BYTES)), max(1, -(-size // BUCKET_BYTES))


def in_blocks(docs: DataFrame, blocks: int) -> DataFrame:
    """doc_id, text, block; rows of one id share a block."""
    own = id_text(docs)
    return own.withColumn("block", F.pmod(F.xxhash64(F.coalesce(F.col("doc_id"), F.xxhash64("text"))), F.lit(blocks)).cast("int"))


def block_rows(table: pa.Table) -> tuple[np.ndarray, list, Words]:
    """A block's ids (null: the largest), ids as they are, and words, in the order of id, then text."""
    if not table.num_rows:
        return np.zeros(0, np.int64), [], words_of(pa.array([], pa.string()))
    table = table.take(pc.sort_indices(table, [("doc_id", "ascending"), ("text", "ascending")]))
    ids = table["doc_id"].combine_chunks()
    ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
    text = table["text"].combine_chunks()
    text = text.combine_chunks() if isinstance(text, pa.ChunkedArray) else text
    return ids.fill_null(int(NO_ID)).to_numpy(), ids.to_pylist(), words_of(text)


def least_of_equal(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
    """For each position the smallest value among equal keys."""
    if not len(keys):
        return values
    order = np.lexsort((values, keys))
    k = keys[order]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    out = np.empty_like(values)
    out[order] = values[order][head][np.cumsum(head) - 1]
    return out


def removed(words: Words, window: int, starts: np.ndarray) -> np.ndarray:
    """Which words the windows at these starts cover."""
    edge = np.zeros(len(words.hash) + 1, np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:-1]) > 0


def runs(flags: np.ndarray, row: np.ndarray) -> list[tuple[int, int]]:
    """[from, to) of unbroken runs of flagged positions of one text."""
    at = np.flatnonzero(flags)
    if not len(at):
        return []
    cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(row[at]) > 0)) + 1
    return [(int(x[0]), int(x[-1]) + 1) for x in np.split(at, cut)]
