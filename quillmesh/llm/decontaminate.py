"""Benchmark decontamination: one Aho-Corasick automaton over normalised items, one pass over each text.

Normalising lower-cases A-Z and turns every other ASCII character but letters and digits into a space; what lies between
spaces is a word. Characters keep their byte offsets, so a hit maps back to the original text. An item's windows are its
runs of ten words (an item of fewer words is one window); keys are windows with a space on either side, so hits begin and
end with words.

The benchmark is held by every task, so its size is checked: beyond `shard_bytes` of windows, it is dealt out over
several automata, each of which scans the texts, and the hits of a document are united.

Cases: a null text, or one without words, has no hits; items without words, or null, are no windows; items that share a
window are all reported; repeated rows give repeated results; an empty table of either kind gives no hits.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import append_texts, id_text, map_texts, sha256, unused

WINDOW = 10
#: Bytes of windows in one automaton.
SHARD_BYTES = 8 << 20
_NORMAL = bytes(c if c >= 0x80 or chr(c).isdigit() or chr(c).islower() else c + 32 if chr(c).isupper() else 32 for c in range(128)) + bytes(range(128, 256))


def words(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_NORMAL).split(b" ")


def item_windows(text: str | None, window: int = WINDOW) -> set[str]:
    w = [x for x in words(text or "") if x]
    return {" " + b" ".join(w[i : i + window]).decode("latin-1") + " " for i in range(max(1, len(w) - window + 1))} if w else set()


def shards(items: Iterator[tuple[object, str | None]], limit: int, window: int = WINDOW) -> Iterator[dict[str, list]]:
    """Windows with the ids of their items, in parts of about `limit` bytes."""
    part: dict[str, list] = {}
    size = 0
    for item_id, text in items:
        if item_id is None:
            continue
        new = item_windows(text, window)
        cost = sum(map(len, new))
        if part and size + cost > limit:
            yield part
            part, size = {}, 0
        size += cost
        for key in new:
            part.setdefault(key, []).append(item_id)
    if part:
        yield part


def automaton(windows: dict[str, list]) -> ahocorasick.Automaton:
    machine = ahocorasick.Automaton()
    for key, ids in windows.items():
        machine.add_word(key, (len(key), tuple(ids)))
    machine.make_automaton()
    return machine


def scan(text: str, machine: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], set]:
    """Number of words, hit words as [from, to) in order and apart from each other, and ids of the items found."""
    w = text.encode("utf-8", "surrogatepass").translate(_NORMAL).split()
    if not w or not len(machine):
        return len(w), [], set()
    line = " " + b" ".join(w).decode("latin-1") + " "
    hits, items = [], set()
    for end, (size, ids) in machine.iter(line):
        hits.append((end - size + 2, end))  # the window without its spaces, as [from, to) in `line`
        items.update(ids)
    if not hits:
        return len(w), [], items
    starts = np.cumsum([1, *(len(x) + 1 for x in w)])
    runs: list[list[int]] = []
    for a, b in sorted(zip(np.searchsorted(starts, [h[0] for h in hits]).tolist(), np.searchsorted(starts, [h[1] for h in hits]).tolist(), strict=True)):
        if runs and a <= runs[-1][1]:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return len(w), [(a, b) for a, b in runs], items


_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Code points of the original text that runs of words cover, end exclusive."""
    if not runs:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    return [(at[a][0], at[b - 1][1]) for a, b in runs]


def overlaps(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, item_ids (sorted as strings), spans (of the original text, in code points), contaminated."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text")
    held = [spark.sparkContext.broadcast(w) for w in shards(((r[0], r[1]) for r in items.toLocalIterator()), shard_bytes)] or [spark.sparkContext.broadcast({})]
    parts = [_scanned(docs, h, keyed=len(held) > 1) for h in held]
    found = parts[0]
    if len(parts) > 1:
        for p in parts[1:]:
            found = found.unionByName(p)
        # rows of one id and text are the same document's hits in several automata; copies of a row count apart
        found = found.groupBy("doc_id", "text_key", "n_words").agg(
            F.flatten(F.collect_list("runs")).alias("runs"), F.array_distinct(F.flatten(F.collect_list("item_ids"))).alias("item_ids"),
            F.flatten(F.collect_list("spans")).alias("spans"), (F.count(F.lit(1)) / len(parts)).cast("int").alias("copies"),
        )
        found = found.withColumn("runs", F.array_distinct("runs")).withColumn("spans", F.array_sort(F.array_distinct("spans"))).withColumn("copy", F.explode(F.sequence(F.lit(1), "copies")))
    covered = F.aggregate(
        F.array_sort("runs"), F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("upto")),
        lambda s, r: F.struct((s["n"] + F.greatest(F.lit(0), r["b"] - F.greatest(r["a"], s["upto"]))).alias("n"), F.greatest(s["upto"], r["b"]).alias("upto")),
    )["n"]
    return found.select("doc_id", "n_words", covered.alias("n_hit"), F.array_sort(F.transform("item_ids", lambda x: x.cast("string"))).alias("item_ids"), "spans", (F.size("runs") > 0).alias("contaminated"))


def _scanned(docs: DataFrame, held, keyed: bool) -> DataFrame:
    def make():
        machine = automaton(held.value)

        def kernel(ids, texts):
            rows = []
            for text in texts:
                n, runs, items = scan(text, machine)
                rows.append((n, [{"a": a, "b": b} for a, b in runs], sorted(items), [{"start": a, "end": b} for a, b in original_spans(text, runs)], sha256(text.encode("utf-8", "surrogatepass")) if keyed else ""))
            return [ids, *(zip(*rows, strict=True) if rows else [[]] * 5)]

        return kernel

    return map_texts(id_text(docs), make, "doc_id long, n_words long, runs array<struct<a:long,b:long>>, item_ids array<long>, spans array<struct<start:long,end:long>>, text_key string")


def clean(docs: DataFrame, benchmark: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """The documents that hold no window of the benchmark."""
    sc, items = docs.sparkSession.sparkContext, benchmark.select(F.col("item_id").cast("long"), "text")
    for windows in shards(((r[0], r[1]) for r in items.toLocalIterator()), shard_bytes):
        hit = unused(docs, "_hit")
        docs = append_texts(docs, _hits(sc.broadcast(windows)), f"{hit} boolean").where(~F.col(hit)).drop(hit)
    return docs


def _hits(held):
    def make():
        machine = automaton(held.value)
        return lambda ids, texts: [[bool(scan(t, machine)[1]) for t in texts]]

    return make


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"), F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), "contaminated")
