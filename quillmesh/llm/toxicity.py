"""Toxicity by the nearest labelled examples.

Examples are a bounded sample of labelled rows. Terms are lower-cased words, and stems (the first four, five or six letters
of words) that at least one, two, three, five or eight different words of a text share: inflected insults and compounds share
a stem, and a text that heaps them up differs from one that has one by chance. All terms that tell the labels apart on the
examples are kept, weighted by TF-IDF, and every vector has length one. An inverted index holds, for each term, its examples
in blocks, and for each block the term's largest weight.
A text's terms give every block an upper bound; blocks are scored in the order of their bounds until no bound exceeds the
k-th best cosine, so the nearest are exact. Votes are weighted by closeness, corrected for how often each label was
sampled, and mapped to a share of label 1 by monotone regression over leave-one-out votes of the examples.

Cases: a text without known terms (null or empty ones too) has no neighbours and gets the share of label 1 among the
examples without known terms; ties of cosine go to the example that comes first; a label that is null, or whose document
is missing, is no example; several labels of a document count as the largest; without examples every score is 0; repeated
rows give repeated results. `scored` reads no column but doc_id and text; `accepted` returns all columns, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import append_texts, checkpointed, map_texts, schema_of, unused

#: Most labelled rows of either label that are examples; nearest examples that vote; examples in a block.
EXAMPLES_OF_LABEL, NEAREST, BLOCK = 2000, 15, 64
#: A term tells the labels apart if so many examples have it, and its shares differ by so many standard errors.
LEAST_EXAMPLES, LEAST_Z = 5, 6
THRESHOLD = 0.3
#: Words of which a task remembers the terms. Only speed depends on it.
MEMO = 200_000


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


#: Lengths of stems, and how many different words of a text must share one for each of its terms.
STEMS, LEVELS = (4, 5, 6), (1, 2, 3, 5, 8)


def bare(word: str) -> str:
    """A word in lower case without what stands around it."""
    return word.strip(".,;:!?\"'()[]{}*#$%&|<>-_")


def terms_of(text: str) -> Counter[str]:
    words: Counter[str] = Counter()
    for word, n in Counter(text.lower().split()).items():
        words[bare(word)] += n
    del words[""]
    stems = Counter(w[:n] for w in words for n in STEMS if len(w) >= n)
    words.update({f"{x}~{n}": 1 for x, many in stems.items() for n in LEVELS if n <= many})
    return words


@dataclass
class Model:
    """What is learnt from the examples; small enough to go with every task."""

    terms: dict[str, int]
    idf: np.ndarray
    labels: np.ndarray
    ids: np.ndarray
    weight: np.ndarray  # of a vote, by which sampling is undone
    none: float  # score of a text without terms
    rows: list[dict[int, tuple[np.ndarray, np.ndarray]]] = field(default_factory=list)  # by term, then block: examples, weights
    most: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))  # by term and block
    steps: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.zeros(1), np.zeros(1)))

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        t = np.fromiter(sorted(counts), np.int64)
        w = np.array([1 + math.log(counts[i]) for i in t.tolist()]) * self.idf[t]
        return t, w / np.sqrt((w * w).sum())

    def nearest(self, counts: dict[int, int], k: int = NEAREST, without: int = -1) -> list[tuple[int, float]]:
        """Examples of the k largest cosines above zero, with those."""
        t, w = self.vector(counts)
        bound = w @ self.most[t]
        best: list[tuple[float, int]] = []
        for b in np.argsort(-bound, kind="stable").tolist():
            if bound[b] <= 0 or (len(best) == k and bound[b] < best[-1][0] - 1e-9):
                break
            score = np.zeros(BLOCK)
            for i, x in zip(t.tolist(), w.tolist(), strict=True):
                if b in self.rows[i]:
                    at, value = self.rows[i][b]
                    score[at] += x * value
            here = np.flatnonzero(score > 0)
            best += [(float(score[j]), b * BLOCK + j) for j in here.tolist() if b * BLOCK + j != without]
            best = sorted(best, key=lambda x: (-x[0], x[1]))[:k]
        return [(j, s) for s, j in best]

    def vote(self, near: list[tuple[int, float]]) -> float:
        """Share of label 1, each neighbour by its closeness."""
        at = np.array([j for j, _ in near])
        w = self.weight[at] / (1.02 - np.array([s for _, s in near]))
        return float((w * self.labels[at]).sum() / w.sum())

    def score(self, counts: dict[int, int]) -> tuple[float, list[tuple[int, float]]]:
        near = self.nearest(counts) if counts and len(self.labels) else []
        if not near:
            return self.none, []
        return float(np.interp(self.vote(near), *self.steps)), near


def monotone(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Non-decreasing weighted regression of y on x, as points to interpolate."""
    pools: list[list[float]] = []
    for a, b, c in sorted(zip(x.tolist(), y.tolist(), w.tolist(), strict=True)):
        pools.append([a, a, b * c, c])
        while len(pools) > 1 and (pools[-2][2] / pools[-2][3] >= pools[-1][2] / pools[-1][3] or pools[-2][1] == pools[-1][0]):
            _, hi, s, n = pools.pop()
            pools[-1] = [pools[-1][0], hi, pools[-1][2] + s, pools[-1][3] + n]
    points = [(p, q[2] / q[3]) for q in pools for p in (q[0], q[1])]
    return np.array([p for p, _ in points]), np.array([v for _, v in points])


def assemble(ids: list[int], bags: list[dict[int, int]], labels: list[int], terms: dict[str, int], seen: list[int], totals: dict[int, int]) -> Model:
    """The index of the examples. seen: how many have each term; totals: how many rows of each label there were to sample from."""
    if not ids:
        return Model({}, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), 0.0)
    y = np.array(labels)
    n1, n0 = max(1, int(y.sum())), max(1, int((1 - y).sum()))
    idf = np.array([math.log((1 + len(y)) / (1 + n)) + 1 for n in seen])
    weight = np.where(y == 1, totals.get(1, n1) / n1, totals.get(0, n0) / n0)
    empty = np.array([not b for b in bags])
    prior = float((weight * y).sum() / weight.sum())
    none = float(((weight * y)[empty].sum() + prior) / (weight[empty].sum() + 1))
    model = Model(terms, idf, y, np.array(ids, np.int64), weight, none)
    blocks = -(-len(y) // BLOCK)
    model.most = np.zeros((len(terms), blocks), np.float32)
    lists: list[dict[int, tuple[list, list]]] = [{} for _ in terms]
    for j, bag in enumerate(bags):
        if bag:
            for i, w in zip(*(v.tolist() for v in model.vector(bag)), strict=True):
                at, value = lists[i].setdefault(j // BLOCK, ([], []))
                at.append(j % BLOCK)
                value.append(w)
                model.most[i, j // BLOCK] = max(model.most[i, j // BLOCK], np.nextafter(np.float32(w), np.float32(2)))
    model.rows = [{b: (np.array(a, np.int64), np.array(v)) for b, (a, v) in row.items()} for row in lists]
    return model


class Scorer:
    """Counts of a text's terms, looking at each different word once."""

    def __init__(self, model: Model):
        self.model, self.memo = model, {}
        self.levels: dict[str, list[tuple[int, int]]] = {}
        for term, i in model.terms.items():
            stem, mark, level = term.rpartition("~")
            if mark and level.isdigit():
                self.levels.setdefault(stem, []).append((int(level), i))

    def known(self, word: str) -> tuple[str, int, tuple[str, ...]] | None:
        """Of a word that has a term or a stem that has one: itself, its term or -1, and those stems."""
        w = bare(word)
        i, stems = self.model.terms.get(w, -1), tuple(w[:n] for n in STEMS if len(w) >= n and w[:n] in self.levels)
        return (w, i, stems) if w and (i >= 0 or stems) else None

    def counts(self, text: str) -> dict[int, int]:
        out: dict[int, int] = {}
        memo, sharing = self.memo, {}
        if len(memo) > MEMO:
            memo.clear()
        for word, n in Counter(text.lower().split()).items():
            if word in memo:
                found = memo[word]
            else:
                found = memo[word] = self.known(word)
            if found:
                w, i, stems = found
                if i >= 0:
                    out[i] = out.get(i, 0) + n
                for stem in stems:
                    sharing.setdefault(stem, set()).add(w)
        for stem, words in sharing.items():
            out.update((i, 1) for level, i in self.levels[stem] if level <= len(words))
        return out


def sampled(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[int, int]]:
    """(doc_id, toxic, text) of the examples, and how many rows of each label there were.

    Rows that are not held out; of either label those whose id has the smallest hash, at most `per_label`.
    """
    own = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2)
    totals = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = [r for k in (0, 1) for r in own.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label).collect()]
    asked = docs.sparkSession.createDataFrame(chosen, "doc_id long, toxic int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(asked), "doc_id")
    return texts.groupBy("doc_id", "toxic").agg(F.min(F.coalesce("text", F.lit(""))).alias("text")), totals


def telling_terms(texts: DataFrame, n1: int, n0: int) -> list[tuple[str, int]]:
    """All terms that tell the labels apart, best first, and how many examples have each."""
    spark_schema, arrow = schema_of("term string, toxic int")

    def terms(batches):
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = list(terms_of(text))
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array([label] * len(own), pa.int32())], schema=arrow)

    counted = texts.select("toxic", "text").mapInArrow(terms, spark_schema).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    a, b = F.col("a"), F.col("b")
    p = (a + b) / (n1 + n0)
    z = F.abs(a / n1 - b / n0) / F.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)
    found = counted.select("term", (a + b).alias("n"), F.round(z, 9).alias("z")).where(f"n >= {LEAST_EXAMPLES} and z > {LEAST_Z}").collect()
    return [(r["term"], r["n"]) for r in sorted(found, key=lambda r: (-r["z"], r["term"]))]


def train(docs: DataFrame, labels: DataFrame, per_label: int = EXAMPLES_OF_LABEL) -> Model:
    """Texts stay in tasks: the driver gets the telling terms, the examples' counts of those, and their votes."""
    texts, totals = sampled(docs, labels, per_label)
    texts = checkpointed(texts.repartition(docs.sparkSession.sparkContext.defaultParallelism, "doc_id"))
    n1, n0 = (max(1, min(per_label, totals.get(k, 0))) for k in (1, 0))
    chosen = telling_terms(texts, n1, n0)
    terms = {t: i for i, (t, _) in enumerate(chosen)}
    bare_model = Model(terms, np.zeros(0), np.zeros(0), np.zeros(0, np.int64), np.zeros(0), 0.0)

    def bags():
        scorer = Scorer(bare_model)

        def kernel(of, texts):
            found = [scorer.counts(t) for t in texts]
            return [[x["doc_id"] for x in of], [x["toxic"] for x in of], [list(c) for c in found], [list(c.values()) for c in found]]

        return kernel

    own = texts.select(F.struct("doc_id", "toxic").alias("of"), "text")
    rows = map_texts(own, bags, "doc_id long, toxic int, terms array<int>, counts array<int>").toArrow().sort_by("doc_id").to_pydict()
    counted = [dict(zip(t, n, strict=True)) for t, n in zip(rows["terms"], rows["counts"], strict=True)]
    model = assemble(rows["doc_id"], counted, rows["toxic"], terms, [n for _, n in chosen], totals)
    calibrate(model, counted, docs)
    return model


def calibrate(model: Model, bags: list[dict[int, int]], docs: DataFrame) -> None:
    """From a vote to a share of label 1, by what the examples get from all others; each task votes on some of them."""
    sc = docs.sparkSession.sparkContext
    asked = [(j, list(bag), list(bag.values())) for j, bag in enumerate(bags) if bag]
    if not asked:
        return
    held, (spark_schema, arrow) = sc.broadcast(model), schema_of("j int, vote double")

    def votes(batches):
        m = held.value
        for batch in batches:
            found = []
            for j, t, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                near = m.nearest(dict(zip(t, n, strict=True)), without=j)
                if near:
                    found.append((j, m.vote(near)))
            yield pa.RecordBatch.from_arrays([pa.array([j for j, _ in found], pa.int32()), pa.array([v for _, v in found], pa.float64())], schema=arrow)

    frame = docs.sparkSession.createDataFrame(asked, "j int, terms array<int>, counts array<int>").repartition(sc.defaultParallelism)
    got = frame.mapInArrow(votes, spark_schema).toArrow().sort_by("j").to_pydict()
    if got["j"]:
        at = np.array(got["j"])
        model.steps = monotone(np.array(got["vote"]), model.labels[at].astype(float), model.weight[at])


def scored(docs: DataFrame, model: Model, evidence: bool = False) -> DataFrame:
    """doc_id, held_out, score, predicted, and with evidence the nearest examples with their cosines and labels."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    tail = ", evidence array<struct<doc_id:long,cosine:double,toxic:int>>" if evidence else ""

    def make():
        scorer = Scorer(held.value)
        m = scorer.model

        def kernel(ids, texts):
            found = [m.score(scorer.counts(t)) for t in texts]
            out = [ids, [held_out(i) for i in ids], [s for s, _ in found], [int(s >= THRESHOLD) for s, _ in found]]
            return [*out, [[{"doc_id": int(m.ids[j]), "cosine": c, "toxic": int(m.labels[j])} for j, c in near] for _, near in found]] if evidence else out

        return kernel

    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return map_texts(own, make, f"doc_id long, held_out boolean, score double, predicted int{tail}")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not predicted toxic."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(held.value)
        return lambda ids, texts: [[held.value.score(scorer.counts(t))[0] >= THRESHOLD for t in texts]]

    toxic = unused(docs, "_toxic")
    return append_texts(docs, make, f"{toxic} boolean").where(~F.col(toxic)).drop(toxic)
