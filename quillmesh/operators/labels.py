"""Best tag of texts that were read off pictures, among any number of tags with any number of aliases.

An alias scores 1 for equality after folding, 0.95 where it has three letters or more and is contained in the text, else the
Ratcliff-Obershelp similarity; a tag scores as its best alias. Labels lie in a file of the shared folder as blocks, ordered by
length; a task holds a block of texts against one block of aliases at a time. Counts of letters bound a score from above,
and the similarity itself is computed only where the bound could still change the best tag or the second.
"""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.functions.text import CONTAINED, LEAST_CONTAINED, LEAST_MARGIN, LEAST_SCORE, folded
from quillmesh.operators.lineage import new_folder
from quillmesh.sources.files import listed, located

#: Texts and aliases that a task compares at a time: the bounds are a matrix of one by the other.
TEXTS, ALIASES = 256, 4096
#: Letters are counted in so many classes; letters that share one only loosen the bound.
CLASSES = 48


def counts(texts: list[str]) -> np.ndarray:
    """How often each class of letters occurs in each text."""
    out = np.zeros((len(texts), CLASSES), np.int32)
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    np.add.at(out, (row, codes % CLASSES), 1)
    return out


def bounds(texts: np.ndarray, aliases: np.ndarray) -> np.ndarray:
    """No score of a text and an alias is above this."""
    n, m = texts.sum(1), aliases.sum(1)
    common = np.zeros((len(texts), len(aliases)), np.int32)
    for k in range(CLASSES):
        if texts[:, k].any() and aliases[:, k].any():
            common += np.minimum(texts[:, k, None], aliases[None, :, k])
    ratio = 2.0 * common / np.maximum(n[:, None] + m[None, :], 1)
    inside = (common == m[None, :]) & (m[None, :] >= LEAST_CONTAINED)
    return np.where(inside, np.maximum(ratio, CONTAINED), ratio)


class Ranked:
    """The best tag of a text, and the best score of any other."""

    def __init__(self):
        self.tag, self.score, self.second = None, 0.0, 0.0

    def needed(self) -> float:
        """An alias whose score is no higher cannot change what is returned."""
        return max(self.second, self.score - LEAST_MARGIN, min(self.score, LEAST_SCORE - LEAST_MARGIN))

    def add(self, tag: str, score: float) -> None:
        if tag == self.tag:
            self.score = max(self.score, score)
        elif score > self.score or (score == self.score and self.tag is not None and tag < self.tag):
            self.tag, self.score, self.second = tag, score, self.score
        else:
            self.second = max(self.second, score)

    def row(self) -> tuple[str | None, float]:
        sure = self.score >= LEAST_SCORE and self.score - self.second >= LEAST_MARGIN
        return self.tag if sure else None, self.score


def compare(texts: list[str], ranked: list[Ranked], tags: list[str], aliases: list[str], counted: np.ndarray) -> int:
    """Takes a block of aliases into account; how many similarities were computed."""
    bound, done = bounds(counts(texts), counted), 0
    for i, text in enumerate(texts):
        if len(text) < 2:
            continue
        r, matcher = ranked[i], SequenceMatcher(None, "", "")
        may = np.flatnonzero(bound[i] > r.needed())
        for j in may[np.argsort(-bound[i][may], kind="stable")].tolist():
            if bound[i, j] <= r.needed():
                break
            a = aliases[j]
            if a == text:
                r.add(tags[j], 1.0)
            elif len(a) >= LEAST_CONTAINED and a in text:
                r.add(tags[j], CONTAINED)
            else:
                matcher.set_seqs(text, a)
                r.add(tags[j], matcher.ratio())
                done += 1
    return done


def best_tags(texts: DataFrame, labels: DataFrame, text: str = "read", first_only: bool = False) -> DataFrame:
    """Distinct texts with label and score: the best tag of labels (tag, place, alias), or null where its score is below 0.65 or
    another tag's is within 0.05. first_only: aliases of the least place of each tag alone.

    Texts of less than two letters and digits have no tag and score 0; null tags and aliases are no labels; of tags with equal
    scores none is taken.
    """
    spark, folder = texts.sparkSession, new_folder(texts.sparkSession, "labels")
    own = labels.where("tag is not null and alias is not null").select("tag", "place", F.col("alias"))
    if first_only:
        own = own.groupBy("tag").agg(F.min(F.struct("place", "alias")).alias("m")).select("tag", F.col("m.alias").alias("alias"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [folded(a) for a in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.string()), pa.array([len(a) for a in own], pa.int32())], ["tag", "alias", "n"])

    own.select(F.col("tag").cast("string"), "alias").mapInArrow(fold, "tag string, alias string, n int").distinct().orderBy("n", "alias", "tag").write.parquet(folder)

    def blocks() -> Iterator[tuple[list[str], list[str], np.ndarray]]:
        for path, _ in listed(folder, ".parquet"):
            system, inner = located(path)
            with system.open_input_file(inner) as source:
                for batch in pq.ParquetFile(source).iter_batches(ALIASES, columns=["tag", "alias"]):
                    tags, aliases = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                    yield tags, aliases, counts(aliases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list | None = None
        for batch in batches:
            for at in range(0, batch.num_rows, TEXTS):
                part = batch.column(0).slice(at, TEXTS)
                own = [folded(t or "") for t in part.to_pylist()]
                ranked, seen = [Ranked() for _ in own], []
                for block in kept if kept is not None else blocks():
                    compare(own, ranked, *block)
                    if kept is None and len(seen) <= 4:
                        seen.append(block)
                if kept is None and len(seen) <= 4:  # few labels stay in memory
                    kept = seen
                rows = [r.row() for r in ranked]
                yield pa.RecordBatch.from_arrays([part, pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.float64())], [text, "label", "score"])

    return texts.select(text).distinct().mapInArrow(run, f"{text} string, label string, score double")
