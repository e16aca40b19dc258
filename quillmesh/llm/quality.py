"""Quality rules as a short-circuit cascade.

On a sample, the first thousand rows of one partition that are not rejected anyway, a task times every rule and counts its
rejections; the rules are then asked in the order of rejections per second, the same in all tasks: a row that one rule rejects is not shown to the next. All rules must pass
for a row to be kept, so the order changes the time and never the verdict. Counts that are returned anyway (words,
characters, symbols, repeated lines and windows) are taken first and cost the rules nothing.

Cases: a null or empty text has no words and fails; white space alone likewise; repeated rows give repeated results; very
long texts are counted whole; an empty table gives an empty result, its rules in the order they are listed; columns other
than doc_id and text are not read, so their names cannot clash.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillmesh.llm.common import id_text, map_texts, schema_of, slices

#: Rows on which the rules are measured.
SAMPLE_ROWS = 1000
_SPACES = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"


@dataclass
class Counts:
    """What is known of a text before any rule is asked."""

    text: str
    data: bytes
    words: list[bytes]
    word_chars: int
    n_symbols: int
    n_lines: int
    n_dup_lines: int
    n_repeat_words: int


def repeat_words(words: list[bytes], window: int = 5) -> int:
    """Words inside windows of `window` words that the text holds twice or more, the first included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
    bits = max(1, (len(seen) - 1).bit_length())
    key = ids[:n].copy()
    used = bits
    for i in range(1, window):
        if used + bits > 62:  # the key so far becomes its rank, so that keys stay exact
            key = np.unique(key, return_inverse=True)[1].astype(np.int64)
            used = max(1, (n - 1).bit_length())
        key = (key << bits) | ids[i : i + n]
        used += bits
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    repeated = np.zeros(n, bool)
    repeated[order[1:][same]] = repeated[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, np.int32)
    starts = np.flatnonzero(repeated)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def count(text: str) -> Counts:
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip(_SPACES)] if b"\n" in data else [data] * bool(words)
    spaces = len(data) - len(data.translate(None, _SPACES))
    symbols = len(data) - len(data.translate(None, _SYMBOLS))
    return Counts(text, data, words, len(text) - spaces, symbols, len(lines), len(lines) - len(set(lines)), repeat_words(words))


def _shouts(c: Counts) -> bool:
    letters = sum(map(str.isalpha, c.text))
    return sum(map(str.isupper, c.text)) > 0.5 * letters


#: Name and test of each rule; a row is rejected if the test holds.
RULES: tuple[tuple[str, Callable[[Counts], bool]], ...] = (
    ("symbols", lambda c: c.n_symbols > 0.05 * c.word_chars),
    ("repeated lines", lambda c: c.n_dup_lines > 0.5 * c.n_lines),
    ("exclamations", lambda c: c.data.count(b"!") > 0.3 * len(c.words)),
    ("word length", lambda c: not 2 <= c.word_chars / max(1, len(c.words)) <= 15),
    ("stutter", lambda c: sum(map(bytes.__eq__, c.words, c.words[1:])) > 0.2 * len(c.words)),
    ("few different words", lambda c: len(c.words) >= 50 and len(set(c.words)) < 0.1 * len(c.words)),
    ("digits", lambda c: sum(map(str.isdigit, c.text)) > 0.5 * c.word_chars),
    ("capitals", _shouts),
)


def base_failed(c: Counts) -> bool:
    return len(c.words) < 10 or 100 * c.n_repeat_words > 20 * len(c.words)


Measured = dict[str, tuple[float, int]]


def measured(counts: Iterable[Counts], rules=RULES) -> Measured:
    """Seconds and rejections of each rule over rows that all of them are shown, one after another."""
    seconds, rejected = dict.fromkeys([n for n, _ in rules], 0.0), dict.fromkeys([n for n, _ in rules], 0)
    for c in counts:
        for name, test in rules:
            began = time.perf_counter()
            bad = test(c)
            seconds[name] += time.perf_counter() - began
            rejected[name] += bool(bad)
    return {name: (seconds[name], rejected[name]) for name, _ in rules}


def ordered(found: Measured) -> list[str]:
    """Names by rejections per second; rules that reject nothing last, the cheap ones first."""
    return sorted(found, key=lambda name: (-found[name][1] / max(found[name][0], 1e-9), found[name][0]))


class Cascade:
    """Rules in the given order of names."""

    def __init__(self, order: list[str], rules=RULES):
        tests = dict(rules)
        self.rules = [(name, tests[name]) for name in order]

    def rejects(self, c: Counts) -> str:
        """The name of the first rule that rejects, or nothing."""
        return next((name for name, test in self.rules if test(c)), "")


def plan(docs: DataFrame, rows: int = SAMPLE_ROWS) -> list[str]:
    """The order of the rules, measured in the task of the first partition that has rows to show them; the driver gets a row for each rule."""
    spark_schema, arrow = schema_of("name string, seconds double, rejected long")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts = (t for batch in batches for part in slices(batch) for t in part.column(1).to_pylist())
        found = measured(islice((c for t in texts if not base_failed(c := count(t))), rows))
        for _ in batches:  # the rest of the partition
            pass
        if any(s for s, _ in found.values()):
            columns = [list(found), [s for s, _ in found.values()], [n for _, n in found.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    # take runs one partition first, and others only if it has nothing
    taken = id_text(docs).mapInArrow(measure, spark_schema).take(len(RULES))
    return ordered({r["name"]: (r["seconds"], r["rejected"]) for r in taken}) if taken else [name for name, _ in RULES]


def quality(docs: DataFrame) -> DataFrame:
    """doc_id, the counts, base_failed, kept: not base_failed, and no rule of the cascade rejects."""
    order = plan(docs)

    def make():
        cascade = Cascade(order)

        def kernel(ids, texts):
            rows = []
            for text in texts:
                c = count(text)
                failed = base_failed(c)
                rows.append((len(c.words), c.word_chars, c.n_symbols, c.n_dup_lines, c.n_repeat_words, failed, not failed and not cascade.rejects(c)))
            return [ids, *(zip(*rows, strict=True) if rows else [[]] * 7)]

        return kernel

    return map_texts(id_text(docs), make, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean")
