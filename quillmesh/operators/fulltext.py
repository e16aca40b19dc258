"""Ranked full-text search by postings: only the questions' terms are looked up.

Questions and chunks meet on stems, as an index with a stemming tokenizer does; how many of a question's words an answer
holds is told by the words as they are.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string
from pyspark.sql.window import Window

from quillmesh.functions import text as t
from quillmesh.functions.stem import stem, stems
from quillmesh.operators.lineage import checkpointed
from quillmesh.operators.parallel import few, spread

K1, B = 1.2, 0.75
#: Weights of a chunk's section path and of its text; share of a question's words that an answer must hold.
SECTION_WEIGHT, TEXT_WEIGHT, MIN_COVERAGE = 4, 1, 0.6

WORD = re.compile("[A-Za-z0-9_]+")
#: Bytes of texts whose words are counted at a time; terms of questions that go to every task, once they are counted.
TOGETHER, FEW_TERMS = 4 << 20, 200_000


def _words(chunks: DataFrame, key: str) -> DataFrame:
    """(chunk, s, b, dl): the words of the section path and of the text, and how many there are."""
    own = chunks.select(F.col(key).alias("chunk"), t.tokens(F.coalesce("section", F.lit(""))).alias("s"), t.tokens(F.coalesce("text", F.lit(""))).alias("b"))
    return own.withColumn("dl", F.size("s") + F.size("b"))


def postings(chunks: DataFrame, key: str, terms: DataFrame | None = None, stemmed: bool = False, scope: str | None = None) -> DataFrame:
    """(chunk, term, tf, dl): weighted occurrences, and the chunk's length; besides, a row without a term for each chunk, whose
    tf is 1. Written once, it serves all questions.

    With terms (term), of those alone. A chunk's words are counted where the chunk is read, so only its distinct terms are
    dealt out, by chunk. With scope, that column of the chunks is kept.
    """
    kept = ["chunk"] if scope is None else ["chunk", scope]
    own = chunks.select(F.col(key).alias("chunk"), *kept[1:], *[F.lower(F.coalesce(k, F.lit(""))).alias(f"_{k}") for k in ("section", "text")])
    schema = StructType([*own.schema.fields[: len(kept)], *_parse_datatype_string("dl int, term string, tf long").fields])
    arrow = to_arrow_schema(schema)
    near = None if terms is None else few(terms, FEW_TERMS)
    asked = frozenset(r.term for r in terms.collect()) if terms is not None and near is not terms else None

    def count(section: str, text: str) -> tuple[int, dict[str, int]]:
        b = Counter(WORD.findall(text))
        s = b if section == text else Counter(WORD.findall(section))
        words = {w: n * TEXT_WEIGHT for w, n in b.items()}
        for w, n in s.items():
            words[w] = words.get(w, 0) + n * SECTION_WEIGHT
        if stemmed:
            plain, words = words, {}
            for w, n in plain.items():
                w = stem(w)
                words[w] = words.get(w, 0) + n
        if asked is not None:
            words = {w: n for w, n in words.items() if w in asked}
        words[None] = 1
        return s.total() + b.total(), words

    def run(batches):
        for batch in batches:
            step = max(1, TOGETHER * batch.num_rows // max(1, batch.nbytes))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                made = [count(*x) for x in zip(part.column(len(kept)).to_pylist(), part.column(len(kept) + 1).to_pylist(), strict=True)]
                sizes = [len(w) for _, w in made]
                at = pa.array(np.repeat(np.arange(len(made)), sizes))
                dl = pa.array(np.repeat(np.array([n for n, _ in made], np.int32), sizes))
                term, tf = [w for _, ws in made for w in ws], [n for _, ws in made for n in ws.values()]
                yield pa.RecordBatch.from_arrays([*[part.column(j).take(at) for j in range(len(kept))], dl, pa.array(term, arrow.field("term").type), pa.array(tf, pa.int64())], schema=arrow)

    each = own.mapInArrow(run, schema)
    if terms is not None and asked is None:
        wanted = terms.select("term").unionByName(terms.sparkSession.createDataFrame([(None,)], "term string"))
        each = each.join(wanted, each["term"].eqNullSafe(wanted["term"]), "left_semi")
    return each.repartition("chunk").groupBy(*kept, "dl", "term").agg(F.sum("tf").alias("tf"))


def question_words(questions: DataFrame, key: str) -> DataFrame:
    """(question, term): each content word once; where questions have a `model`, without its words."""
    drop = t.tokens(F.coalesce("model", F.lit(""))) if "model" in questions.columns else None
    return questions.select(F.col(key).alias("question"), F.explode(F.array_distinct(t.question_terms(F.col("text"), drop))).alias("term"))


def search(chunks: DataFrame, questions: DataFrame, chunk_key: str, question_key: str, k: int, stemmed: bool = False, allowed: DataFrame | None = None) -> DataFrame:
    """(question, place, chunk, score): ascending scores (best first), ties by chunk.

    First the max(10 k, 30) best by BM25, then only those that hold enough of the question's words, then the first k: the
    order of these steps is part of the meaning. allowed (question, document, or another column of the chunks): only chunks of
    these documents are ranked; a question without a row there has no answer.

    Terms lie with their chunk, so a chunk's scores are sums in one task, which passes on the first of each question alone.
    """
    scope = next((k for k in allowed.columns if k != "question"), None) if allowed is not None else None
    words = checkpointed(question_words(questions, question_key))
    asked = words.select("question", F.explode(stems(F.array("term"))).alias("term")).distinct() if stemmed else words
    chunks = spread(chunks)
    own = checkpointed(postings(chunks, chunk_key, checkpointed(asked.select("term").distinct()), stemmed, scope))  # read twice, made once
    each, times = own.where("term is null"), F.sum("tf")
    lengths = each.agg(times.alias("n"), (F.sum(F.col("tf") * F.col("dl")) / times).alias("mean"))
    df = own.where("term is not null").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    weighed = few(checkpointed(asked.join(df, "term")), FEW_TERMS)
    matched = own.join(weighed, "term")
    if allowed is not None:
        matched = matched.join(few(checkpointed(allowed), FEW_TERMS), ["question", scope], "left_semi")
    idf = F.greatest(F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("mean")))
    scored = matched.join(F.broadcast(lengths)).groupBy("question", "chunk").agg((-F.sum(weight)).alias("score"), F.count(F.lit(1)).alias("have"))  # one row
    first = scored.withColumn("_place", F.row_number().over(Window.partitionBy("question").orderBy(F.round("score", 9), "chunk"))).where(F.col("_place") <= max(10 * k, 30))
    if stemmed:  # the words as they are, of the few chunks that are left
        held = _words(chunks.join(first.select(F.col("chunk").alias(chunk_key)).distinct(), chunk_key, "left_semi"), chunk_key).select("chunk", F.explode(F.array_union("s", "b")).alias("term"))
        found = first.select("question", "chunk").join(words, "question").join(held, ["chunk", "term"]).groupBy("question", "chunk").agg(F.count(F.lit(1)).alias("have"))
        first = first.drop("have").join(found, ["question", "chunk"])
    need = words.groupBy("question").agg(F.greatest(F.lit(1), F.ceil(F.round(MIN_COVERAGE * F.count(F.lit(1)), 9))).alias("need"))
    kept = first.join(need, "question").where("have >= need")
    place = F.row_number().over(Window.partitionBy("question").orderBy("_place"))
    return kept.select("question", place.alias("place"), "chunk", "score").where(F.col("place") <= k)


def judged(found: DataFrame, chunks: DataFrame, cases: DataFrame, chunk_key: str, case_key: str) -> DataFrame:
    """question, hits, rank, verdict of search cases (case_key, phrase): the place of the first answer whose text holds the
    phrase, capitals or not. A case without a phrase must find nothing, and is told (info), not scored."""
    text = chunks.select(F.col(chunk_key).alias("chunk"), F.lower(F.coalesce("text", F.lit(""))).alias("_text"))
    own = cases.select(F.col(case_key).alias("question"), F.lower("phrase").alias("_phrase"))
    hits = found.select("question", "place", "chunk").join(text, "chunk").join(own, "question")
    per = hits.groupBy("question").agg(F.count(F.lit(1)).alias("hits"), F.min(F.when(F.col("_text").contains(F.col("_phrase")), F.col("place"))).alias("rank"))
    verdict = F.when(F.col("_phrase").isNull(), "info").when(F.col("rank").isNull(), "missed").otherwise("found")
    return own.join(per, "question", "left").select("question", F.coalesce("hits", F.lit(0)).alias("hits"), "rank", verdict.alias("verdict"))
