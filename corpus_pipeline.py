"""The corpus pipeline: toxic documents go, one document of each group of near copies stays, documents with benchmark
passages go, personal data is masked, and what is left is encoded.

Each stage works on all that the one before it kept; run() applies them to the documents of a folder, writing each
stage's result to the shared folder and reading it again, so that a lost executor costs no more than its stage.

Cases, of every stage: a null text counts as empty (not toxic, a copy of other empty texts, without passages or personal data,
no ids); very long texts are worked on whole; repeated rows of one id and text are copies; a null doc_id is the largest; an
empty table gives an empty table; extra columns come back whatever their names and types, but for ids and n_tokens, which the
last stage writes. Without labels nothing is toxic, without a benchmark nothing is contaminated.

Near copies: the stage links SimHash fingerprints of five-word shingles by the pigeonring; within four bits these are only part of
the pairs of similarity 0.8, so bands of minima add the others as candidates, and the shingle sets decide; see
quillmesh/llm/nearcopies.py and the README.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quillmesh.llm import bpe, decontaminate, nearcopies, pii, toxicity
from quillmesh.llm.common import checkpointed, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled examples do not call toxic."""
    return toxicity.accepted(docs, toxicity.train(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that similarities of 0.8 or more, over shingles of five words, link."""
    return nearcopies.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind."""
    return pii.redacted(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text in place of the text."""
    return bpe.tokenised(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("decontaminate", drop_contaminated),
    ("pii", mask_personal_data),
    ("bpe", encode),
]

#: SQL expresses neither the classifier nor the network; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = checkpointed(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
