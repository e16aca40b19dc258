"""Words of chunks are counted where chunks are read; the shuffle holds the questions' terms alone."""

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import fulltext


@pytest.mark.parametrize("most", [0, 1000])
def test_postings_are_counted_in_batches_and_tell_every_chunk(spark, monkeypatch, most):
    monkeypatch.setattr(fulltext, "FEW_TERMS", most)
    chunks = spark.createDataFrame([(1, "Fuse fuse", "the FUSE\nis out"), (2, None, "nothing"), (3, "a", None), (4, "fuse", "fuse")], "id long, section string, text string")
    terms = spark.createDataFrame([("fuse",), ("out",)], "term string")
    own = fulltext.postings(chunks, "id", terms)
    assert "MapInArrow" in own._jdf.queryExecution().executedPlan().toString()
    got = {(r.chunk, r.term): (r.tf, r.dl) for r in own.collect()}
    assert got == {(1, "fuse"): (9, 6), (1, "out"): (1, 6), (4, "fuse"): (5, 2), (1, None): (1, 6), (2, None): (1, 1), (3, None): (1, 1), (4, None): (1, 2)}


def test_questions_may_be_held_to_any_column_of_the_chunks(spark):
    chunks = spark.createDataFrame([(1, "en", "", "red fuse box"), (2, "de", "", "red fuse"), (3, "en", "", "a blue box"), (4, "en", "", "green"), (5, "en", "", "grey")], "id long, lang string, section string, text string")
    asked = spark.createDataFrame([(10, "red fuse"), (11, "red fuse")], "q long, text string")
    allowed = spark.createDataFrame([(10, "de"), (10, "de")], "question long, lang string")
    got = fulltext.search(chunks, asked, "id", "q", 3, allowed=allowed).where(F.col("score") < 0).collect()
    assert [(r.question, r.place, r.chunk) for r in got] == [(10, 1, 2)]
