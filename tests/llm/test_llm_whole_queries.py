"""Registered queries return the whole table."""

from quillmesh.llm.queries import QUERIES


def test_suffixes_keep_a_row_of_every_document(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = QUERIES["op2_suffixes"](spark, sf)
    assert sorted(r.doc_id for r in got.select("doc_id").collect()) == sorted(r.doc_id for r in docs.select("doc_id").collect())
    assert got.where("n_removed = 0").count() > 0 and got.where("kept_sha256 is null").count() == 0
