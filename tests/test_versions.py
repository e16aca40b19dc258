"""Committed tables: versions, conflicts, repeated runs, failures."""

import pytest
from pyspark.sql import functions as F

from quillmesh.sinks.versions import Conflict, VersionedTable, ingested


def new(spark, tmp_path, **kw):
    return VersionedTable(spark, f"file://{tmp_path}/t", "id long, value string", "id", **{"buckets": 4, **kw})


def rows(spark, *values):
    return spark.createDataFrame(values, "id long, value string, seq int")


def held(t, version=None):
    return sorted(map(tuple, t.read(version).collect()))


def test_versions_upserts_and_deletions(spark, tmp_path):
    t = new(spark, tmp_path)
    assert held(t) == [] and t.versions() == []
    t.upsert(rows(spark, (1, "a", 0), (2, "b", 0), (2, "c", 1)), "seq")
    t.upsert(rows(spark, (2, None, 0), (3, "d", 0)), "seq")
    assert held(t) == [(1, "a"), (2, None), (3, "d")] and held(t, 1) == [(1, "a"), (2, "c")]
    t.delete(spark.createDataFrame([(1,), (9,), (None,)], "id long"))
    assert held(t) == [(2, None), (3, "d")] and t.versions() == [1, 2, 3]
    assert t.upsert(rows(spark), "seq").version == 3 and t.versions() == [1, 2, 3]
    with pytest.raises(ValueError, match="null"):
        t.upsert(rows(spark, (None, "x", 0)), "seq")


def test_only_touched_buckets_are_written(spark, tmp_path):
    t = new(spark, tmp_path, buckets=16)
    first = t.upsert(spark.range(200).select("id", F.lit("x").alias("value"), F.lit(0).alias("seq")), "seq")
    second = t.upsert(rows(spark, (5, "y", 0)), "seq")
    assert len(first.folders) == 16 and sum(second.folders[b] != first.folders[b] for b in first.folders) == 1
    assert t.read().count() == 200


def test_two_writers_from_one_version_conflict(spark, tmp_path):
    t = new(spark, tmp_path)
    base = t.upsert(rows(spark, (1, "a", 0)), "seq")
    t.upsert(rows(spark, (1, "mine", 0)), "seq", base=base)
    with pytest.raises(Conflict):
        t.upsert(rows(spark, (1, "theirs", 0)), "seq", base=base)
    assert held(t) == [(1, "mine")]
    assert len(t.swept()) == 2 and held(t) == [(1, "mine")]


def test_a_repeated_run_is_harmless(spark, tmp_path):
    t = new(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 0)), "seq", token="monday")
    assert t.upsert(rows(spark, (1, "b", 0)), "seq", token="monday").version == 1 and held(t) == [(1, "a")]
    assert t.delete(spark.createDataFrame([(1,)], "id long"), token="monday").version == 1


def test_a_failed_job_leaves_the_version_before(spark, tmp_path):
    t = new(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 0)), "seq")
    bad = spark.createDataFrame([(2, "b", 0)], "id long, value string, seq int").withColumn("value", F.udf(lambda v: 1 / 0, "string")("value"))
    with pytest.raises(Exception, match="division"):
        t.upsert(bad, "seq")
    assert held(t) == [(1, "a")] and t.versions() == [1]
    t.upsert(rows(spark, (2, "b", 0)), "seq")
    assert held(t) == [(1, "a"), (2, "b")]


def test_the_lock_of_a_dead_writer_counts_for_nothing(spark, tmp_path, monkeypatch):
    t = new(spark, tmp_path)
    t.upsert(rows(spark, (1, "a", 0)), "seq")
    (tmp_path / "t" / "versions" / "000000000002.json.lock").write_bytes(b"")
    with pytest.raises(Conflict):
        t.upsert(rows(spark, (2, "b", 0)), "seq")
    monkeypatch.setattr("quillmesh.sinks.versions.STALE_SECONDS", -1)
    assert t.upsert(rows(spark, (2, "b", 0)), "seq").version == 2 and held(t) == [(1, "a"), (2, "b")]


def test_ingest_by_hash(spark, tmp_path):
    t = VersionedTable(spark, f"file://{tmp_path}/d", "doc long, sha256 string, text string", "doc", 4)
    docs = lambda *r: spark.createDataFrame(r, "doc long, text string")
    ingested(t, docs((1, "x"), (2, "y")))
    m, states = ingested(t, docs((1, "x"), (2, "z"), (3, "w")))
    assert {r.doc: r.state for r in states.collect()} == {1: "unchanged", 2: "replaced", 3: "added"} and m.version == 2
    assert ingested(t, docs((1, "x")))[0].version == 2
    assert sorted((r.doc, r.text) for r in t.read().collect()) == [(1, "x"), (2, "z"), (3, "w")]
