"""Versions of an index share the buckets that an update does not touch."""

import pytest
from pyspark.sql import functions as F

from casebook.plans.versions import BucketedIndex, bucket


def parts(spark, rows):
    passages = spark.createDataFrame([(d, i, f"{t} {i}") for d, t in rows for i in range(2)], "doc_id bigint, chunk_index int, content string")
    facts = spark.createDataFrame([(d, t) for d, t in rows if d % 2], "doc_id bigint, value string")
    return {"chunks": passages, "facts": facts}


def content(spark, index, version):
    chunks = sorted((r.doc_id, r.chunk_index, r.content) for r in index.read(spark, "chunks", version).collect())
    return chunks, sorted((r.doc_id, r.value) for r in index.read(spark, "facts", version).collect())


def wanted(rows):
    return sorted((d, i, f"{t} {i}") for d, t in rows for i in range(2)), sorted((d, t) for d, t in rows if d % 2)


def test_updates_rewrite_touched_buckets_only(spark, tmp_path):
    index = BucketedIndex(str(tmp_path / "index"), buckets=16)
    first = [(d, "old") for d in range(200)]
    assert index.update("v1", parts(spark, first)) == set(range(16))
    gone = spark.createDataFrame([(4,), (999,)], "doc_id bigint")
    hit = {r[0] for r in spark.createDataFrame([(3,), (4,), (300,), (999,)], "doc_id bigint").select(bucket(F.col("doc_id"), 16)).collect()}
    assert index.update("v2", parts(spark, [(3, "new"), (300, "new")]), gone) == hit and len(hit) <= 4
    second = [(d, "new" if d == 3 else "old") for d in range(200) if d != 4] + [(300, "new")]
    assert content(spark, index, "v1") == wanted(first) and content(spark, index, None) == wanted(second)
    paths = {v: {(r.part, r.bucket): r.path for r in index.manifest(spark, v)} for v in ("v1", "v2")}
    changed = {b for (_, b), path in paths["v2"].items() if path != paths["v1"][_, b]}
    assert changed == hit
    # a version that nothing was published of is never seen
    assert index.version(spark) == "v2"
    assert index.vacuum(spark, ["v2"]) > 0 and content(spark, index, "v2") == wanted(second)
    with pytest.raises(ValueError, match="every part"):
        index.update("v3", {"chunks": index.read(spark, "chunks")})


def test_a_bucket_may_become_empty(spark, tmp_path):
    index = BucketedIndex(str(tmp_path / "index"), buckets=4)
    rows = [(1, "a"), (2, "b")]
    index.update("v1", parts(spark, rows))
    index.update("v2", parts(spark, []), spark.createDataFrame([(1,), (2,)], "doc_id bigint"))
    assert content(spark, index, "v2") == ([], []) and content(spark, index, "v1") == wanted(rows)
    index.update("v3", parts(spark, [(5, "c")]))
    assert content(spark, index, "v3") == wanted([(5, "c")])
