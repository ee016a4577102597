"""D1-D8: hash, point id, in-batch and index dedup with tenant rules."""

import hashlib
import uuid

from pyspark.sql import functions as F

from docyard.functions.hashing import chunk_hash, point_id
from docyard.operators import dedup as D

SCHEMA = "text string, doc_id string, chunk_index int, source_path string, tenant_id string"


def chunks(spark, rows):
    return D.with_identity(spark.createDataFrame(rows, SCHEMA))


def index(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, chunk_hash string")


def h(t):
    return hashlib.sha256(t.encode()).hexdigest()


def test_hash_and_point_id(spark):
    texts = ["same text", "same text", "other", "ünïcødé ✓"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(chunk_hash("t").alias("h"), point_id(chunk_hash("t")).alias("p")).collect()
    ns = uuid.UUID("6ba7b810-9dad-11d1-80b4-00c04fd430c8")
    for t, r in zip(texts, rows):
        assert r["h"] == h(t)
        assert r["p"] == str(uuid.uuid5(ns, h(t)))
    assert rows[0]["p"] == rows[1]["p"]


def test_existing_hash_skipped_without_tenant(spark):
    c = chunks(spark, [("one", "d", 0, "a", None), ("two", "d", 1, "a", None)])
    new = D.filter_new_chunks(c, index(spark, [("tenant-x", h("one"))]))
    assert [r["text"] for r in new.collect()] == ["two"]


def test_in_batch_first_wins(spark):
    c = chunks(spark, [("dup", "d2", 0, "b.md", "t"), ("dup", "d1", 0, "a.md", "t"), ("x", "d1", 1, "a.md", "t")])
    new = D.filter_new_chunks(c, index(spark, []))
    got = sorted((r["text"], r["source_path"]) for r in new.collect())
    assert got == [("dup", "a.md"), ("x", "a.md")]
    counts = D.skipped_counts(c, new, by=("tenant_id",)).first()
    assert (counts["total_chunk_count"], counts["new_chunk_count"], counts["skipped_count"]) == (3, 2, 1)


def test_tenant_scoped_index(spark):
    c = chunks(spark, [("shared", "d", 0, "a", "tenant-a"), ("shared", "d", 0, "a", "tenant-b")])
    new = D.filter_new_chunks(c, index(spark, [("tenant-a", h("shared"))]))
    assert [r["tenant_id"] for r in new.collect()] == ["tenant-b"]


def test_empty_tenant_is_null_group(spark):
    c = chunks(spark, [("z", "d", 0, "a", ""), ("z", "d", 1, "a", None), ("z", "d", 2, "a", "t")])
    new = D.filter_new_chunks(c, None)
    assert sorted((r["tenant_id"] or "") for r in new.collect()) == ["", "t"]
    # NULL-tenant chunk is a duplicate if any tenant holds the hash
    new2 = D.filter_new_chunks(c, index(spark, [("other", h("z"))]))
    assert [r["tenant_id"] for r in new2.collect()] == ["t"]


def test_existing_semi_join_and_grouping(spark):
    c = chunks(spark, [("p", "d", 0, "a", "t"), ("q", "d", 1, "a", "t"), ("p", "d", 2, "a", None)])
    ex = D.existing_in_index(c, index(spark, [("t", h("p"))]))
    assert sorted(r["chunk_index"] for r in ex.collect()) == [0, 2]
    g = {r["tenant_id"]: r["distinct_hashes"] for r in D.hashes_by_tenant(c).collect()}
    assert g == {"t": 2, None: 1}


def test_dedup_plan_has_no_nested_loop(spark):
    c = chunks(spark, [("p", "d", 0, "a", "t")])
    plan = D.filter_new_chunks(c, index(spark, [("t", h("p"))]))._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
