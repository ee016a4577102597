"""Plan-shape and skew checks: what must hold at any scale."""

import hashlib

from pyspark.sql import functions as F

from docyard.functions import text as T
from docyard.operators import dedup as D


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_hot_hash_dedup_is_exact_and_trimmed_map_side(spark):
    # one chunk text holds a third of all rows
    n = 3000
    rows = [("hot" if i % 3 == 0 else f"t{i}", "d", i, f"p{i:05d}", "tenant") for i in range(n)]
    c = D.with_identity(spark.createDataFrame(rows, "text string, doc_id string, chunk_index int, "
                                                    "source_path string, tenant_id string").repartition(8))
    new = D.filter_new_chunks(c, None)
    assert new.count() == n - n // 3 + 1
    assert new.filter(F.col("text") == "hot").first()["source_path"] == "p00000"
    assert "partial_min" in _plan(D.first_keys(c))
    counts = D.in_batch_counts(c).first()
    assert (counts["total_chunk_count"], counts["new_chunk_count"]) == (n, n - n // 3 + 1)
    assert "partial_count" in _plan(D.in_batch_counts(c))


def test_dedup_decides_on_narrow_rows(spark):
    """No exchange of the decision carries text, and the chunks are grouped once."""
    import re
    from docyard.operators import chunking as K
    docs = spark.createDataFrame([(k, "word " * 50, "t", f"p{k}") for k in range(40)],
                                 "doc_id int, content string, tenant_id string, source_path string")
    chunks = D.with_identity(K.chunk_fixed(docs, 20, 0.1))
    index = spark.createDataFrame([("t", "x")], "tenant_id string, chunk_hash string")
    keys = D.new_keys(D.first_keys(chunks), index)
    keys.explain("formatted")
    plan = keys._jdf.queryExecution().executedPlan().toString()
    assert len(re.findall(r"partial_min", plan)) == 1 and "Window" not in plan
    below = keys._jdf.queryExecution().toString()
    assert keys.columns == ["_t", "_h", "_o", "_n"]
    for line in below.split("== Physical Plan ==")[1].splitlines():
        if "Exchange" in line:
            assert "text#" not in line and "content#" not in line


def test_costly_column_evaluated_once(spark):
    df = spark.createDataFrame([(1, "  a  b \n\n c "), (2, "x")], "id int, content string").repartition(4, "id")
    out = T.with_column_where(df, "content", T.normalize_whitespace("content"), lambda c: F.length(c) >= 3)
    plan = _plan(out)                          # before execution: one (initial) plan
    assert plan.count("[ \\t]+") == 1          # the white-space rule appears once in the plan
    assert [r["content"] for r in out.collect()] == ["a b\n\nc"]


def test_index_anti_join_uses_distinct_hashes_for_null_tenant(spark):
    h = hashlib.sha256(b"z").hexdigest()
    c = D.with_identity(spark.createDataFrame([("z", "d", 0, "a", None)], "text string, doc_id string, "
                                              "chunk_index int, source_path string, tenant_id string"))
    idx = spark.createDataFrame([(f"t{i}", h) for i in range(50)], "tenant_id string, chunk_hash string")
    assert D.new_against_index(c, idx).count() == 0
    assert "NestedLoop" not in _plan(D.new_against_index(c, idx))


def test_no_python_udf_evaluated_twice_in_any_query(spark):
    """Every registered query calls each Python UDF in one evaluation node only
    (a copy pushed below another operator would run it twice)."""
    import re
    import __spark_entry__ as E
    for name, fn in E.queries().items():
        plan = _plan(fn(spark, "/root/testdata/sf0.001"))
        udfs = re.findall(r"(?:ArrowEvalPython|BatchEvalPython) \[(\w+)\(", plan)
        assert len(udfs) == len(set(udfs)), (name, udfs)
