"""Own cleaning steps, rows of files, names of streamed runs, models that fail now and then."""

import pytest
from pyspark.sql import functions as F

from docyard.functions.text import normalize_whitespace
from docyard.operators.clean import clean_text, python_step
from docyard.operators.embed import RetryPolicy, embed
from docyard.plans.flows import LETTERS, letter_model, spelled
from docyard.sources.tables import with_file_rows
from docyard.streaming.incremental import run_name


def test_python_step_runs_between_built_in_ones(spark):
    df = spark.createDataFrame([(1, " a  & qu "), (2, None), (3, "")], "k int, content string")
    got = {r["k"]: r["content"] for r in clean_text(df, "content", [normalize_whitespace, python_step(spelled), F.upper]).collect()}
    assert got == {1: "A  AND  KW", 2: None, 3: ""}


def test_rows_of_several_files_have_places(spark, tmp_path):
    spark.range(100).repartition(4).write.parquet(f"{tmp_path}/t")
    rows = with_file_rows(spark.read.parquet(f"{tmp_path}/t")).collect()
    assert len({(r["file_name"], r["file_row"]) for r in rows}) == 100 and len({r["file_name"] for r in rows}) == 4
    assert all(r["file_size"] > 0 for r in rows)


def test_a_stream_begun_again_has_run_names_of_its_own():
    assert run_name("/a/progress", 0) == run_name("/a/progress/", 0)
    assert len({run_name("/a/one", 0), run_name("/a/two", 0), run_name("/a/one", 1)}) == 3


def test_stream_over_a_new_checkpoint_leaves_done_jobs(spark, tmp_path):
    """Both streams' jobs end as done: the second one's events are not taken for the first one's jobs."""
    from docyard.config import IngestConfig
    from docyard.sinks.jobs import current_jobs, validate_transitions
    from docyard.streaming.incremental import incremental_ingest
    docs = spark.createDataFrame([("d", "some words of a text", "t", "p.txt")],
                                 "doc_id string, content string, tenant_id string, source_path string")
    docs.write.parquet(f"{tmp_path}/in")
    cfg = IngestConfig(min_content_chars=1, target_language=None)
    for n in range(2):
        q = incremental_ingest(spark, f"{tmp_path}/in", docs.schema, f"{tmp_path}/points", f"{tmp_path}/progress-{n}",
                               lambda b: b, cfg, jobs_path=f"{tmp_path}/jobs")
        assert q.awaitTermination(200)
    events = validate_transitions(spark.read.parquet(f"{tmp_path}/jobs"))
    assert events.filter("not valid").count() == 0
    assert sorted((r["status"], r["chunk_count"], r["skipped_count"]) for r in current_jobs(events).collect()) == [
        ("done", 0, 1), ("done", 1, 0)]


def test_a_model_that_fails_is_retried_and_checked(spark):
    df = spark.createDataFrame([(k, "a e i " * k) for k in range(600)], "k int, text string").coalesce(1)
    width = 2 + len(LETTERS)
    out = embed(df, model_factory=letter_model, vector_size=width, batch_size=256, retry=RetryPolicy(min_wait=0.0))
    for r in out.collect():
        assert r["embedding"][:4] == [6.0 * r["k"], 3.0 * r["k"], float(r["k"]), float(r["k"])]
    with pytest.raises(Exception, match="not ready yet"):
        embed(df, model_factory=letter_model, vector_size=width, retry=None).collect()


def test_rows_without_ids_are_ordered_by_their_place_in_the_files(spark, tmp_path):
    """Of equal chunks the first row of the first file stays, however Spark reads the files."""
    from docyard.operators import dedup as D
    for name in "ba":
        spark.createDataFrame([("t", "dup", f"{name}{k}") for k in range(3)], "tenant_id string, text string, mark string") \
             .coalesce(1).write.parquet(f"{tmp_path}/in/part={name}")
    rows = D.with_identity(with_file_rows(spark.read.parquet(f"{tmp_path}/in").withColumnRenamed("part", "folder")))
    for parts in (1, 5):
        kept = D.first_in_batch(rows.repartition(parts), ("folder", "file_name", "file_row")).collect()
        assert [r["mark"] for r in kept] == ["a0"]
