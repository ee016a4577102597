"""E1-E5 embedding, X1/X2/X4 search, C6-C8 language, F1/F2 ingest, T1 incremental ingest."""

import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from docyard.config import IngestConfig
from docyard.operators import embed as E
from docyard.operators.search import assemble_context, cosine_topk, recall_at_k

SMOKE = "/root/testdata/sf0.001"


def test_default_embedding_is_signed_hashing(spark):
    import hashlib
    import re

    texts = [("c0", "alpha Beta beta"), ("c1", "gamma é1"), ("c2", "beta alpha  BETA"), ("c3", ""), ("c4", None)]
    df = spark.createDataFrame(texts, "id string, text string")
    got = {r["id"]: r["embedding"] for r in E.embed(df, batch_size=2, vector_size=8).collect()}
    for k, text in texts:
        want = np.zeros(8)
        for word in re.findall(r"\w+", (text or "").lower()):
            h = hashlib.md5(word.encode()).hexdigest()
            want[int(h[:8], 16) % 8] += 1 if h[8] < "8" else -1
        norm = np.linalg.norm(want)
        assert np.allclose(got[k], want / norm if norm else want)
    assert E.embed(df.limit(0), batch_size=2).count() == 0
    assert E.embed(df, vector_size=8, max_concurrency=2).rdd.getNumPartitions() == 2


def test_own_model_is_batched_and_aligned(spark):
    def factory():
        return lambda texts: np.array([[len(t), 1.0] for t in texts])

    df = spark.createDataFrame([(k, "x" * k) for k in range(1, 12)], "id int, text string")
    got = {r["id"]: r["embedding"] for r in E.embed(df, model_factory=factory, vector_size=2, batch_size=3).collect()}
    assert got == {k: [float(k), 1.0] for k in range(1, 12)}


def test_embed_argument_checks():
    with pytest.raises(ValueError, match="embed_batch_size must be greater than 0"):
        E.embed(None, batch_size=0)
    with pytest.raises(ValueError, match="embed_max_concurrency must be greater than 0"):
        E.embed(None, max_concurrency=0)


def test_cardinality_and_width_checks():
    bad = E.checked_predict(lambda t: np.zeros((len(t) - 1, 4)), 4, None)
    with pytest.raises(ValueError, match="Embedder returned 1 vectors for 2 chunks in batch 1"):
        bad(np.array(["a", "b"], dtype=object))
    wide = E.checked_predict(lambda t: np.zeros((len(t), 5)), 4, None)
    with pytest.raises(ValueError, match="width 5"):
        wide(np.array(["a"], dtype=object))


def test_retry_then_succeed():
    calls = {"n": 0}

    def flaky(texts):
        calls["n"] += 1
        if calls["n"] == 1:
            raise ConnectionError("transient")
        return np.ones((len(texts), 3))

    waits = []
    policy = E.RetryPolicy(attempts=5, min_wait=1, max_wait=60)
    out = policy.call(flaky, np.array(["x"], dtype=object), sleep=waits.append)
    assert calls["n"] == 2 and out.shape == (1, 3) and waits == [1]
    with pytest.raises(ValueError):
        E.RetryPolicy().call(lambda: (_ for _ in ()).throw(ValueError("not transient")), sleep=waits.append)


def test_l2_normalize(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],)], "v array<double>")
    rows = df.select(E.l2_normalize("v").alias("u")).collect()
    assert np.allclose(rows[0]["u"], [0.6, 0.8]) and rows[1]["u"] == [0.0, 0.0]


def test_cosine_topk_brute_force(spark):
    rng = np.random.default_rng(5)
    vecs = rng.normal(size=(300, 8))
    qs = rng.normal(size=(7, 8))
    corpus = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "vec_id long, embedding array<double>")
    queries = spark.createDataFrame([(100 + j, q.tolist()) for j, q in enumerate(qs)], "query_id long, embedding array<double>")
    got = cosine_topk(corpus.repartition(5), queries, k=4, shards=3).collect()
    vn = vecs / np.linalg.norm(vecs, axis=1, keepdims=True)
    for j, q in enumerate(qs):
        s = vn @ (q / np.linalg.norm(q))
        want = list(np.lexsort((np.arange(len(s)), -s))[:4])
        mine = [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == 100 + j), key=lambda r: r["rank"])]
        assert mine == want
    ranked = spark.createDataFrame([(1, 0, 1), (1, 2, 2)], "query_id long, vec_id long, rank int")
    texts = spark.createDataFrame([(0, "first"), (2, "second")], "vec_id long, text string")
    assert assemble_context(ranked, texts).first()["context"] == "first\n\nsecond"
    gold = spark.createDataFrame([(1, 2), (1, 9)], "query_id long, vec_id long")
    r = recall_at_k(ranked, gold, 2).first()
    assert (r["hits"], r["gold_count"], r["recall"], r["precision"]) == (1, 2, 0.5, 0.5)


def test_topk_over_stored_points_by_tenant(spark):
    """Any id type; a query only sees its tenant; equal scores go to the smaller id."""
    rows = [(f"id-{k:02d}", "ab"[k % 2], [1.0, float(k % 4)]) for k in range(20)]
    corpus = spark.createDataFrame(rows, "point_id string, tenant_id string, embedding array<double>")
    queries = spark.createDataFrame([("q1", "a", [1.0, 0.0]), ("q2", "b", [1.0, 3.0]), ("q3", "none", [1.0, 0.0])],
                                    "query_id string, tenant_id string, embedding array<double>")
    got = cosine_topk(corpus, queries, 3, id_col="point_id", tenant_col="tenant_id").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["point_id"]) for r in got] == [("q1", "id-00"), ("q1", "id-04"), ("q1", "id-08"),
                                                             ("q2", "id-03"), ("q2", "id-07"), ("q2", "id-11")]


@pytest.fixture(scope="module")
def lang_model(spark):
    from docyard.operators.language import fit_language_model
    from docyard.sources.tables import read_table
    return fit_language_model(read_table(spark, SMOKE, "documents"), "text", "lang")


def test_language_detection(spark, lang_model):
    from docyard.operators.language import detect_language
    from docyard.sources.tables import read_table
    d = read_table(spark, SMOKE, "documents")
    out = detect_language(d, lang_model, "text", 0.9).select("lang", "language").collect()
    agree = sum(r["lang"] == r["language"] for r in out)
    assert agree >= 0.95 * len(out)
    empty = spark.createDataFrame([("   ",), ("",)], "text string")
    assert [r["language"] for r in detect_language(empty, lang_model, "text").collect()] == [None, None]


def test_language_scores_equal_the_formula(spark, lang_model):
    """Against plain counting; equal samples are scored once, texts too short or without letters not at all."""
    import math
    from collections import Counter
    from docyard.operators.language import detect_language, train_profile
    from docyard.sources.tables import read_table

    counts = Counter({(r["lang"], r["gram"]): r["n"] for r in
                      train_profile(read_table(spark, SMOKE, "documents")).collect()})
    languages = sorted({lang for lang, _ in counts})
    size = len({g for _, g in counts})
    total = {x: sum(n for (lang, _), n in counts.items() if lang == x) for x in languages}
    texts = [" the onhe ßx and ", "und die Straße  und die", "qqq zzz", "a", "12 34", None, "the the the"] + ["the onhe ßx and"] * 5
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string").withColumn("language", F.lit("old"))
    out = detect_language(df, lang_model, "text", 0.0, confidence_col="sure")
    assert out.columns == ["k", "text", "language", "sure"]
    got = {r["k"]: (r["language"], r["sure"]) for r in out.collect()}
    assert len(got) == len(texts) and got[4] == got[5] == (None, None)
    for k, t in enumerate(texts):
        if got[k][0] is None:
            continue
        s = " " + " ".join("".join(c if c.isalpha() else " " for c in t.lower()).split()) + " "
        grams = [s[i:i + 3] for i in range(len(s) - 2)]
        score = {x: sum(math.log((counts[x, g] + 1) / (total[x] + size)) for g in grams) for x in languages}
        top = max(score, key=score.get)
        assert got[k][0] == top and math.isclose(got[k][1], 1 / sum(math.exp(w - score[top]) for w in score.values())), t


def test_language_model_stays_off_the_driver(spark, lang_model):
    """The profile is joined, on narrow rows; no Python, and the documents move once at most."""
    import re
    from docyard.operators.language import detect_language
    df = spark.createDataFrame([(1, "the text")], "k int, text string")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    for size in ("10485760", "-1"):
        before = spark.conf.get(limit)
        spark.conf.set(limit, size)
        try:
            out = detect_language(df, lang_model, "text")
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert not re.search("Python|Pandas|NestedLoop|Cartesian", plan)
            assert ("BroadcastHashJoin [gram" in plan) == (size != "-1")
            assert len(out.collect()) == 1
        finally:
            spark.conf.set(limit, before)


def test_clean_documents_drops(spark, lang_model):
    from docyard.operators.clean import clean_documents
    rows = [("too short", "en"), ("\t “A”  title \n\npage 7 of 9\n\n  body of it ", "en")]
    df = spark.createDataFrame(rows, "content string, lang string")
    cfg = IngestConfig(min_content_chars=10, target_language=None)
    assert [r["content"] for r in clean_documents(df, cfg).collect()] == ["\"A\" title\n\nbody of it"]
    assert clean_documents(df, IngestConfig(), lang_model).count() == 0
    own = IngestConfig(min_content_chars=1, target_language=None, cleaning_steps=(F.upper, F.trim))
    assert clean_documents(df, own).first()["content"] == "TOO SHORT"


def _corpus(spark):
    from docyard.sources.tables import corpus_documents
    return corpus_documents(spark, SMOKE)


def test_ingest_rerun_writes_nothing(spark, lang_model):
    from docyard.plans.ingest import ingest
    from docyard.sinks import points as P
    path = tempfile.mkdtemp(prefix="docyard-ingest-")
    jobs = tempfile.mkdtemp(prefix="docyard-jobs-") + "/events"
    first = ingest(_corpus(spark), path, IngestConfig(), lang_model, jobs_path=jobs, ingest_seq=1)
    assert first.written > 0 and P.point_count(spark, path) == first.written
    c = first.counters.agg(F.sum("chunk_count").alias("n"), F.sum("document_count").alias("d")).first()
    assert c["n"] == first.written and c["d"] == _corpus(spark).count()
    second = ingest(_corpus(spark), path, IngestConfig(), lang_model, ingest_seq=2)
    assert second.written == 0
    assert second.counters.agg(F.sum("skipped_count")).first()[0] == \
        second.counters.agg(F.sum("total_chunk_count")).first()[0]
    from docyard.sinks.jobs import current_jobs, validate_transitions
    ev = spark.read.parquet(jobs)
    cur = current_jobs(validate_transitions(ev))
    assert cur.filter(F.col("status") != "done").count() == 0


def test_incremental_ingest(spark, lang_model):
    from docyard.sinks import points as P
    from docyard.streaming.incremental import incremental_ingest
    from docyard.sources.tables import read_table
    src = tempfile.mkdtemp(prefix="docyard-src-")
    raw = read_table(spark, SMOKE, "documents")
    raw.repartition(3, "doc_id").write.mode("overwrite").parquet(src + "/in")
    path = tempfile.mkdtemp(prefix="docyard-stream-")

    def to_docs(b):
        return b.select("doc_id", F.col("text").alias("content"), F.col("source").alias("tenant_id"),
                        F.format_string("%s/%08d.txt", "source", "doc_id").alias("source_path"))

    q = incremental_ingest(spark, src + "/in", raw.schema, path, tempfile.mkdtemp(prefix="docyard-ck-"),
                           to_docs, IngestConfig(), lang_model, max_files_per_trigger=1)
    q.awaitTermination(600)
    streamed = P.point_count(spark, path)
    assert streamed > 0
    q2 = incremental_ingest(spark, src + "/in", raw.schema, path, tempfile.mkdtemp(prefix="docyard-ck-"),
                            to_docs, IngestConfig(), lang_model, max_files_per_trigger=5)
    q2.awaitTermination(600)
    assert P.point_count(spark, path) == streamed


def test_ingest_reports_stage_times(spark, lang_model):
    from docyard.plans.ingest import ingest
    path = tempfile.mkdtemp(prefix="docyard-ingest-")
    jobs = tempfile.mkdtemp(prefix="docyard-jobs-") + "/events"
    res = ingest(_corpus(spark).limit(20), path, IngestConfig(), lang_model, ingest_seq=1, jobs_path=jobs)
    assert set(res.stage_seconds) == {"chunks", "dedup", "embed_write"}
    assert all(v >= 0 for v in res.stage_seconds.values())
    # the trail holds them, too: times and rows as the writes themselves counted them
    ended = [r for r in res.job_events.collect() if r["status"] == "done"]
    total = res.counters.agg(F.sum("total_chunk_count")).first()[0]
    assert ended and all(set(r["stage_ms"]) == {"chunks", "dedup", "embed_write"} and
                         r["stage_rows"] == {"chunks": total, "written": res.written} for r in ended)


def test_ingest_semantic_strategy(spark, lang_model):
    from docyard.plans.ingest import ingest
    from docyard.sinks import points as P
    path = tempfile.mkdtemp(prefix="docyard-ingest-")
    cfg = IngestConfig(chunker_strategy="semantic", chunk_size_tokens=128)
    res = ingest(_corpus(spark).limit(30), path, cfg, lang_model, ingest_seq=1)
    pts = P.read_points(spark, path)
    assert res.written == pts.count() > 0
    assert pts.filter(F.col("chunk_strategy") != "semantic").count() == 0


def test_ingest_of_files_with_a_bad_one(spark):
    """Rejects end as failed jobs with their message, the others are done; ids and page order are kept."""
    import os

    from docyard.plans.ingest import ingest
    from docyard.sinks import points as P
    from docyard.sinks.jobs import current_jobs, validate_transitions
    from docyard.sources.loaders import load_files
    root = tempfile.mkdtemp(prefix="docyard-files-")
    for name, data in {"a.md": b"# A\nsome words of text here", "b.md": b"\xff\xfe", "c.pdf": b"%PDF",
                       "d.html": b"<body>some other words</body>"}.items():
        with open(f"{root}/{name}", "wb") as fh:
            fh.write(data)
    path, jobs = tempfile.mkdtemp(prefix="docyard-pts-"), tempfile.mkdtemp(prefix="docyard-jobs-") + "/events"
    cfg = IngestConfig(min_content_chars=1, target_language=None, extra={"origin": "test"})
    res = ingest(load_files(spark, root, "t"), path, cfg, jobs_path=jobs)
    assert res.written == 2
    stored = P.read_points(spark, path).collect()
    assert all(len(r["doc_id"]) == 64 and r["extra"] == {"origin": "test"} for r in stored)
    ended = {os.path.basename(r["source_path"]): (r["status"], r["error_message"], r["chunk_count"])
             for r in current_jobs(validate_transitions(spark.read.parquet(jobs))).collect()}
    assert ended["a.md"] == ("done", None, 1) and ended["d.html"] == ("done", None, 1)
    assert ended["b.md"] == ("failed", "File is not valid UTF-8", None) and ended["c.pdf"][0] == "failed"
    assert {r["status"] for r in res.job_events.collect()} == {"queued", "running", "done", "failed"}


def test_broken_run_leaves_failed_jobs(spark):
    from docyard.plans.ingest import ingest
    from docyard.sinks.jobs import current_jobs, validate_transitions

    def broken():
        def model(texts):
            raise ValueError("model is down")
        return model

    jobs = tempfile.mkdtemp(prefix="docyard-jobs-") + "/events"
    with pytest.raises(Exception, match="model is down"):
        ingest(_corpus(spark).limit(5), tempfile.mkdtemp(prefix="docyard-pts-"), IngestConfig(target_language=None), jobs_path=jobs,
               model_factory=broken)
    ended = current_jobs(validate_transitions(spark.read.parquet(jobs))).collect()
    assert len(ended) == 5 and {r["status"] for r in ended} == {"failed"} and all("model is down" in r["error_message"] for r in ended)


def test_page_order_decides_in_a_batch(spark):
    from docyard.operators import dedup as D
    rows = [("dup", "f.pdf", 2, 0), ("dup", "f.pdf", 1, 3), ("dup", "f.pdf", 1, 1)]
    c = D.with_identity(spark.createDataFrame([(*r, "t") for r in rows],
                                              "text string, source_path string, page_number int, chunk_index int, tenant_id string"))
    assert [(r["page_number"], r["chunk_index"]) for r in D.filter_new_chunks(c).collect()] == [(1, 1)]
