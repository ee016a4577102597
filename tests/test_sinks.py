"""V1-V4 vector table; J1-J8 job trail."""

import datetime as dt
import tempfile

import pytest
from pyspark.sql import functions as F

from docyard.sinks import jobs as J
from docyard.sinks import points as P


def pts(spark, rows):
    return spark.createDataFrame(rows, "tenant_id string, chunk_hash string, text string, embedding array<float>") \
                .withColumn("point_id", F.concat(F.lit("p-"), F.col("chunk_hash")))


def test_table_create_once_and_size_check(spark):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    with pytest.raises(ValueError, match="vector_size must be greater than zero"):
        P.ensure_table(spark, path, 0)
    a = P.ensure_table(spark, path, 4)
    b = P.ensure_table(spark, path, 4)            # existing table left as it is
    assert a == b and b["vector_size"] == 4 and b["indexed"] == ["tenant_id", "chunk_hash"]
    with pytest.raises(ValueError, match="holds vectors of width 4, asked for 8"):
        P.ensure_table(spark, path, 8)


def test_upsert_and_latest(spark):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, path, 2)
    assert P.upsert(pts(spark, [("t", "h1", "one", [1.0, 0.0]), ("t", "h2", "two", [0.0, 1.0])]), path, 1) == 2
    assert P.upsert(pts(spark, [("t", "h1", "one again", [1.0, 0.0]), ("u", "h1", "other", [1.0, 0.0])]), path, 2) == 2
    assert P.upsert(pts(spark, []), path, 3) == 0
    cur = {(r["tenant_id"], r["chunk_hash"]): r["text"] for r in P.read_points(spark, path).collect()}
    assert cur == {("t", "h1"): "one again", ("t", "h2"): "two", ("u", "h1"): "other"}
    P.upsert(pts(spark, [("t", "h2", "two v3", [0.0, 1.0])]), path, 4)
    cur = {(r["tenant_id"], r["chunk_hash"]): r["text"] for r in P.read_points(spark, path).collect()}
    assert cur[("t", "h2")] == "two v3" and P.point_count(spark, path) == 3


def test_upsert_width_check(spark):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, path, 3)
    with pytest.raises(Exception, match="vector width must be 3"):
        P.upsert(pts(spark, [("t", "h", "x", [1.0, 2.0])]), path, 1)


def test_no_run_hides_another(spark):
    """A run with a smaller sequence adds its keys; a run that is repeated changes nothing; runs may bring columns."""
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, path, 2)
    assert P.point_count(spark, path) == 0
    P.upsert(pts(spark, [("t", "h1", "one", [1.0, 0.0])]), path, 1_700_000_000_000_000)
    late = pts(spark, [("t", "h2", "late", [0.0, 1.0]), ("t", "h1", "older", [0.0, 1.0])])
    assert P.upsert(late, path, 0) == P.upsert(late, path, 0) == 2
    cur = {r["chunk_hash"]: r["text"] for r in P.read_points(spark, path).collect()}
    assert cur == {"h1": "one", "h2": "late"} and P.point_count(spark, path) == 2
    P.upsert(pts(spark, [("t", "h3", "x", [0.0, 1.0])]).withColumn("page", F.lit(7)), path, 5)
    assert {(r["chunk_hash"], r["page"]) for r in P.read_points(spark, path).collect()} == {("h1", None), ("h2", None), ("h3", 7)}


def test_tenants_that_look_like_numbers_stay_apart(spark):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, path, 2)
    tenants = ["007", "7", "1e3", "1000", "2024-01-01", "true", None]
    P.upsert(pts(spark, [(t, "h", "x", [1.0, 0.0]) for t in tenants]), path, 1)
    assert P.read_points(spark, path).schema["tenant_id"].dataType.simpleString() == "string"
    assert {r["tenant_id"] for r in P.read_points(spark, path).collect()} == set(tenants)
    got = {r["tenant_id"]: r["points"] for r in P.points_per_tenant(P.read_points(spark, path)).collect()}
    assert got == {t: 1 for t in tenants}


def _events(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(j, s, t0 + dt.timedelta(seconds=i), i, "t", "p") for i, (j, s) in enumerate(rows)]
    return spark.createDataFrame(data, "job_id string, status string, event_at timestamp, seq long, "
                                       "tenant_id string, source_path string") \
                .withColumn("error_message", F.lit(None).cast("string")) \
                .withColumn("chunk_count", F.lit(None).cast("int")) \
                .withColumn("skipped_count", F.lit(None).cast("int")) \
                .withColumn("duration_seconds", F.lit(None).cast("double"))


def test_transitions(spark):
    ev = _events(spark, [("j", "queued"), ("j", "running"), ("j", "done"), ("j", "running"),
                         ("k", "running"), ("k", "queued"), ("k", "failed"), ("k", "running"), ("k", "failed")])
    v = {(r["job_id"], r["seq"]): (r["valid"], r["rejection"]) for r in J.validate_transitions(ev).collect()}
    assert v[("j", 2)] == (True, None)
    assert v[("j", 3)] == (False, "invalid job status transition: done -> running")
    assert v[("k", 4)] == (False, "ingestion job not found: k")
    assert v[("k", 6)] == (False, "invalid job status transition: queued -> failed")
    assert v[("k", 7)][0] and v[("k", 8)][0]
    cur = {r["job_id"]: r["status"] for r in J.current_jobs(J.validate_transitions(ev)).collect()}
    assert cur == {"j": "done", "k": "failed"}


def test_lookup_recent_audit(spark):
    ev = _events(spark, [("a", "queued"), ("b", "queued"), ("b", "running")])
    cur = J.current_jobs(J.validate_transitions(ev))
    ids = spark.createDataFrame([("a",), ("zz",)], "job_id string")
    assert [(r["job_id"], r["status"]) for r in J.get_job(ev, ids).collect()] == [
        (r["job_id"], r["status"]) for r in cur.collect() if r["job_id"] == "a"]
    assert [r["job_id"] for r in J.recent_jobs(cur, "t").collect()] == ["b", "a"]
    assert J.audit_report(cur, 1).columns == ["source_path", "status", "chunk_count", "skipped_count"]
    jobs = J.create_jobs(spark.createDataFrame([("d", "p", "t")], "doc_id string, source_path string, tenant_id string"), "run1")
    r = jobs.first()
    assert r["status"] == "queued" and len(r["job_id"]) == 36


def _fold(statuses, job):
    """The reference's one-update-at-a-time rules, as a plain Python fold."""
    allowed = {"queued": {"running"}, "running": {"done", "failed"}, "done": set(), "failed": set()}
    state, out = None, []
    for s in statuses:
        if state is None:
            if s == "queued":
                state = "queued"
                out.append((True, None))
            else:
                out.append((False, f"ingestion job not found: {job}"))
        elif s in allowed[state]:
            state = s
            out.append((True, None))
        else:
            out.append((False, f"invalid job status transition: {state} -> {s}"))
    return out


def test_transitions_match_fold(spark):
    import random
    rnd = random.Random(11)
    rows = []
    seqs = {}
    for j in range(60):
        seq = [rnd.choice(["queued", "running", "done", "failed"]) for _ in range(rnd.randint(1, 9))]
        seqs[f"j{j}"] = seq
        rows += [(f"j{j}", s) for s in seq]
    rows += [("hot", rnd.choice(["queued", "running", "done", "failed"])) for _ in range(400)]
    seqs["hot"] = [s for j, s in rows if j == "hot"]
    # however a job's events are cut into blocks
    for block in ("second", "minute", "hour"):
        got = {}
        for r in J.validate_transitions(_events(spark, rows), block=block).orderBy("seq").collect():
            got.setdefault(r["job_id"], []).append((r["valid"], r["rejection"]))
        for job, seq in seqs.items():
            assert got[job] == _fold(seq, job), (block, job)


def test_moments_of_a_job_and_rows_of_no_job(spark):
    ev = _events(spark, [("j", "running"), ("j", "queued"), (None, "queued"), ("j", "failed"), ("j", "running"), ("j", "queued"),
                         ("j", "done"), ("j", "failed"), (None, "running"), ("k", "odd")])
    t0 = dt.datetime(2024, 1, 1)
    for block in ("second", "minute"):
        v = {r["seq"]: r for r in J.validate_transitions(ev, block=block).collect()}
        assert len(v) == 10 and {q for q, r in v.items() if r["valid"]} == {1, 4, 6}
        assert all(v[q]["created_at"] == t0 + dt.timedelta(seconds=1) and v[q]["indexed_at"] == t0 + dt.timedelta(seconds=6)
                   for q in (0, 1, 3, 7))
        assert v[7]["rejection"] == "invalid job status transition: done -> failed"
        assert v[9]["rejection"] == "ingestion job not found: k" and not v[2]["valid"] and not v[8]["valid"]


def test_requests_without_a_time_come_first(spark):
    ev = _events(spark, [("j", "running"), ("j", "queued"), ("j", "done")])
    ev = ev.withColumn("event_at", F.when(F.col("status") != "queued", F.col("event_at")))
    v = {r["seq"]: r["valid"] for r in J.validate_transitions(ev, block="second").collect()}
    assert v == {0: True, 1: True, 2: True}


def test_log_is_read_twice_and_shuffled_once(spark):
    """The job queries read the log in two scans; a job is never one window."""
    import re
    import __spark_entry__ as E
    for name in ("job_transitions", "job_current", "recent_jobs", "audit_report", "job_lookup"):
        plan = E.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert len(re.findall(r"FileScan parquet .*event_type", plan)) <= 2, name
        windows = re.findall(r"Window \[min\(.*?\], \[([^\]]*)\]\s*$", plan, re.M)
        assert windows and sum("_block" in w for w in windows) == 3, name


def test_streaming_job_state_matches_batch(spark, tmp_path):
    """Three micro-batches, with a stop and a start between them; a hot job comes in several Arrow batches."""
    import random
    from docyard.streaming import job_state as T
    rnd = random.Random(4)
    rows = [(f"j{rnd.randint(0, 20)}" if rnd.random() < 0.6 else "hot", rnd.choice(["queued", "running", "done", "failed"]))
            for _ in range(600)]
    ev = _events(spark, rows).select("job_id", "status", "event_at", "seq")
    want = {(r["job_id"], r["seq"]): (r["valid"], r["rejection"])
            for r in J.validate_transitions(_events(spark, rows)).collect()}
    limit = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(limit)
    spark.conf.set(limit, 20)

    def run():
        stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        with T.state_store(spark):
            q = (T.validate_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out")
                 .option("checkpointLocation", f"{tmp_path}/progress").trigger(availableNow=True).start())
        assert q.awaitTermination(200)
        return q

    try:
        for at, part in enumerate((ev.filter("seq < 200"), ev.filter("seq >= 200 and seq < 400"))):
            part.orderBy("seq" if at else F.desc("seq")).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        assert len([p for p in run().recentProgress if p["numInputRows"]]) == 2
        ev.filter("seq >= 400").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run()
        run()  # nothing new
    finally:
        spark.conf.set(limit, before)
    out = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len(out) == len(rows) and {(r["job_id"], r["seq"]): (r["valid"], r["rejection"]) for r in out} == want


def test_sorted_runs_are_merged_piece_by_piece(monkeypatch):
    import pandas as pd
    from docyard.streaming import job_state as T

    class Value:
        kept = None
        def get(self): return self.kept
        def update(self, v): self.kept = v

    class Map(dict):
        most = 0
        def updateValue(self, k, v):
            self[k] = v
            self.most = max(self.most, len(v[0]))
        def getValue(self, k): return self[k]
        def removeKey(self, k): del self[k]

    monkeypatch.setattr(T, "PIECE", 7)
    job = T.JobState()
    job.current, job.aside = Value(), Map()
    import random
    rnd = random.Random(9)
    seq = [rnd.choice(["queued", "running", "done", "failed"]) for _ in range(100)]
    order = list(range(100))
    rnd.shuffle(order)
    frames = [pd.DataFrame({"at": [i // 2 for i in part], "seq": part, "status": [seq[i] for i in part]})
              for part in (order[a:a + 30] for a in range(0, 100, 30))]
    out = pd.concat(job.handleInputRows(("j",), iter(frames), None))
    assert out["seq"].tolist() == list(range(100)) and not job.aside and job.aside.most == 7
    got = [(bool(v), None if pd.isna(w) else w) for v, w in zip(out["valid"], out["rejection"])]
    assert got == _fold(seq, "j") and list(job.handleInputRows(("j",), iter([]), None)) == []


def test_index_keys_and_reference_key_mode(spark):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    assert P.index_keys(spark, path) is None
    P.ensure_table(spark, path, 2)
    assert P.index_keys(spark, path) is None
    P.upsert(pts(spark, [("a", "h", "x", [1.0, 0.0])]), path, 1)
    P.upsert(pts(spark, [("b", "h", "x", [1.0, 0.0])]), path, 2)
    keys = sorted(tuple(r) for r in P.index_keys(spark, path).collect())
    assert keys == [("a", "h"), ("b", "h")]            # equal text in two tenants keeps both points
    # key by point id alone: the second tenant's write replaces the first's point
    ref = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, ref, 2, key=("point_id",))
    P.upsert(pts(spark, [("a", "h", "x", [1.0, 0.0])]), ref, 1)
    P.upsert(pts(spark, [("b", "h", "x", [1.0, 0.0])]), ref, 2)
    assert [tuple(r) for r in P.index_keys(spark, ref).collect()] == [("b", "h")]


def test_written_count_needs_no_second_read(spark, monkeypatch):
    path = tempfile.mkdtemp(prefix="docyard-pts-")
    P.ensure_table(spark, path, 2)
    rows = pts(spark, [("a", f"h{k}", "x", [1.0, 0.0]) for k in range(50)]).repartition(4)
    monkeypatch.setattr(P, "_rows", None)
    assert P.upsert(rows, path, 1) == 50 and P.upsert(rows.limit(0), path, 2) == 0
    assert P.upsert(rows.filter("chunk_hash = 'none'"), path, 3) == 0


def test_bucketed_index_is_not_shuffled(spark):
    import re
    import uuid
    from docyard.operators import dedup as D
    from docyard.sinks import hash_index as X
    name, where = "idx_" + uuid.uuid4().hex[:10], tempfile.mkdtemp(prefix="docyard-idx-") + "/t"
    assert X.read_index(spark, name) is None
    keys = spark.createDataFrame([("a", f"h{k}") for k in range(100)] + [("b", "h7"), (None, "h200")], "tenant_id string, chunk_hash string")
    X.append_index(keys, name, 4, where)
    X.append_index(keys.limit(3), name, 4, where)
    chunks = spark.createDataFrame([("a", "h1", "p", 0), ("b", "h1", "p", 1), (None, "h1", "p", 2), ("", "h300", "p", 3), ("b", "h7", "p", 4)],
                                   "tenant_id string, chunk_hash string, source_path string, chunk_index int")
    limit = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(limit)
    spark.conf.set(limit, "-1")
    try:
        left = D.new_keys(D.first_keys(chunks), X.read_index(spark, name))
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r["_o"]["chunk_index"] for r in left.collect()) == [1, 3]
        index_side = plan[plan.index("SortMergeJoin"):].split("FileScan")[0].split("\n")
        scan = next(n for n, line in enumerate(plan.split("\n")) if "FileScan" in line)
        above = plan.split("\n")[scan - 4:scan]
        assert "Bucketed: true" in plan and not any("Exchange" in line for line in above), plan
        assert index_side and re.search(r"SelectedBucketsCount: 4 out of 4", plan)
    finally:
        spark.conf.set(limit, before)
        X.drop_index(spark, name)
