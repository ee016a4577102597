import hashlib
import random

from pyspark.sql import functions as F

from docyard.llm import contentsort as X
from helpers import CLASHES, PYTHON_NODES, docs, edge_rows, words

UPPER = {ord(c): c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def brute(rows, largest=True):
    groups = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(UPPER), []).append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = (max(known) if largest else min(known)) if known else None
        sha = hashlib.sha256(text.encode()).hexdigest()
        left = True
        for i in sorted(ids, key=lambda i: i != keep):
            out.append((i, keep, len(ids), left, sha))
            left = False
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, X.content_groups(df, **kw).collect()), key=str)


def sample_rows(seed=5):
    rng = random.Random(seed)
    rows = edge_rows()
    base = [words(rng, rng.randint(1, 30)) for _ in range(60)]
    rows += [(100 + k, rng.choice(base)) for k in range(200)]
    rows += [(400 + k, base[0].upper()) for k in range(150)]           # a hot text in other letters
    rows += [(777, "same id and text") for _ in range(120)]            # a hot repeated row
    rows += [(None, "no id at all"), (None, "no id at all"), (5000, "É"), (5001, "é"), (5002, "é"), (5003, "x "), (5004, "x")]
    head = "a very long common beginning of many texts "
    rows += [(6000 + k, head + str(k // 3)) for k in range(90)]
    return rows


def test_matches_brute_force(spark, monkeypatch):
    rows = sample_rows()
    df = docs(spark, rows, clash=True).repartition(7)
    assert run(df, largest=True) == brute(rows)
    assert run(df) == brute(rows, largest=False)
    monkeypatch.setattr(X, "BUCKET_BYTES", 500)  # many buckets: hot texts and repeated rows are cut
    assert run(df, largest=True) == brute(rows)
    assert run(df) == brute(rows, largest=False)


def test_hot_texts_are_spread(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_BYTES", 2000)
    rows = [(k, "hot text " * 5 if k % 3 else words(random.Random(k), 6)) for k in range(3000)]
    df = docs(spark, rows).repartition(8)
    sort = X.ContentSort(df.select("doc_id", "text"), True)
    sizes = [r["count"] for r in sort.runs(["doc_id"]).groupBy(sort.bucket).count().collect()]
    assert len(sizes) > 30 and max(sizes) < 5 * 3000 / len(sizes)
    rows = [(1, "the same row") for _ in range(3000)]
    df = docs(spark, rows).repartition(8)
    sort = X.ContentSort(df.select("doc_id", "text"), True)
    sizes = [r["count"] for r in sort.runs(["doc_id"]).groupBy(sort.bucket).count().collect()]
    assert max(sizes) <= 3000 / 7
    assert run(df, largest=True) == brute(rows)


def test_equal_hashes_do_not_make_texts_equal(spark, monkeypatch):
    rows = [(k, f"text {k % 11}") for k in range(500)] + [(900, "Text 3")]
    df = docs(spark, rows).repartition(5)
    monkeypatch.setattr(X.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    monkeypatch.setattr(X, "HEAD", 4)
    monkeypatch.setattr(X, "BUCKET_BYTES", 300)
    assert run(df, largest=True) == brute(rows)


def test_empty_table(spark):
    assert run(docs(spark, []), largest=True) == []
    assert X.drop_copies(docs(spark, [])).collect() == []


def test_drop_copies_keeps_rows_whole(spark, monkeypatch):
    monkeypatch.setattr(X, "BUCKET_BYTES", 800)
    rows = [(i, t, f"s{k}") for k, (i, t) in enumerate(sample_rows())]
    df = docs(spark, rows, clash=True).repartition(6)
    got = X.drop_copies(df).collect()
    want = {(r[1], r[4]) for r in brute([(i, t) for i, t, _ in rows], largest=False) if r[3]}
    sha = lambda t: hashlib.sha256((t or "").translate(UPPER).encode()).hexdigest()
    assert {(r["doc_id"], sha(r["text"])) for r in got} == want and len(got) == len(want)
    given = {(i, t, s) for i, t, s in rows}
    assert all((r["doc_id"], r["text"], r["source"]) in given and r["kept"] == "extra" for r in got)
    assert got[0].asDict().keys() == dict.fromkeys(df.columns).keys() and set(CLASHES) <= set(df.columns)


def test_plan_is_native_and_moves_the_text_once(spark):
    df = docs(spark, sample_rows()).repartition(4)
    sort = X.ContentSort(df.select("doc_id", "text"), True)
    plan = sort.runs(["doc_id"])._jdf.queryExecution().executedPlan().toString()
    assert not PYTHON_NODES.search(plan)
    assert plan.count("shufflepartitionidpassthrough") == 1 and plan.count("Exchange") == 2  # the other deals the fixture
    assert plan.count("Window [") == 1
