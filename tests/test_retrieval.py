"""Gold chunks, approximate and exact search at size, the default embedding at width."""

import hashlib
import random
import re

import numpy as np
import pytest

from docyard.operators import lsh as L
from docyard.operators import search as X
from docyard.operators.embed import hashed_counts, hashed_runs
from docyard.operators.gold import gold_chunks


def model_counts(text, width):
    out = [0] * width
    for w in re.findall(r"[^\W_]+", (text or "").lower()):
        h = hashlib.md5(w.encode()).hexdigest()
        out[int(h[:8], 16) % width] += 1 if h[8] < "8" else -1
    return out


@pytest.mark.parametrize("width", [1, 3, 64, 1024])
def test_hashed_counts_equal_a_plain_count(spark, width):
    rng = random.Random(width)
    texts = [" ".join(rng.choice(["alpha", "beta", "Gamma", "é1", "x-y", "漢字"]) for _ in range(n)) for n in (1, 2, 40, 700)]
    texts += [None, "", " ,. ", "one", "a a a a"]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    got = {r["k"]: r for r in df.select("k", hashed_counts("t", width).alias("v"), hashed_runs("t", width).alias("r")).collect()}
    for k, t in enumerate(texts):
        want = model_counts(t, width)
        assert got[k]["v"] == want, t
        assert {r["place"]: r["n"] for r in got[k]["r"] if r["n"]} == {i: n for i, n in enumerate(want) if n}


def test_gold_chunks_count_containment(spark):
    words = [f"w{k}" for k in range(30)]
    passage, other = " ".join(words[:14]), " ".join(f"v{k}" for k in range(9))   # 10 and 5 shingles
    chunks = [(1, "x y " + passage.upper() + " z"),                # whole, other letters
              (2, " ".join(words[:12])),                            # 8 of 10 shingles
              (3, " ".join(words[:11])),                            # 7 of 10
              (4, passage + " " + other), (5, None), (6, ""), (7, "short one"), (8, passage + " " + passage)]
    p = spark.createDataFrame([(1, passage), (2, other), (3, None), (4, ""), (5, "Short  one")], "passage_id int, text string")
    c = spark.createDataFrame(chunks, "id int, text string")
    got = sorted(map(tuple, gold_chunks(p, c, ("id",)).collect()))
    assert got == [(1, 1), (1, 2), (1, 4), (1, 8), (2, 4), (5, 7)]


def vectors(n, seed=1, width=16, groups=20):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, width))
    return [(i, (base[i % groups] + rng.normal(size=width) * 0.25).astype(np.float32).tolist()) for i in range(n)]


def exact(rows, queries, k):
    ids = [i for i, _ in rows]
    u = np.array([v for _, v in rows], dtype=float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    return {q: {ids[j] for j in np.argsort(-(u @ u[ids.index(q)]), kind="stable")[:k]} for q in queries}


def test_lsh_recall_and_odd_rows(spark):
    rows = vectors(1500)
    odd = [(9001, None), (9002, [1.0] * 3), (9003, [float("nan")] * 16), (9004, [None] * 16), (9005, [0.0] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    q = df.filter("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id")
    got = {}
    for r in L.cosine_topk_lsh(df, q, 5, width=16).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    want = exact(rows, range(0, 1500, 20), 5)
    assert sum(len(got[k] & want[k]) for k in want) >= 0.9 * 5 * len(want)
    assert L.cosine_topk_lsh(df.limit(0), q, 5, width=16).count() == 0


def test_lsh_splits_a_bucket_of_copies(spark, monkeypatch):
    """One vector on half of all rows: its bucket is cut, no copy is lost."""
    monkeypatch.setattr(L, "SHARD_VECTORS", 50)
    rows = vectors(300) + [(1000 + k, [1.0] * 16) for k in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = df.filter("vec_id = 1007").withColumnRenamed("vec_id", "query_id")
    got = L.cosine_topk_lsh(df, q, 400, width=16, tables=2).collect()
    assert {r["vec_id"] for r in got if r["score"] > 0.999999} >= {1000 + k for k in range(300)}


def test_buckets_follow_the_corpus():
    assert L.bits_for(0) == L.bits_for(500) == L.BITS
    assert L.bits_for(10 ** 9) == 18 and 10 ** 9 / 2 ** L.bits_for(10 ** 9) <= L.BUCKET_VECTORS
    cut = L.planes(2, 3, 4)
    assert cut.shape == (6, 4) and set(np.unique(cut)) <= {-1.0, 1.0}
    assert L.crossings(3).tolist() == [0, 1, 2, 3, 4, 5, 6]


def test_shards_follow_the_corpus_and_stay_bounded(spark, monkeypatch):
    """The group size is bounded at any number of vectors, also where one id is on a third of the rows."""
    monkeypatch.setattr(X, "SHARD_VECTORS", 100)
    seen = []
    kept = X.shard_topk
    monkeypatch.setattr(X, "found_schema", lambda *a: "query_id long, _id long, score double")

    def note(a, b, k):
        out = kept(a, b, k)
        out["score"] = float(len(b))
        return out

    monkeypatch.setattr(X, "shard_topk", note)
    rows = [(i if i % 3 else 0, v) for i, v in vectors(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(8)
    q = df.filter("vec_id = 1").withColumnRenamed("vec_id", "query_id")
    seen = [r["score"] for r in X.cosine_topk(df, q, 3000).collect()]
    assert seen and max(seen) <= 2 * 100
    monkeypatch.setattr(X, "shard_topk", kept)
    got = X.cosine_topk(df, q, 3).collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["vec_id"] == 1


def test_integer_vectors_tie_exactly(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-3, 4, size=(5, 64))
    rows = [(k, base[k % 5].tolist()) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<int>")
    q = df.filter("vec_id = 2").withColumnRenamed("vec_id", "query_id")
    got = X.cosine_topk(df, q, 6, shards=3).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [2, 7, 12, 17, 22, 27] and len({r["score"] for r in got}) == 1
