import numpy as np

from docyard.llm import topk as K

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, queries, k):
    ok = [(i, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, e in rows
          if i is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for qi, qe in {i: e for i, e in sorted(ok, reverse=True)}.items():
        if qi in queries:
            scored = sorted((-sum(a * b for a, b in zip(qe, e)), i) for i, e in ok if i != qi)[:k]
            out += [(qi, r, i, -s) for r, (s, i) in enumerate(scored, 1)]
    return sorted(out)


def run(spark, rows, queries, k=5):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    got = K.top_k(df, df.filter(df.vec_id.isin(list(queries))), k)
    return sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got.collect())


def test_matches_brute_force_with_ties_and_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(K, "BLOCK", 16)
    monkeypatch.setattr(K, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(1)
    base = rng.normal(size=(12, 16))
    rows = [(i, (base[i % 12] / 4 + rng.normal(size=16) * (i % 3) / 10).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (None, rows[0][1]), (1001, [float("nan")] * 16), (1002, [None] + [0.1] * 15),
             (1003, [float("inf")] * 16), (1004, []), (1005, [0.0] * 16), (1006, [0.5] * 4)]
    rows += [(300 + i, rows[3][1]) for i in range(60)] + [rows[5], rows[5]]  # one vector on a sixth of the rows, repeated rows
    queries = set(range(0, 300, 10)) | {1000, 1001, 1004, 1005, 1006, 303}
    assert run(spark, rows, queries) == brute(rows, queries, 5)


def test_an_id_on_a_third_of_the_rows_is_spread(spark, monkeypatch):
    """No shard is larger than its share, and the answer is the brute force's."""
    rng = np.random.default_rng(6)
    rows = [(7 if i % 3 == 0 else i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(900)]
    sizes = []
    kept = K.search_shard
    monkeypatch.setattr(K, "search_shard", lambda q, v, k: kept(q, v, k).assign(vec_id=len(v)))
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA).repartition(6)
    sizes = [r["vec_id"] for r in K.top_k(df, df.filter("vec_id = 8"), 900).collect()]
    assert sizes and max(sizes) < 3 * 900 / K.MIN_SHARDS
    monkeypatch.setattr(K, "search_shard", kept)
    assert run(spark, rows, {8, 10}) == brute(rows, {8, 10}, 5)


def test_fewer_rows_than_k_and_no_rows(spark):
    rows = [(1, [0.5, 0.25]), (2, [0.1, -0.9])]
    assert run(spark, rows, {1}) == brute(rows, {1}, 5)
    assert run(spark, [(1, [0.5])], {1}) == []
    assert run(spark, [], {1}) == []


def test_scores_beyond_float_precision(spark):
    rows = [(1, [3e9, 1.0]), (2, [3e9, 2.0]), (3, [3e9, 1.5]), (4, [-3e9, 0.0]), (5, [3e38, 0.0])]
    got = run(spark, rows, {1, 2})
    assert [r[:3] for r in got if r[0] == 1] == [(1, 1, 2), (1, 2, 3), (1, 3, 5), (1, 4, 4)]  # equal at the limit
    top = (1 << 63) - 1
    assert [r[3] for r in got if r[0] == 1] == [top, top, top, -top - 1]


def test_only_competing_vectors_are_probed():
    rng = np.random.default_rng(2)
    v = np.floor(rng.normal(size=(20_000, 32)) * 40)
    touched = []
    postings = K.Postings(np.arange(20_000), v)

    class Watch(np.ndarray):
        def __getitem__(self, key):
            out = super().__getitem__(key)
            if isinstance(key, tuple) and isinstance(key[0], np.ndarray):
                touched.append(out.shape)
            return out

    postings.impact = postings.impact.view(Watch)
    q = v[7] * (np.arange(32) < 6)  # few terms weigh
    got = postings.search(7, q + rng.integers(-1, 2, 32), 5)
    assert len(got) == 5 and sum(a * b for a, b in touched) < 2 * 20_000 * 32
