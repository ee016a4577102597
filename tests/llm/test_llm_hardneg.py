import numpy as np

from docyard.llm import hardneg as H

SCHEMA = "vec_id long, label int, embedding array<float>"


def brute(rows, anchors, positives=5, negatives=3):
    ok = [(i, g, [int(np.floor(256 * float(np.float32(x)))) for x in e]) for i, g, e in rows
          if i is not None and g is not None and e is not None and all(x is not None and np.isfinite(x) for x in e)]
    top = (1 << 63) - 1
    out = []
    for a in sorted({i for i, _, _ in ok} & set(anchors)):
        _, label, q = min((g, e) and (i, g, e) for i, g, e in ok if i == a)
        score = lambda e: max(-top - 1, min(top, sum(x * y for x, y in zip(q, e))))
        pos = sorted((-score(e), i) for i, g, e in ok if i != a and g == label)[:positives]
        for ps, p in pos:
            ps = -ps
            found = sorted((-score(e), i) for i, g, e in ok if i != a and g != label
                           and 50 * ps <= 100 * score(e) <= 95 * ps)[:negatives]
            out += [(a, p, r, n, ps, -s) for r, (s, n) in enumerate(found, 1)]
    return sorted(out)


def run(spark, rows, anchors, **kw):
    df = spark.createDataFrame(rows, SCHEMA)
    got = H.hard_negatives(df, df.filter(df.vec_id.isin(list(anchors))), **kw)
    return sorted(map(tuple, got.collect()))


def sample(n, seed, width=12, labels=4):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(labels, width)) * 0.4
    return [(i, i % labels, (0.5 + base[i % labels] + rng.normal(size=width) * 0.4).astype(np.float32).tolist()) for i in range(n)]


def test_matches_brute_force_with_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(H, "ANCHOR_BLOCK", 9)
    rows = sample(400, 1)
    rows += [(900, None, [0.5] * 12), (901, 1, None), (None, 2, [0.5] * 12), (902, 1, [float("nan")] * 12), (903, 2, [None] * 12),
             (904, 3, [0.9] * 4), (905, 3, []), (906, 8, [1.0] * 12)]                 # 906: no other row of its label
    rows += [(1000 + k, 2, rows[6][2]) for k in range(150)] + [rows[9], rows[9], rows[10], rows[10]]
    anchors = set(range(0, 400, 10)) | {900, 901, 904, 905, 906, 1003}
    assert run(spark, rows, anchors) == brute(rows, anchors)


def test_repeated_anchor_and_one_id_with_two_labels(spark):
    rows = sample(60, 2) + [(10, 3, [0.4] * 12), (10, 3, [0.4] * 12), (11, 0, [0.7] * 12)]
    assert run(spark, rows, {10, 11, 12}) == brute(rows, {10, 11, 12})


def test_many_labels_few_rows_and_none(spark):
    rng = np.random.default_rng(3)
    rows = [(i, i // 2, rng.random(5).astype(np.float32).tolist()) for i in range(300)]
    assert run(spark, rows, range(0, 300, 7)) == brute(rows, range(0, 300, 7))
    assert run(spark, rows[:1], {0}) == [] and run(spark, [], {0}) == []


def test_scores_beyond_float_precision_and_below_zero(spark):
    rows = [(1, 0, [3e9, 1.0]), (2, 0, [3e9, 2.0]), (3, 1, [2e9, 1.5]), (4, 1, [2.4e9, 0.0]), (5, 0, [3e38, 0.0]), (6, 1, [3e38, 0.0]),
            (7, 2, [-1.0, 0.0]), (8, 2, [0.5, 0.0]), (9, 0, [0.0, 0.0])]
    assert run(spark, rows, range(1, 10)) == brute(rows, range(1, 10))


def test_tree_holds_all_and_prunes():
    rng = np.random.default_rng(5)
    n, width = 20_000, 6
    labels = rng.integers(0, 10, n)
    v = np.floor((rng.normal(size=(10, width)) * 2)[labels] * 100 + rng.normal(size=(n, width)) * 30)
    tree = H.RTree(np.arange(n), labels, v)
    assert sorted(tree.ids) == list(range(n))
    for low, high, first, last, ends in tree.levels[:1]:
        for b in range(len(low)):
            part = tree.vectors[ends[b]:ends[b + 1]]
            assert len(part) <= H.LEAF and (part >= low[b]).all() and (part <= high[b]).all()
    assert len(tree.levels[-1][0]) == 1
    for a in range(0, n, 2000):
        tree.opened = 0
        got = tree.search(a, labels[a], v[a], [(-H.LONGEST, H.LONGEST)], 5, True)[0]
        score = v @ v[a]
        rows = [i for i in np.lexsort((np.arange(n), -score)) if i != a and labels[i] == labels[a]][:5]
        assert got == [(int(score[i]), i) for i in rows]
        assert tree.opened < 0.1 * len(tree.levels[0][0])
        windows = [H.window_of(s) for s, _ in got]
        for (low, high), best in zip(windows, tree.search(a, labels[a], v[a], windows, 3, False)):
            rows = [i for i in np.lexsort((np.arange(n), -score)) if labels[i] != labels[a] and low <= score[i] <= high][:3]
            assert best == [(int(score[i]), i) for i in rows]


def test_registered_query_moves_labels(spark):
    import __spark_entry__ as E
    got = E.queries()["op13_hard_negatives"](spark, "/root/testdata/sf0.001")
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    rows = [(r["vec_id"], (r["label"] + 1) % 10 if r["vec_id"] % 7 == 0 else r["label"], r["embedding"])
            for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted(map(tuple, got.collect())) == brute(rows, [r[0] for r in rows if r[0] % 50 == 0])
