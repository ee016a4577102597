import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from docyard.llm import clusters as C

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, k=16, rounds=3, width=64):
    kept = []
    for i, e in rows:
        if e is not None and len(e) == width and all(x is not None and np.isfinite(x) for x in e):
            kept.append((i, [max(-(1 << 63), min((1 << 63) - 1, int(np.floor(64 * float(np.float32(x)))))) for x in e]))
    code = lambda i: hashlib.sha256(f"1:{i}".encode()).hexdigest()
    at = [x for _, x in sorted(kept, key=lambda r: (r[0] is None, code(r[0]), r[1]))[:k]]
    top = (1 << 63) - 1

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(at))

    for _ in range(rounds):
        own = [near(x)[1] for _, x in kept]
        new = []
        for n, c in enumerate(at):
            mine = [x for (_, x), m in zip(kept, own) if m == n]
            new.append([sum(col) // len(mine) for col in zip(*mine)] if mine else c)
        at = new
    out = [(i, *reversed(near(x))) for i, x in kept]
    out = [(i, c, min(d, top)) for i, c, d in out]
    spread = {n: min(sum(d for _, c, d in out if c == n), top) for n in range(len(at))}
    return sorted(((i, c, d, spread[c], min(sum(d for _, _, d in out), top),
                    hashlib.sha256(",".join(map(str, at[c])).encode()).hexdigest()) for i, c, d in out), key=str)


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    return sorted(map(tuple, C.centroid_clusters(df, **kw).collect()), key=str)


def vectors(n, seed, width=64, groups=9):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(groups, width))
    return [(i, (base[i % groups] + rng.normal(size=width) * 0.6).astype(np.float32).tolist()) for i in range(n)]


def test_matches_brute_force_with_odd_rows(spark):
    rows = vectors(260, 1)
    rows += [(900, None), (901, [0.5] * 63), (902, []), (903, [None] + [0.1] * 63), (904, [float("nan")] * 64),
             (905, [float("-inf")] * 64), (906, [0.0] * 64), (None, rows[4][1]), (None, [0.25] * 64)]
    rows += [(1000 + k, rows[7][1]) for k in range(120)] + [rows[9], rows[9]]  # one vector on a third of the rows, repeats
    assert run(spark, rows) == brute(rows)


def test_few_vectors_ties_and_none(spark):
    rows = [(i, [float(i % 2)] * 64) for i in range(5)]  # equal starts: the smaller number wins, empty clusters stay
    assert run(spark, rows) == brute(rows)
    assert run(spark, [(1, [0.5] * 3)]) == [] and run(spark, []) == []


def test_other_sizes(spark):
    rows = vectors(90, 2, width=6, groups=4)
    assert run(spark, rows, k=5, rounds=2, width=6, lead=2) == brute(rows, 5, 2, 6)
    assert run(spark, rows, k=3, rounds=0, width=6, lead=6) == brute(rows, 3, 0, 6)


def test_huge_components_are_exact(spark):
    rows = vectors(20, 3, width=3, groups=3)
    rows += [(100, [1e6, 2.0, -3e6]), (101, [1.5e12, 0.0, 0.25]), (102, [3e38, -3e38, 1.0]), (103, [3e38, -3e38, 2.0])]
    assert run(spark, rows, k=4, width=3) == brute(rows, 4, 3, 3)


def test_bound_prunes_and_never_misleads():
    rng = np.random.default_rng(4)
    base = rng.normal(size=(12, 64)) * 40
    x = np.floor(base[rng.integers(0, 12, 6000)] + rng.normal(size=(6000, 64)) * 8).astype(np.int64)
    mean = x.mean(axis=0)
    _, axes = np.linalg.eigh(np.cov((x - mean).T))
    rotation = C.Rotation(mean, axes[:, ::-1], 8)
    at = x[:16]
    lead, rest = rotation(x)
    cluster, distance, measured = C.nearest(x, lead, rest, at, rotation)
    full = np.stack([C.squared(x, c) for c in at], axis=1)
    assert (cluster == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.35 * full.size
    at = np.repeat(x[:1], 4, axis=0)  # equal centroids
    assert (C.nearest(x, lead, rest, at, rotation)[0] == 0).all()


def test_clashing_columns_are_ignored(spark):
    rows = vectors(40, 5)
    df = spark.createDataFrame([(i, e, 0) for i, e in rows], SCHEMA)
    for name in ("x", "lead", "rest", "cluster", "distance", "s"):
        df = df.withColumn(name, F.lit("extra"))
    assert sorted(map(tuple, C.centroid_clusters(df).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001"])
def test_leaves_no_scratch_behind(spark, sf):
    import os
    from docyard.session import ensure_checkpoint_dir
    base = ensure_checkpoint_dir(spark).removeprefix("file:")
    E.queries()["op11_centroid_clustering"](spark, sf).count()
    assert not [n for n in os.listdir(base) if n.startswith("clusters-")]
