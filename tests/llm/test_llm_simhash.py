import random

import numpy as np
import pytest
import xxhash

from docyard.llm import simhash as S
from helpers import docs, edge_rows, words


def brute_fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def brute_components(rows):
    fp = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fp[i] ^ fp[j]).count("1") <= 2:
                parent[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [rows[j][0] for j in range(len(rows)) if find(j) == find(i) and rows[j][0] is not None]
        out.append((rows[i][0], f"{fp[i]:016x}", min(ids) if ids else None))
    return sorted(out, key=str)


def test_gray_rank_inverts_the_gray_sequence():
    n = np.arange(5000, dtype=np.uint64)
    assert (S.gray_rank(n ^ (n >> np.uint64(1))) == n).all()


@pytest.mark.parametrize("near", [False, True])
def test_index_finds_every_pair(near):
    rng = np.random.default_rng(1)
    codes = rng.integers(0, 1 << 63, 600, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if near:  # a dense group: one code with one to three bits changed
        codes = np.array([int(codes[0]) ^ (1 << int(a)) ^ (1 << int(b)) ^ (1 << int(c))
                          for a, b, c in rng.integers(0, 64, (600, 3))], dtype=np.uint64)
    codes = np.unique(codes)
    codes = codes[np.argsort(S.gray_rank(codes))]
    found = {(int(q), int(x)) for a, b in S.GrayIndex(codes).search(codes, 2, after=np.arange(len(codes)), frontier=64)
             for q, x in zip(a, b)}
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes))
            if bin(int(codes[i]) ^ int(codes[j])).count("1") <= 2}
    assert found == want


def test_components_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(S, "MIN_SHARDS", 5)
    monkeypatch.setattr(S, "BLOCK_QUERIES", 20)
    rng = random.Random(5)
    rows = [(r[0], r[1]) for r in edge_rows()]
    for k in range(40):
        text = words(rng, 120)
        rows.append((100 + 3 * k, text))
        rows.append((101 + 3 * k, text.upper()))
        rows.append((102 + 3 * k, text + " tail"))
    got = S.near_duplicates(docs(spark, rows, clash=True)).collect()
    got = sorted(((r["doc_id"], f"{r['code'] & (1 << 64) - 1:016x}", r["component_id"]) for r in got), key=str)
    assert got == brute_components(rows)


def test_components_of_long_chains_and_hot_stars(spark):
    chain = [(k, k + 1) for k in range(60)]
    star = [(1000, 1001 + k) for k in range(300)]
    got = {r["node"]: r["root"] for r in S.components(spark.createDataFrame(chain + star + chain[:5], "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(1, 61)) and all(got[1001 + k] == 1000 for k in range(300))


def test_keep_one_keeps_columns_and_one_row_of_each_group(spark):
    rows = [(4, "a b c d e"), (2, "a b c d e"), (2, "a b c d e"), (9, "A B c d e"), (7, None), (8, ""), (None, "x"), (5, "other words here")]
    df = docs(spark, rows, clash=True)
    kept = S.keep_one(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"] for r in kept.collect()), key=str) == [2, 5, 7, None]


def test_different_texts_under_one_id_both_stay(spark):
    df = docs(spark, [(1, "first text of this id here"), (1, "something else entirely, though"), (1, "first text of this id here")])
    assert sorted(r["text"] for r in S.keep_one(df).collect()) == ["first text of this id here", "something else entirely, though"]


def test_empty_table(spark):
    assert S.keep_one(docs(spark, [])).count() == 0
