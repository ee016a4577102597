import random
import re

import numpy as np
import pandas as pd

from docyard.llm import quality as Q
from helpers import docs, edge_rows, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    windows = [tuple(w[i:i + 3]) for i in range(len(w) - 2)]
    again = {x for x in windows if windows.count(x) > 1} if len(w) < 3000 else set()
    inside = {i + k for i, x in enumerate(windows) if x in again for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside)


def test_counts_match_brute_force():
    rng = random.Random(1)
    texts = [t for _, t in edge_rows() if t is None or len(t) < 10_000]
    texts += ["".join(rng.choice("ab \n\t\x0b#|<*é ") for _ in range(rng.randint(0, 200))) for _ in range(300)]
    texts += [" ".join(rng.choice("abc") for _ in range(rng.randint(0, 60))) for _ in range(100)]
    for t in texts:
        assert Q.count_stats(t)[:5] == brute(t), repr(t)


def test_long_text_with_every_window_repeated():
    assert Q.count_stats("a b c " * 50_000)[4] == 150_000


def learned(n=3000, seed=0):
    rng = np.random.default_rng(seed)
    stats = pd.DataFrame({c: rng.random(n) for c in Q.STATS})
    bad = ((stats.upper_share > 0.8) | ((stats.dup_line_share > 0.6) & (stats.n_words < 0.5))).to_numpy()
    return stats, bad, rng.random(n) < 0.33


def test_covering_learns_ordered_conjunctions():
    stats, bad, hold = learned()
    rules = Q.learn_rules(stats, bad, hold)
    hit = np.zeros(len(bad), dtype=bool)
    for rule in rules:
        hit |= Q.covered(rule, {c: stats[c].to_numpy() for c in stats}, len(bad))
    assert 1 < len(rules) <= Q.MAX_RULES
    assert hit[bad].mean() > 0.9 and hit[~bad].mean() < 0.03


def test_emitted_conditional_equals_the_rules(spark):
    stats, bad, hold = learned(400)
    rules = Q.learn_rules(stats, bad, hold)
    got = [r["r"] for r in spark.createDataFrame(stats).coalesce(1).select(Q.rejects(rules).alias("r")).collect()]
    columns = {c: stats[c].to_numpy() for c in stats}
    want = np.zeros(len(bad), dtype=int)
    for k, rule in reversed(list(enumerate(rules, 1))):
        want[Q.covered(rule, columns, len(bad))] = k
    assert got == want.tolist()


def labelled(spark, n=240):
    rng = random.Random(4)
    rows, marks = [], []
    for k in range(n):
        clean = words(rng, 90, "abcdefghijklmnop")
        rows.append((k, clean if k % 4 else " ".join(w + "###" for w in clean.split())))
        marks.append((k, int(bool(k % 4)), 0))
    return rows, spark.createDataFrame(marks + marks[:5] + [(None, 1, None), (3, None, 0)], "doc_id long, quality int, toxic int")


def test_filter_rejects_bad_and_keeps_clean(spark):
    rows, marks = labelled(spark)
    df = docs(spark, rows + edge_rows(), clash=True)
    rules = Q.fit_rules(df, marks)
    out = Q.keep_good(df, rules)
    assert rules and out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    assert {k for k in range(12, 240) if k % 4} <= set(kept) and not {k for k in range(12, 240) if not k % 4} & set(kept)
    assert not {2, 3, 6, 7, 8} & {k for k in kept if k is not None and k < 12 and k % 4 == 0}
    report = Q.quality_report(df, rules).collect()
    assert len(report) == df.count() and all(r["kept"] is not None and r["base_failed"] is not None for r in report)


def test_one_labelled_id_on_very_many_rows(spark, monkeypatch):
    """The bound on labelled ids bounds the rows that reach the driver."""
    rows, marks = labelled(spark)
    hot = docs(spark, rows + [(1, rows[1][1] + f" {k}") for k in range(30_000)])
    taken = []
    monkeypatch.setattr(Q, "learn_rules", lambda stats, bad, hold: taken.append(len(stats)) or [])
    Q.fit_rules(hot, marks)
    Q.fit_rules(hot, marks.filter("doc_id = 1"), 1)
    assert taken == [240, 1]


def test_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, edge_rows())
    assert Q.fit_rules(df, none) == []
    assert Q.fit_rules(docs(spark, []), none) == []
    assert Q.quality_report(docs(spark, []), []).count() == 0
    assert all(r["kept"] == (not r["base_failed"]) for r in Q.quality_report(df, []).collect())
