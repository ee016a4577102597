import math
import random
import re

import numpy as np
import pytest

from docyard.llm import toxicity as T
from helpers import docs, edge_rows, words


def brute_score(classifier, text):
    """A text's score by testing each weight of the classifier against all words, without memory or lookups."""
    found = re.findall(r"[^\W\d_]+", (text or "").lower())
    z = classifier.bias
    for feature, weight in classifier.weights.items():
        start = feature.removesuffix("*")
        if feature in found or (feature != start and any(w.startswith(start) and w != start for w in found)):
            z += weight
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(9)
    rows, marks = [], []
    bad = ("moron", "scum", "zlaxi", "zlaxo", "zlaxu")  # three share an unknown beginning
    for k in range(900):
        w = words(rng, rng.choice((6, 60, 400)), "abcdefgh").split()
        toxic = k % 5 == 0
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(bad))
        rows.append((k, " ".join(w)))
        marks.append((k, 1, int(toxic)))
    frame = spark.createDataFrame(marks + marks[:7] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    return rows, frame, {m[0]: m[2] for m in marks}


def test_held_out_accuracy(spark, labelled):
    rows, marks, truth = labelled
    df = docs(spark, rows)
    got = T.toxicity_report(df, T.fit_toxicity(df, marks)).collect()
    held = [r for r in got if r["held_out"]]
    assert 200 < len(held) < 400
    assert np.mean([r["predicted"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(r["predicted"] == int(r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in got)


def test_scores_equal_a_plain_sum_of_weights(spark, labelled):
    rows, marks, _ = labelled
    model = T.fit_toxicity(docs(spark, rows), marks)
    texts = rows[:120] + [r for r in edge_rows() if r[0] is not None] + [(10 ** 6, "Moron! ZLAXIZLAX zlax moronic"), (10 ** 6 + 1, "mor on")]
    got = T.toxicity_report(docs(spark, texts), model).select("doc_id", "score").collect()
    want = {}
    for doc, text in texts:
        want.setdefault(doc, []).append(brute_score(model.classifier, text))
    assert len(got) == len(texts)
    assert all(min(abs(r["score"] - w) for w in want[r["doc_id"]]) < 1e-9 for r in got)


def test_labels_of_held_out_rows_are_not_used(spark, labelled):
    from pyspark.sql import functions as F

    rows, marks, _ = labelled
    df = docs(spark, rows)
    turned = marks.withColumn("toxic", F.when(T.training_fold(), F.col("toxic")).otherwise(1 - F.col("toxic")))
    one, two = (T.fit_toxicity(df, m).classifier for m in (marks, turned))
    assert one.weights.keys() == two.weights.keys() and abs(one.bias - two.bias) < 1e-9


def test_edges_and_columns(spark, labelled):
    rows, marks, _ = labelled
    model = T.fit_toxicity(docs(spark, rows), marks)
    df = docs(spark, edge_rows() + [(50, "you moron"), (50, "you moron")], clash=True)
    report = T.toxicity_report(df, model).collect()
    assert len(report) == df.count() and all(r["score"] is not None and r["held_out"] is not None for r in report)
    empty = {r["score"] for r in report if r["doc_id"] in (2, 3, 8)}
    assert len(empty) == 1 and empty.pop() < 0.3
    kept = T.drop_toxic(df, model)
    assert kept.columns == df.columns
    assert kept.count() == df.count() - 2 and 50 not in [r["doc_id"] for r in kept.collect()]


def test_label_model_weighs_voters():
    rng = np.random.default_rng(2)
    y = rng.random(4000) < 0.2
    good = np.where(rng.random(4000) < 0.9, y, ~y & (rng.random(4000) < 0.1))
    echo = np.where(rng.random(4000) < 0.97, good, ~good)  # depends on the first, adds nothing
    third = np.where(rng.random(4000) < 0.8, y, rng.random(4000) < 0.05)
    noise = rng.random(4000) < 0.3
    human = np.where(rng.random(4000) < 0.96, y, ~y)
    votes = np.column_stack([good, echo, third, noise, human]).astype(int)
    p = T.fit_label_model(votes).posterior(votes)
    assert ((p > 0.5) == y).mean() > (human == y).mean() and p[y].mean() > p[~y].mean() + 0.5
    parent = T._correlations(votes, y.astype(float))
    assert parent[1] == 0 and parent[3] == -1  # the echo hangs on its source, noise on nothing


def test_without_labels_hand_written_voters_decide(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, [(1, "you idiot"), (2, "good morning"), (3, None)])
    got = {r["doc_id"]: r["predicted"] for r in T.toxicity_report(df, T.fit_toxicity(df, none)).collect()}
    assert got == {1: 1, 2: 0, 3: 0}
    assert T.toxicity_report(docs(spark, []), T.fit_toxicity(docs(spark, []), none)).count() == 0


def test_one_labelled_id_on_very_many_rows(spark, labelled, monkeypatch):
    """The bound on labelled ids bounds the rows that are fitted on."""
    rows, marks, _ = labelled
    hot = docs(spark, rows + [(10, f"you moron {k}") for k in range(30_000)])
    taken = []
    monkeypatch.setattr(T, "fit_label_model", lambda votes: taken.append(len(votes)) or (_ for _ in ()).throw(KeyError))
    with pytest.raises(KeyError):
        T.fit_toxicity(hot, marks)
    train = spark.createDataFrame([(k,) for k in range(900)], "doc_id long").filter(T.training_fold()).count()
    assert taken == [train]


def test_posterior_equals_enumeration_of_both_classes():
    """The label model's posterior against a plain product over its forest of voters."""
    rng = np.random.default_rng(8)
    m, n = 5, 40
    parent = np.array([-1, 0, 0, 2, -1])
    table = rng.uniform(0.1, 0.9, size=(m, 2, 2))
    model = T.LabelModel(0.3, parent, table)
    votes = rng.integers(0, 2, size=(n, m))
    want = []
    for row in votes:
        both = []
        for y, prior in ((0, 0.7), (1, 0.3)):
            p = prior
            for j in range(m):
                one = table[j][y][row[parent[j]] if parent[j] >= 0 else 0]
                p *= one if row[j] else 1 - one
            both.append(p)
        want.append(both[1] / sum(both))
    assert np.allclose(model.posterior(votes), want)
