"""The pipeline's stages on planted rows, against what each must do."""

import os
import random

import corpus_pipeline
import pytest

import __spark_entry__ as E
import test_llm_linededup
import test_llm_packing
import test_llm_quality
import test_llm_simhash
import test_llm_toxicity
from docyard.llm import quality, toxicity
from helpers import docs, words


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(12)
    base = tmp_path_factory.mktemp("tables")
    rows, marks = [], []
    for k in range(400):
        text = "\n".join(words(rng, 40) for _ in range(3))
        if k % 8 == 1:
            text = " ".join(w + "$$$" for w in text.split())  # low quality
        if k % 8 == 2:
            text += " moron " + rng.choice(["scum", "idiot"])
        if k % 8 == 3:
            text += "\nThis boilerplate line stands on many sites."
        rows.append((k, text, f"s{k % 9}"))
        marks.append((k, int(k % 8 != 1), int(k % 8 == 2)))
    clean = next(t for k, t, _ in rows if k == 0)
    rows += [(1000 + k, clean, "s1") for k in range(30)] + [(2000, None, "s1"), (2001, "", "s2"), (None, clean + " x", "s3"), (0, clean, "s0")]
    docs(spark, rows).repartition(3).write.parquet(f"{base}/documents.parquet")
    spark.createDataFrame(marks, "doc_id long, quality int, toxic int").write.parquet(f"{base}/labels.parquet")
    return str(base), rows


def test_stages_do_their_work(spark, folder):
    base, rows = folder
    now = spark.read.parquet(f"{base}/documents.parquet")
    columns, seen = now.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, base)
        now = spark.createDataFrame(now.collect(), now.schema)
        seen[name] = now.collect()
        if name != "packing":
            assert now.columns == columns
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    held = {k for k in range(400)}
    assert {k for k in held if k % 8 == 1}.isdisjoint(ids("quality_rules")) and {2000, 2001}.isdisjoint(ids("quality_rules"))
    assert {k for k in held if k % 8 != 1} <= ids("quality_rules")
    assert {k for k in held if k % 8 == 2}.isdisjoint(ids("toxicity")) and {k for k in held if k % 8 not in (1, 2)} <= ids("toxicity")
    assert len(seen["line_dedup"]) == len(seen["toxicity"])
    assert [r["doc_id"] for r in seen["line_dedup"] if "boilerplate" in r["text"]] == [3]
    final = ids("simhash_near_dedup")
    assert 0 in final and not any(k >= 1000 for k in final if k is not None) and {k for k in held if k % 8 == 4} <= final
    packed = {r["doc_id"] for r in seen["packing"]}
    assert packed == final


def test_run_equals_the_stages(spark, folder):
    base, _ = folder
    got = corpus_pipeline.run(spark, base)
    last = got.inputFiles()[0].rsplit("/", 2)[0].removeprefix("file://").removeprefix("file:")
    assert os.listdir(last) == ["5-packing"]  # earlier stages are gone
    now = spark.read.parquet(f"{base}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, base)
    narrow = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert sorted(map(tuple, got.select(narrow).collect()), key=str) == sorted(map(tuple, now.select(narrow).collect()), key=str)


def brute_quality(rows, rules):
    """Rows (id, text, source) that neither the base rule nor a learned conjunction rejects, one after the other."""
    out = []
    for row in rows:
        n_words, *_, n_repeat = test_llm_quality.brute(row[1])
        stats = dict(zip(quality.STATS, quality.count_stats(row[1])))
        fires = any(all(stats[c.stat] >= c.value if c.at_least else stats[c.stat] < c.value for c in rule) for rule in rules)
        if n_words >= 50 and 100 * n_repeat <= 50 * n_words and not fires:
            out.append(row)
    return out


def brute_near_dedup(rows):
    """Rows whose id is the least of its component (copies of such a row once) and rows without id."""
    narrow = sorted(((d, t) for d, t, _ in rows if d is not None), key=str)
    stays = {int(a) for a, _, c in test_llm_simhash.brute_components(narrow) if a == c}
    seen, out = set(), []
    for row in rows:
        if row[0] is None or (row[0] in stays and row[:2] not in seen):
            seen.add(row[:2])
            out.append(row)
    return out


def test_run_equals_brute_force(spark, folder):
    """The whole run against plain Python stages; learned lists and weights are taken as given, each learned on its own input."""
    base, rows = folder
    labels = spark.read.parquet(f"{base}/labels.parquet")
    now = brute_quality(rows, quality.fit_rules(docs(spark, rows), labels))
    assert 0 < len(now) < len(rows)
    learned = toxicity.fit_toxicity(docs(spark, now), labels).classifier
    clean = [r for r in now if test_llm_toxicity.brute_score(learned, r[1]) < toxicity.THRESHOLD]
    assert 0 < len(clean) < len(now)
    lines = test_llm_linededup.brute_in_order(clean)
    now = [(d, text if t is not None else None, s) for (d, t, s), (_, _, _, text) in zip(clean, lines)]
    assert any(t != c[1] for (_, t, _), c in zip(now, clean))
    kept = brute_near_dedup(now)
    assert 0 < len(kept) < len(now)
    got = corpus_pipeline.run(spark, base).collect()
    assert {r["doc_id"] for r in got} == {d for d, _, _ in kept}
    test_llm_packing.check([r[:2] for r in kept], got)  # every id of these texts in exactly one piece, sequences gapless
    assert sum(r["length"] for r in got) == sum(len(test_llm_packing.ids_of(t)) for _, t, _ in kept)


def test_registered():
    names = E.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "line_dedup", "simhash_near_dedup", "packing"]
