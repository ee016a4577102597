"""Steps that every whole-corpus query pays for: what they must not do again per character, word or vector component."""

import hashlib
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docyard.functions import text as T
from docyard.operators import embed as E
from docyard.operators import gold as G
from docyard.operators import language as LG

WS = [chr(i) for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isspace()]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_strip_is_native_and_equals_python(spark):
    assert sorted(T.PY_WS_CHARS) == sorted(WS)
    texts = [a + body + b for a in [*WS, "", " \u3000\t"] for body in ("", "x", "a  b", "é\u2003z") for b in ("", "\u2029\r\n")]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "t string").select("t", T.py_strip("t").alias("s"))
    assert "regexp" not in _plan(df)
    assert all(r["s"] == (None if r["t"] is None else r["t"].strip()) for r in df.collect())


def test_lines_equal_splitlines(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("ab\r\n\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029 ") for _ in range(n % 12)) for n in range(600)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", T.split_lines("t").alias("l")).collect()
    assert all(r["l"] == (r["t"].splitlines() or [""]) for r in got)


def test_ascii_text_is_not_translated(spark):
    rows = ["plain -- 'text'", "\u201cq\u201d \u2013 \u2014 \ufb01 x\u00a0y", "", None]
    df = spark.createDataFrame([(t,) for t in rows], "t string").select(T.normalize_unicode("t").alias("n"))
    assert "CASE WHEN" in _plan(df).upper() and "octet_length" in _plan(df)
    assert [r["n"] for r in df.collect()] == ["plain -- 'text'", "\"q\" - - fi x y", "", None]


@pytest.mark.parametrize("cells", [1, 7, 1 << 20])
def test_a_word_is_hashed_once_a_batch(monkeypatch, cells):
    calls = []
    plain = E.word_places
    monkeypatch.setattr(E, "word_places", lambda words, size: (calls.append(len(words)), plain(words, size))[1])
    monkeypatch.setattr(E, "BLOCK_CELLS", cells)
    rows = [["a", "b", "a"], [], ["b"] * 500, ["é", "a"]]
    got = E.dense_counts(pa.array(rows, pa.list_(pa.string())), 5).to_pylist()
    want = [[0] * 5 for _ in rows]
    for k, row in enumerate(rows):
        for w in row:
            h = hashlib.md5(w.encode()).hexdigest()
            want[k][int(h[:8], 16) % 5] += 1 if h[8] < "8" else -1
    assert got == want and calls == [3]
    assert E.dense_counts(pa.array([], pa.list_(pa.string())), 5).to_pylist() == []


def test_norm_is_summed_once_per_vector(spark):
    df = spark.createDataFrame([([3.0, 4.0],), ([0.0, 0.0],), ([],), (None,)], "v array<double>").select(E.l2_normalize("v").alias("u"))
    assert _plan(df).count("aggregate(") == 1
    assert [r["u"] for r in df.collect()] == [[0.6, 0.8], [0.0, 0.0], [], None]


def test_training_counts_words_before_grams(spark):
    texts = [("en", "a bc  bc, d. É2f a"), ("en", "a"), ("de", "über a b"), ("de", "12 ."), ("de", None), (None, "lost text"), ("", "x y")]
    df = spark.createDataFrame(texts, "lang string, text string")
    want = {}
    for lang, t in texts:
        if lang is None or t is None:
            continue
        words = "".join(c if c.isalpha() else " " for c in t.lower()).split()
        s = " " + " ".join(words) + " "
        for i in range(len(s) - 2):
            want[lang, s[i:i + 3]] = want.get((lang, s[i:i + 3]), 0) + 1
    out = LG.train_profile(df)
    assert _plan(out).count("Generate explode") == 2     # words, then the grams of distinct words
    assert {(r["lang"], r["gram"]): r["n"] for r in out.collect()} == want


@pytest.mark.parametrize("many", [0, 250_000])
def test_grams_meet_the_profile_on_an_integer(spark, monkeypatch, many):
    rows = [("en", "the cat sat on the mat"), ("de", "die katze sitzt auf der matte")] * 3
    df = spark.createDataFrame([(k, lang, t) for k, (lang, t) in enumerate(rows)], "k int, lang string, text string")
    model = LG.fit_language_model(df)
    try:
        assert model.grams == model.profile.count()
        monkeypatch.setattr(LG, "MANY_GRAMS", many)
        more = [(90, None, None), (91, None, ""), (92, None, " 12 \u2003"), (93, None, " \u2003the mat ")]
        out = LG.detect_language(df.unionByName(spark.createDataFrame(more, df.schema)), model, "text", 0.9, confidence_col="sure")
        assert "gram_code" in _plan(out)
        got = {r["k"]: r for r in out.collect()}
        assert [got[k]["language"] for k in range(6)] == ["en", "de"] * 3 and got[93]["language"] == "en"
        assert all(got[k]["language"] is None and got[k]["sure"] is None for k in (90, 91, 92))
    finally:
        model.drop()


def test_shingles_are_hashed_without_joining_their_words(spark):
    df = spark.createDataFrame([("a b c d e f a b c d e",), ("a b",), ("ab",), ("",), (None,)], "t string").select(
        F.size(G.shingle_hashes("t")).alias("n"), G.shingle_hashes("t").alias("h"))
    assert "array_join" not in _plan(df)
    got = df.collect()
    assert [r["n"] for r in got] == [6, 1, 1, 0, 0] and got[1]["h"] != got[2]["h"]
