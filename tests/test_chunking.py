"""K1-K7: fixed windows, sentence spans, packing, strategy switch, BPE windows."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from docyard.functions.arrays import pack_spans
from docyard.operators import chunking as K
from docyard.operators.tokenize import TOKEN_PATTERN


def docs(spark, texts):
    return spark.createDataFrame([(i, t, "src", "a.md", "markdown") for i, t in enumerate(texts)],
                                 "doc_id int, content string, tenant_id string, source_path string, format string")


def windows_by_formula(tokens, size, overlap):
    """Fixed windows from their number: window k covers tokens k*step up to k*step+size."""
    n, step = len(tokens), size - overlap
    number = 0 if n == 0 else 1 if n <= size else math.ceil((n - size) / step) + 1
    place = [0, *itertools.accumulate(map(len, tokens))]
    return [(k, "".join(tokens[k * step:k * step + size]), place[k * step], place[min(n, k * step + size)]) for k in range(number)]


def spans_by_prefix_sums(counts, size, overlap):
    """Sentence packing from prefix sums P: the end of a chunk, and where the next one starts, depend on its start only."""
    total, n = [0, *itertools.accumulate(counts)], len(counts)
    out, i = [], 0
    while i < n:
        end = max(i + 1, max(e for e in range(i, n + 1) if total[e] - total[i] <= size))
        out.append((i, end - 1))
        back = [s for s in range(i, end) if total[end] - total[s] >= overlap]
        i = n if end == n else end if overlap <= 0 or not back or max(back) <= i else max(back)
    return out


def test_fixed_overlap_tokens_equal(spark, sample_text):
    import regex
    d = docs(spark, [(sample_text + " ") * 20])
    rows = K.chunk_fixed(d, 20, 0.2).orderBy("chunk_index").collect()
    assert len(rows) > 1
    toks = [regex.findall(TOKEN_PATTERN.replace(r"\x0b", "\x0b"), r["text"]) for r in rows]
    for a, b in zip(toks, toks[1:]):
        assert a[-4:] == b[:4]
    assert all(r["chunk_strategy"] == "fixed" for r in rows)


def test_fixed_single_chunk_and_metadata(spark, sample_text):
    rows = K.chunk_fixed(docs(spark, [sample_text]), 512, 0.15).collect()
    assert len(rows) == 1 and rows[0]["text"] == sample_text
    assert rows[0]["source_path"] == "a.md" and rows[0]["format"] == "markdown"
    assert (rows[0]["start_char"], rows[0]["end_char"]) == (0, len(sample_text))


def test_fixed_windows_match_the_formula(spark):
    import regex
    rnd = random.Random(7)
    words = ["alpha", "beta", "γάμμα", "12345", "!!", "\n", "  ", "é", "x.y"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", ""]) for _ in range(rnd.randint(0, 120)))
             for _ in range(40)]
    pat = regex.compile(TOKEN_PATTERN)
    for size, pct in ((8, 0.25), (5, 0.0), (13, 0.5)):
        got = {}
        for r in K.chunk_fixed(docs(spark, texts), size, pct).collect():
            got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["text"], r["start_char"], r["end_char"]))
        for i, t in enumerate(texts):
            want = windows_by_formula(pat.findall(t), size, int(size * pct))
            assert sorted(got.get(i, [])) == want


def test_fixed_step_error_only_for_text(spark):
    with pytest.raises(Exception, match="chunk_overlap_pct must produce a positive chunk step"):
        K.chunk_fixed(docs(spark, ["some words here"]), 10, 1.0).collect()
    assert K.chunk_fixed(docs(spark, [""]), 10, 1.0).count() == 0


def test_pack_spans_match_the_prefix_sums():
    rnd = random.Random(3)
    for _ in range(3000):
        counts = [rnd.randint(1, 30) for _ in range(rnd.randint(0, 25))]
        size, overlap = rnd.randint(1, 60), rnd.randint(0, 20)
        assert pack_spans(counts, size, overlap) == spans_by_prefix_sums(counts, size, overlap)


def test_semantic_chunks_end_on_sentences(spark):
    text = ("The first sentence is here. The second sentence follows it! Is this the third one? "
            "Yes it is.")
    rows = K.chunk_semantic(docs(spark, [text]), 12, 0.25).orderBy("chunk_index").collect()
    assert len(rows) >= 2
    for r in rows:
        assert r["text"][-1] in ".?!"
        assert text[r["start_char"]:r["end_char"]] == r["text"]
        assert r["chunk_strategy"] == "semantic"


def test_semantic_long_sentence_and_blank(spark):
    long = "word " * 50 + "end."
    rows = K.chunk_semantic(docs(spark, [long, "   \n  "]), 10, 0.2).collect()
    assert len(rows) == 1 and rows[0]["doc_id"] == 0


def test_sentence_offsets(spark):
    text = "  Hello there.  General Kenobi!\n\nYou are a bold one.   "
    rows = K.sentences(docs(spark, [text])).orderBy("sentence_index").collect()
    assert [r["text"] for r in rows] == ["Hello there.", "General Kenobi!", "You are a bold one."]
    for r in rows:
        assert text[r["start_char"]:r["end_char"]] == r["text"]


def test_strategy_switch(spark, sample_text):
    d = docs(spark, [sample_text])
    assert K.chunk(d, "fixed").first()["chunk_strategy"] == "fixed"
    assert K.chunk(d, "anything-else").first()["chunk_strategy"] == "semantic"


def test_bpe_windows_offsets_match_prefix_decode():
    from docyard.operators.tokenize import bpe_encoding
    enc = bpe_encoding()
    text = "Grüße aus Köln — naïve café, 東京 and more text " * 30
    toks = enc.encode_ordinary(text)
    for idx, chunk_text, cs, ce, n in K.bpe_windows(text, 50, 10, enc):
        start = idx * 40
        assert cs == len(enc.decode(toks[:start]))
        assert chunk_text == enc.decode(toks[start:start + 50]) and ce == cs + len(chunk_text)


def test_bpe_chunks_in_spark(spark, sample_text):
    rows = K.chunk_fixed(docs(spark, [sample_text * 5]), 30, 0.2, tokenizer="bpe").collect()
    assert len(rows) > 1 and all(r["n_tokens"] <= 30 for r in rows)


def test_document_id_deterministic(spark):
    df = spark.createDataFrame([("t", "a/b.md", None), ("t", "a/b.md", None), (None, "a/b.md", 2)],
                               "tenant_id string, source_path string, page_number int")
    ids = [r["i"] for r in df.select(K.document_id().alias("i")).collect()]
    assert ids[0] == ids[1] != ids[2] and len(ids[0]) == 64


def test_fixed_window_counts_match_cut_windows(spark):
    import regex
    rnd = random.Random(9)
    words = ["alpha", "beta", "12345", "!!", "\n", "  ", "é"]
    texts = ["".join(rnd.choice(words) + " " for _ in range(rnd.randint(0, 400))) for _ in range(30)]
    pat = regex.compile(TOKEN_PATTERN)
    df = spark.createDataFrame([(i, len(pat.findall(t))) for i, t in enumerate(texts)], "doc_id int, n int")
    for size, pct in ((20, 0.1), (16, 0.25), (7, 0.0)):
        got = {r["doc_id"]: (r["w"]["chunks"], r["w"]["tokens"])
               for r in df.select("doc_id", K.fixed_window_counts("n", size, pct).alias("w")).collect()}
        for i, t in enumerate(texts):
            cut = windows_by_formula(pat.findall(t), size, int(size * pct))
            assert got[i] == (len(cut), sum(len(pat.findall(w[1])) for w in cut))


def test_sentences_end_without_blanks_in_ideographic_text(spark):
    text = "これは一文です。次の文は長い！終わり？「引用。」 最後"
    got = [r["text"] for r in K.sentences(docs(spark, [text])).orderBy("sentence_index").collect()]
    assert got == ["これは一文です。", "次の文は長い！", "終わり？", "「引用。」", "最後"]
    many = "".join(f"第{k}句子就在这里。" for k in range(400))
    assert K.chunk_semantic(docs(spark, [many]), 64, 0.1).count() > 10
    assert [r["text"] for r in K.sentences(docs(spark, ["Wait… what?” Yes."])).collect()] == ["Wait…", "what?”", "Yes."]


def test_tokenizer_and_chunker_settings(spark, sample_text):
    d = docs(spark, [sample_text])
    with pytest.raises(ValueError, match="bpe with semantic"):
        K.chunk(d, "semantic", tokenizer="bpe")
    with pytest.raises(ValueError, match="words with fixed"):
        K.chunk(d, "fixed", tokenizer="words")
    own = K.chunk(d, chunker=lambda df: df.withColumn("text", F.col("content")).withColumn("chunk_index", F.lit(0)))
    assert own.first()["text"] == sample_text
    with pytest.raises(ValueError, match="no column chunk_index"):
        K.chunk(d, chunker=lambda df: df.withColumnRenamed("content", "text"))


def test_line_windows_by_table_function_and_natively(spark):
    rows = [(1, "a\nb\nc\nd\ne\nf\ng\nh"), (2, None), (3, ""), (4, "one"), (5, "\n\n"), (6, "é😀\n\nx\ny"), (7, "a\nb\nc\nd\ne")]
    df = spark.createDataFrame(rows, "k int, content string").withColumn("kept", F.lit("meta"))
    names = ["k", "kept", "chunk_index", "start_char", "end_char", "text"]
    for size, step in ((4, 3), (2, 2), (1, 1), (3, 1)):
        one = sorted(map(tuple, K.chunk_by_table_function(df, K.LineWindows, F.lit(size), F.lit(step)).select(names).collect()))
        two = sorted(map(tuple, K.chunk_lines(df, size, step).select(names).collect()))
        assert one == two and {r[0] for r in one} == {1, 4, 5, 6, 7}
        for k, _, _, a, b, text in one:
            assert dict(rows)[k][a:b] == text
    got = K.chunk(df, chunker=lambda d: K.chunk_by_table_function(d, K.LineWindows, F.lit(4), F.lit(3)))
    assert [r["text"] for r in got.filter("k = 7").orderBy("chunk_index").collect()] == ["a\nb\nc\nd", "d\ne"]
