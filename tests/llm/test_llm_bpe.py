import random
import time

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from docyard.llm import bpe as B
from helpers import docs, edge_rows

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def same(library, texts):
    v = B.vocabulary(PATH)
    for text, ids in zip(texts, v.encode_batch(texts)):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert ids.tolist() == want, repr(text)[:200]
        assert v.decode(ids) == library.decode(want, skip_special_tokens=False)
        assert v.decode(ids) == (text or "")


def test_hard_texts(library):
    rng = random.Random(3)
    texts = [None, "", " ", "\n\n", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "don't I'LL 've'",
             "aaaaaaaaaaaaaaa", "x" * 5000, " " * 4000 + "z", "12345 678", "漢字かな交じり文", "👩‍👩‍👧‍👦 é", "\x00\x1c\x85 ",
             "\U000323b0՘Ᲊ", "ﷺ" * 50]
    texts += ["".join(rng.choice("ab c'sét \n\t1<|endoftext|>é漢😀.") for _ in range(rng.randint(0, 80))) for _ in range(400)]
    same(library, texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=6))
def test_any_text(texts):
    t = Tokenizer.from_file(PATH)
    same(t, texts)


def test_decoding_any_ids(library):
    rng = random.Random(1)
    v = B.vocabulary(PATH)
    for _ in range(200):
        ids = [rng.randrange(50257) for _ in range(rng.randint(0, 30))]
        assert v.decode(np.array(ids, dtype=np.uint32)) == library.decode(ids, skip_special_tokens=False)


def test_small_stores_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(B, "KEPT_WORDS", 20)
    monkeypatch.setattr(B, "FLAT_SYMBOLS", 50)
    B.vocabulary(PATH).known.clear()
    same(library, ["some words that are many more than twenty in all " * 3, "other words, too; 1 2 3 4 5 6 7 8 9 10 11 12"] * 4)


def test_query_digests(spark, library, tmp_path):
    import hashlib

    rows = edge_rows()
    docs(spark, rows, clash=True).write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in B.op9(spark, str(tmp_path)).collect()), key=str)
    want = []
    for doc, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        want.append((doc, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
                     hashlib.sha256((text or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    out = {r["doc_id"]: r for r in B.encode_decode(docs(spark, [(1, "a b"), (2, None)])).collect()}
    assert out[1]["decoded"] == "a b" and out[2]["ids"] == [] and B.encode_decode(docs(spark, [])).count() == 0


def test_long_words_in_arrays_of_their_own(library, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices(letters, k=n)) for n in (2_000, 2_001, 9_000, 60_000)
             for letters in ("a", "ab", "abcdefghijklmnopqrstuvwxyz", "éß漢", "0123456789abcdef")]
    same(library, texts)
    monkeypatch.setattr(B, "LONG_WORD", 1)  # every word takes that path
    B.vocabulary(PATH).known.clear()
    same(library, ["", "a", "ab", "aaaa aaa aa a", "<|endoftext|>x", "don't stop"] + [t[:300] for t in texts]
         + ["".join(rng.choice("ab c's\n1é漢😀") for _ in range(rng.randint(0, 60))) for _ in range(300)])


def test_long_words_cost_in_proportion_to_their_length():
    v = B.vocabulary(PATH)
    word = "".join(random.Random(2).choices("abcdefghijklmnopqrstuvwxyz", k=1_000_000)).encode()
    start = time.time()
    v.merge_long(word)
    assert time.time() - start < 20
