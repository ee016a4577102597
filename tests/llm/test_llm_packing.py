import functools
import random
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from docyard.llm import packing as P
from helpers import docs, edge_rows, words


@functools.cache
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids_of(text):
    return tokenizer().encode(text or "", add_special_tokens=False).ids + [P.END_ID]


def check(rows, got, capacity=P.CAPACITY):
    by_doc = {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
    texts = {}
    for doc, text in rows:
        texts.setdefault(doc, []).append(text)
    for doc, mine in texts.items():
        want = sorted((a, b, zlib.crc32(np.array(ids[a:a + b], dtype="<u4").tobytes()), len(ids))
                      for ids in map(ids_of, mine) for a, b in P.cuts_of(len(ids)))
        assert sorted((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in by_doc[doc]) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return sequences


def test_every_id_once_and_sequences_gapless(spark):
    rng = random.Random(1)
    rows = [r[:2] for r in edge_rows()] + [(100 + k, words(rng, rng.randint(1, 900))) for k in range(150)]
    rows += [(900, "a <|endoftext|> b"), (901, "<|endoftext|>"), (2**60 + 1, "large id")]
    sequences = check(rows, P.pack_documents(docs(spark, rows, clash=True), group_pieces=64).collect())
    filled = sum(sum(n for _, n in s) for s in sequences.values())
    assert filled / (P.CAPACITY * len(sequences)) > 0.9


def test_groups_follow_the_remainders_not_the_documents(spark, monkeypatch):
    """A few very long documents are not one group; full sequences are in none."""
    rows = [(k, "word " * 40_000) for k in range(6)] + [(10 + k, "a b c") for k in range(300)]
    seen = P.pack_documents(docs(spark, rows), group_pieces=20).collect()
    sequences = check(rows, seen)
    assert sum(r["sequence_id"] >= P.FULL for r in seen) == sum(r["length"] == P.CAPACITY for r in seen) > 100
    groups = {}
    for r in seen:
        if r["length"] < P.CAPACITY:
            groups.setdefault(r["sequence_id"] >> 32, []).append(r)
    assert len(groups) > 8 and max(map(len, groups.values())) <= 60 and sequences


def test_differencing_balances_and_keeps_every_item():
    rng = np.random.default_rng(3)
    for n, m in ((1, 1), (3, 5), (40, 7), (500, 60)):
        sizes = rng.integers(1, 500, n)
        windows = P.differencing(sizes, m)
        assert sorted(x for w in windows for x in w) == list(range(n)) and len(windows) <= m
        if n >= 8 * m:
            sums = [sizes[w].sum() for w in windows]
            assert max(sums) - min(sums) < 60


def test_window_count_rises_until_everything_fits():
    sizes = np.array([1500] * 9)
    windows = P.pack(sizes, 2048)
    assert len(windows) == 9 and all(len(w) == 1 for w in windows)
    assert P.pack(np.array([], dtype=np.int64)) in ([], [[]])


def test_encoder_survives_what_the_fast_one_cannot(spark):
    for text in (" " * 300_000, "x" * 20_000, "ab" * 5_000 + "\n" * 3_000):
        assert P.TokenIds(public_tokenizers.path("byte_bpe_50k.json")).encode(text).tolist() == ids_of(text)[:-1]


def test_empty_table(spark):
    assert P.pack_documents(docs(spark, [])).count() == 0
