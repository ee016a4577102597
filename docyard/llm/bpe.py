"""Byte pair encoding and decoding in batched numpy merge rounds.

Texts are cut into words by the vocabulary's pattern. The distinct words of an Arrow batch that the task has not
met yet are laid out as symbols in one flat array, with the word of every symbol beside it. Each round looks up
the rank of every neighbouring pair by binary search over the sorted pair keys, takes each word's lowest rank, and
merges all its occurrences at once (in a run of overlapping ones every second, from the left). Words without a
mergeable pair leave the array. A word's ids are kept for the task's later texts, up to a bound. A very long word (a blob without
blanks) has an array of its own, whose rounds touch only the places of the lowest-rank pair: its work is in proportion to its length.

Decoding concatenates the ids' bytes and reads them as UTF-8, bytes that form no character become U+FFFD.

Defined results: a null text counts as empty: no ids, an empty decoded text; repeated rows are encoded
row by row alike; an empty table gives an empty result; ids of special tokens come from their strings
in a text, as the tokenizer file says; other columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.llm.common import table
from docyard.llm.packing import byte_alphabet

#: Words whose ids a task keeps; beyond it the store starts anew.
KEPT_WORDS = 400_000
#: Symbols merged together; a larger batch of new words is worked off in parts.
FLAT_SYMBOLS = 4_000_000
#: Bytes from which a word is merged in an array of its own.
LONG_WORD = 2_000

_SPACE = r"\p{White_Space}"


def word_pattern(letters: str = r"\p{L}", numbers: str = r"\p{N}") -> str:
    """The vocabulary's word pattern (a fixed value); white space is Unicode's property, spelled out."""
    return (rf"(?V1)'s|'t|'re|'ve|'m|'ll|'d| ?{letters}+| ?{numbers}+"
            rf"| ?[^{_SPACE}{letters}{numbers}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


def newer_characters() -> str:
    """Letters and numbers of the pattern library's (newer) Unicode data that are neither to the tokenizer's library.

    Only characters that Python's own (older) data lacks can differ; the tokenizer's pre-tokenizer is asked about them.
    """
    from tokenizers.pre_tokenizers import ByteLevel

    cutter = ByteLevel(add_prefix_space=False, use_regex=True)
    unknown = "".join(chr(c) for c in range(0x110000) if unicodedata.category(chr(c)) == "Cn")
    return "".join(c for c in regex.findall(r"[\p{L}\p{N}]", unknown)
                   if min(len(cutter.pre_tokenize_str(start + c)) for start in "a1") > 1)


def _ranges(characters: str) -> str:
    out: list[list[int]] = []
    for c in map(ord, characters):
        if out and out[-1][1] == c - 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in out)


class Vocabulary:
    """Merge ranks, ids and bytes of a byte-level tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        vocab, alphabet = spec["model"]["vocab"], byte_alphabet()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, k in vocab.items():
            if token not in self.special:
                self.bytes_of[k] = bytes(alphabet[c] for c in token)
        for token, k in self.special.items():
            self.bytes_of[k] = token.encode()
        self.names = [str(k) for k in range(size)]
        self.start = np.zeros(256, dtype=np.int64)
        for c, b in alphabet.items():
            self.start[b] = vocab[c]
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in spec["model"]["merges"]], dtype=np.int64)
        keys = pairs[:, 0] * size + pairs[:, 1]
        order = np.argsort(keys)
        self.size, self.keys, self.rank, self.merged = size, keys[order], order, pairs[order, 2]
        newer = newer_characters()
        self.newer_from = newer[:1]
        newer = _ranges(newer)
        self.pattern = regex.compile(word_pattern())
        self.careful = regex.compile(word_pattern(rf"[\p{{L}}--[{newer}]]", rf"[\p{{N}}--[{newer}]]")) if newer else None
        self.known: dict[str, bytes] = {}
        self.split = regex.compile("(" + "|".join(regex.escape(s) for s in self.special) + ")") if self.special else None

    def words(self, text: str) -> list[str]:
        """The words of a text that holds no special token."""
        if self.careful is not None and not text.isascii() and max(text) >= self.newer_from:
            return self.careful.findall(text)
        return self.pattern.findall(text)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Place of each pair among the sorted pair keys; their number when it is no pair."""
        key = left * self.size + right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, at, len(self.keys))

    def merge_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, word after word, and the number of ids per word; all words are merged together round by round."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        symbols = self.start[np.frombuffer(b"".join(words), dtype=np.uint8)]
        word = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        rank_of = np.append(self.rank, none)  # the last entry: no pair
        done: list[tuple[np.ndarray, np.ndarray]] = []
        pair = np.full(len(symbols), none)  # of each symbol and the next one
        inside = word[:-1] == word[1:]
        pair[:-1][inside] = self._find(symbols[:-1][inside], symbols[1:][inside])
        while len(symbols):
            rank = rank_of[pair]
            first = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            best = np.minimum.reduceat(rank, first)
            count = np.diff(np.append(first, len(symbols)))
            live = best < none
            if not live.all():
                stays = np.repeat(live, count)
                done.append((word[~stays], symbols[~stays]))
                symbols, word, rank, pair = symbols[stays], word[stays], rank[stays], pair[stays]
                best, count = best[live], count[live]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, count)
            begins = hit & ~np.append(False, hit[:-1])
            place = np.arange(len(hit))
            since = place - np.maximum.accumulate(np.where(begins, place, 0))
            take = hit & (since % 2 == 0)
            symbols[take] = self.merged[pair[take]]
            keep = ~np.append(False, take[:-1])
            changed = take[keep]
            symbols, word, pair = symbols[keep], word[keep], pair[keep]
            # only pairs that touch a merged symbol are looked up again
            again = np.flatnonzero(changed | np.append(changed[1:], False))
            nxt = again + 1
            real = nxt < len(symbols)
            real[real] = word[again[real]] == word[nxt[real]]
            pair[again] = none
            pair[again[real]] = self._find(symbols[again[real]], symbols[nxt[real]])
        if not done:
            return np.zeros(0, dtype="<u4"), np.zeros(len(words), dtype=np.int64)
        owner = np.concatenate([d[0] for d in done])
        ids = np.concatenate([d[1] for d in done]).astype("<u4")
        return ids[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words))

    def merge_long(self, word: bytes) -> np.ndarray:
        """Ids of one long word. Merged symbols stay in place as gaps; each round looks at its pair's places and their neighbours."""
        symbols = self.start[np.frombuffer(word, dtype=np.uint8)]
        end, none = len(symbols), len(self.keys)
        after, before = np.arange(1, end + 1), np.arange(-1, end - 1)
        pair = np.full(end, none)  # of each symbol and the one after it; gaps have none
        pair[:-1] = self._find(symbols[:-1], symbols[1:])
        waiting: dict[int, list[np.ndarray]] = {}  # places where a pair was seen; some may be out of date
        ranks: list[tuple[int, int]] = []

        def note(places: np.ndarray) -> None:
            places = places[pair[places] < none]
            places = places[np.argsort(pair[places], kind="stable")]
            cuts = np.flatnonzero(np.diff(pair[places])) + 1
            for part in np.split(places, cuts) if len(places) else []:
                p = int(pair[part[0]])
                if p not in waiting:
                    heapq.heappush(ranks, (int(self.rank[p]), p))
                waiting.setdefault(p, []).append(part)

        note(np.arange(end))
        while ranks:
            _, p = heapq.heappop(ranks)
            places = np.unique(np.concatenate(waiting.pop(p)))
            places = places[pair[places] == p]
            if not len(places):
                continue
            begins = np.append(True, after[places[:-1]] != places[1:])
            turn = np.arange(len(places))
            left = places[(turn - np.maximum.accumulate(np.where(begins, turn, 0))) % 2 == 0]
            right = after[left]
            symbols[left], pair[right] = self.merged[p], none
            after[left] = after[right]
            inner = after[left] < end
            before[after[left[inner]]] = left[inner]
            symbols[right] = -1
            touched = np.unique(np.append(before[left], left))
            touched = touched[touched >= 0]
            pair[touched] = none
            real = touched[after[touched] < end]
            pair[real] = self._find(symbols[real], symbols[after[real]])
            note(real)
        return symbols[symbols >= 0].astype("<u4")

    def learn(self, words: Iterable[str]) -> None:
        """Keep the ids of words not met before, merged in parts of at most about FLAT_SYMBOLS symbols."""
        part: list[str] = []
        size = 0
        for w in words:
            part.append(w)
            size += len(w)
            if size >= FLAT_SYMBOLS:
                self._learn(part)
                part, size = [], 0
        if part:
            self._learn(part)

    def _learn(self, part: list[str]) -> None:
        short: list[str] = []
        coded: list[bytes] = []
        for w in part:
            code = w.encode("utf-8", "surrogatepass")
            if len(code) < LONG_WORD:
                short.append(w)
                coded.append(code)
            else:
                self.known[w] = self.merge_long(code).tobytes()
        ids, sizes = self.merge_words(coded)
        raw, ends = ids.tobytes(), (np.cumsum(sizes) * 4).tolist()
        at = 0
        for w, end in zip(short, ends):
            self.known[w] = raw[at:end]
            at = end

    def encode_batch(self, texts: Iterable[str | None]) -> Iterator[np.ndarray]:
        """Ids (uint32) per text."""
        special = {s: np.array([k], dtype="<u4").tobytes() for s, k in self.special.items()}
        parts: list[list[str]] = []
        with_special: set[int] = set()
        for text in texts:
            text = text or ""
            if any(s in text for s in special):
                with_special.add(len(parts))
                parts.append([w for piece in self.split.split(text)
                              for w in ([piece] if piece in special else self.words(piece))])
            else:
                parts.append(self.words(text))
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        self.learn(set().union(*parts) - self.known.keys() - special.keys())
        for k, mine in enumerate(parts):
            look = (lambda w: special.get(w) or self.known[w]) if k in with_special else self.known.__getitem__
            yield np.frombuffer(b"".join(map(look, mine)), dtype="<u4")

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


@functools.lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One vocabulary per Python worker."""
    return Vocabulary(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded) of every whole text."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    return docs.select("doc_id", _coder(path, digests=False)("text").alias("r")).select(
        "doc_id", "r.ids", "r.decoded")


def _coder(path: str, digests: bool):
    kind = ("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>" if digests
            else "struct<ids:array<int>,decoded:string>")

    @F.pandas_udf(kind)
    def code(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        v = vocabulary(path)
        for texts in batches:
            rows = []
            step = 512  # texts whose words are learned together
            values = texts.to_list()
            for a in range(0, len(values), step):
                for ids in v.encode_batch(values[a:a + step]):
                    decoded = v.decode(ids)
                    if digests:
                        listed = ",".join(map(v.names.__getitem__, ids.tolist()))
                        rows.append((len(ids), hashlib.sha256(listed.encode()).hexdigest(),
                                     hashlib.sha256(decoded.encode("utf-8", "surrogatepass")).hexdigest()))
                    else:
                        rows.append((ids.astype(np.int32), decoded))
            yield pd.DataFrame(rows, columns=["n_tokens", "ids_sha256", "decoded_sha256"] if digests
                               else ["ids", "decoded"])
    return code


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    coded = _coder(public_tokenizers.path("byte_bpe_50k.json"), digests=True)
    return docs.select("doc_id", coded("text").alias("r")).select("doc_id", "r.n_tokens", "r.ids_sha256", "r.decoded_sha256")
