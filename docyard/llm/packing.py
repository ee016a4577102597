"""Packing: documents as token sequences of near-equal length by Karmarkar-Karp differencing.

Every document becomes its token ids plus an end id and is cut into pieces of at most ``PIECE`` ids
(whole sequences of ``CAPACITY`` first, which need no group). The remainders are counted and spread over groups of bounded size; each
group is one task's work and is solved by multiway differencing: every piece starts as a partial partition with one
filled window, and the two partial partitions with the largest imbalance are merged so that the fullest
windows of one meet the emptiest of the other, until one partition is left. When its fullest window exceeds
the capacity, the number of windows rises to the least count at which that imbalance would fit, and the group is
solved again.

Only (id, start, length, checksum) of a piece is shuffled, never the ids. Groups are dealt by a hash of a piece's
place in the scan, so repeated ids or a hot source do not gather in one group.

Defined results: a null or empty text is the end id alone; repeated rows are packed row by row; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.llm.common import cut as lineage_cut
from docyard.llm.common import table
from docyard.session import ship_package

CAPACITY = 2048
END_ID = 1
#: Longest piece that shares a sequence with others; shorter pieces balance better, longer ones cut documents less.
PIECE = 512
#: Wanted pieces per group (one task's work).
GROUP_PIECES = 2048
#: Sequence numbers of full pieces start here, above those of the groups.
FULL = 1 << 62

#: Stands for a null id inside the tasks (pandas would turn a column with nulls into floats).
NO_ID = -(1 << 63)

PIECE_TYPE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, salt long"
PACKED_TYPE = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
               "sequence_id long, offset long")


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 stands for itself, the rest follows from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(rest)}


class TokenIds:
    """Ids of the tokenizer file, by the fast encoder of the same vocabulary; the file's own library where that fails."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as fh:
            spec = json.load(fh)
        alphabet = byte_alphabet()
        self.path, self.slow = path, None
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(alphabet[c] for c in token): k for token, k in spec["model"]["vocab"].items()
                 if token not in special}
        self.fast = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                                      special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        try:
            return np.asarray(self.fast.encode_to_numpy(text, allowed_special="all"), dtype=np.uint32)
        except BaseException as problem:  # noqa: BLE001  the encoder panics on some very long runs
            if isinstance(problem, (KeyboardInterrupt, SystemExit, MemoryError)):
                raise
        if self.slow is None:
            from tokenizers import Tokenizer

            self.slow = Tokenizer.from_file(self.path)
            self.slow.no_truncation()
            self.slow.no_padding()
        return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts_of(length: int, capacity: int = CAPACITY, piece: int = PIECE) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: full sequences first, then parts of at most ``piece``."""
    out = [(at, capacity) for at in range(0, length - capacity + 1, capacity)]
    at = len(out) * capacity
    while at < length:
        size = min(piece, length - at)
        out.append((at, size))
        at += size
    return out


def differencing(sizes: np.ndarray, windows: int) -> list[list[int]]:
    """Karmarkar-Karp: item numbers of each of ``windows`` windows with near-equal sums.

    A partial partition holds the imbalance of its filled windows (fullest first) and a chain per window;
    windows it has not filled yet are empty and count 0.
    """
    n = len(sizes)
    left, right = list(range(n)), [-1] * n  # a chain is an item or two chains
    heap = [(-int(s), k, np.array([int(s)], dtype=np.int64), np.array([k], dtype=np.int64)) for k, s in enumerate(sizes)]
    heapq.heapify(heap)
    made = n
    while len(heap) > 1:
        _, _, a, ca = heapq.heappop(heap)
        _, _, b, cb = heapq.heappop(heap)
        if len(a) < len(b):
            a, ca, b, cb = b, cb, a, ca
        shared = len(a) + len(b) - windows
        if shared > 0:  # the fullest of b join the emptiest of a
            meet = np.arange(len(a) - 1, len(a) - 1 - shared, -1)
            a, ca = a.copy(), ca.copy()
            a[meet] += b[:shared]
            for at, chain in zip(meet, cb[:shared]):
                left.append(int(ca[at]))
                right.append(int(chain))
                ca[at] = len(left) - 1
            b, cb = b[shared:], cb[shared:]
        sums, chains = np.concatenate([a, b]), np.concatenate([ca, cb])
        order = np.argsort(-sums, kind="stable")
        sums, chains = sums[order], chains[order]
        if len(sums) == windows:
            sums = sums - sums[-1]
        made += 1
        heapq.heappush(heap, (-int(sums[0]), made, sums, chains))
    out = []
    for chain in heap[0][3] if heap else []:
        items, stack = [], [int(chain)]
        while stack:
            c = stack.pop()
            if right[c] < 0:
                items.append(c)
            else:
                stack += [left[c], right[c]]
        out.append(sorted(items))
    return out


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Item numbers per window; the window count rises while a window exceeds the capacity."""
    total = int(sizes.sum())
    windows = max(1, -(-total // capacity))
    while True:
        filled = differencing(sizes, windows)
        most = max((int(sizes[w].sum()) for w in filled), default=0)
        if most <= capacity:
            return filled
        room = capacity - (most - total / windows)
        windows = max(windows + 1, min(len(sizes), int(-(-total // room)) if room > 0 else windows + 1))


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, piece: int = PIECE) -> DataFrame:
    """One narrow row per piece; ``salt`` numbers the pieces of a scan task."""
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder, seen = TokenIds(path), 0
        for pdf in batches:
            rows = []
            for doc, text, part in zip(pdf["doc_id"], pdf["text"], pdf["part"]):
                ids = np.append(encoder.encode(text), np.uint32(END_ID)).astype("<u4")
                for start, size in cuts_of(len(ids), capacity, piece):
                    rows.append((doc, start, size, zlib.crc32(ids[start:start + size].tobytes()), len(ids),
                                 (int(part) << 40) + seen))
                    seen += 1
            yield pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "salt"])

    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"),
                        F.spark_partition_id().alias("part"))
    return texts.mapInPandas(cut, PIECE_TYPE)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, piece: int = PIECE,
                   group_pieces: int = GROUP_PIECES) -> DataFrame:
    """One row per piece with its sequence and its offset there."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    cuts = lineage_cut(pieces(docs, path, capacity, piece))  # narrow rows, kept once: they are counted before they are grouped
    # a full piece is a sequence of its own; groups hold remainders only, so their size does not depend on how long documents are
    full = cuts.filter(F.col("length") == capacity).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.lit(FULL) + F.col("salt")).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"))
    rest = cuts.filter(F.col("length") < capacity)
    groups = max(1, -(-rest.count() // group_pieces))
    grouped = rest.withColumn("grp", F.pmod(F.xxhash64("salt"), F.lit(groups)))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("salt", kind="stable").reset_index(drop=True)
        sizes = pdf["length"].to_numpy(dtype=np.int64)
        windows = pack(sizes, capacity)
        sequence, offset = np.zeros(len(pdf), dtype=np.int64), np.zeros(len(pdf), dtype=np.int64)
        for number, items in enumerate(windows):
            sequence[items] = number
            offset[items] = np.cumsum(sizes[items]) - sizes[items]
        pdf["sequence_id"] = (pdf["grp"].to_numpy(dtype=np.int64) << 32) + sequence
        pdf["offset"] = offset
        return pdf[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return (grouped.groupBy("grp").applyInPandas(solve, PACKED_TYPE).unionByName(full)
            .withColumn("doc_id", F.nullif("doc_id", F.lit(NO_ID))))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return pack_documents(docs)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
