"""Small Arrow-batched helpers over integer arrays.

Spark has no running-sum over an array, and a window over exploded rows would
shuffle every chunk by document. These helpers receive only int arrays (never
the text), work on a whole Arrow batch at once with numpy, and return int
arrays, so the Python hop stays cheap and linear in the array lengths.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def _flat(lists: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flattened values and per-row lengths of a list array (nulls as empty)."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = pc.list_flatten(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    return values, lengths


def _to_list_array(values: np.ndarray, lengths: np.ndarray, validity: pa.Array, typ) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    mask = pc.invert(validity) if validity is not None else None
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, typ), mask=mask)


@F.arrow_udf(ArrayType(IntegerType()))
def prefix_offsets(lens: pa.Array) -> pa.Array:
    """Exclusive running sum per row: ``[a, b, c] -> [0, a, a+b]``."""
    if isinstance(lens, pa.ChunkedArray):
        lens = lens.combine_chunks()
    values, lengths = _flat(lens)
    cs = np.cumsum(values)
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.zeros(0, np.int64)
    base = np.where(starts > 0, cs[np.maximum(starts - 1, 0)] if len(cs) else 0, 0)
    out = cs - values - np.repeat(base, lengths)
    return _to_list_array(out, lengths, pc.is_valid(lens), pa.int32())


def pack_spans(counts: np.ndarray, size: int, overlap: int) -> list[tuple[int, int]]:
    """Greedy sentence packing over token counts, as (first, last) sentence indices.

    A chunk takes sentences while they fit in ``size`` tokens (a single
    over-long sentence is a chunk of its own). The next chunk steps back whole
    sentences until they hold at least ``overlap`` tokens; if that walks back
    to the current start, the next chunk starts where this one ended.
    """
    n = len(counts)
    if n == 0:
        return []
    prefix = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(counts, out=prefix[1:])
    spans = []
    i = 0
    while i < n:
        end = int(np.searchsorted(prefix, prefix[i] + size, side="right")) - 1
        end = max(i + 1, min(end, n))
        spans.append((i, end - 1))
        if end >= n:
            break
        if overlap <= 0:
            i = end
            continue
        # largest s in [i, end) with prefix[end] - prefix[s] >= overlap, else i
        s = int(np.searchsorted(prefix, prefix[end] - overlap, side="right")) - 1
        s = max(s, i)
        i = end if s <= i else s
    return spans


SPAN_TYPE = ArrayType(StructType([StructField("first", IntegerType()), StructField("last", IntegerType())]))


def make_pack_udf(size: int, overlap: int):
    """Arrow UDF: array<int> token counts -> array<struct<first, last>>."""

    @F.arrow_udf(SPAN_TYPE)
    def pack(counts: pa.Array) -> pa.Array:
        if isinstance(counts, pa.ChunkedArray):
            counts = counts.combine_chunks()
        values, lengths = _flat(counts)
        firsts: list[int] = []
        lasts: list[int] = []
        out_len = np.zeros(len(lengths), dtype=np.int64)
        pos = 0
        for row, ln in enumerate(lengths):
            spans = pack_spans(values[pos:pos + ln], size, overlap) if ln else []
            pos += ln
            out_len[row] = len(spans)
            for a, b in spans:
                firsts.append(a)
                lasts.append(b)
        structs = pa.StructArray.from_arrays(
            [pa.array(firsts, pa.int32()), pa.array(lasts, pa.int32())], names=["first", "last"])
        offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
        np.cumsum(out_len, out=offsets[1:])
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), structs,
                                        mask=pc.invert(pc.is_valid(counts)))

    return pack


__all__ = ["prefix_offsets", "pack_spans", "make_pack_udf", "SPAN_TYPE"]
