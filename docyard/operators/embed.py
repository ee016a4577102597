"""Batch embedding with a pluggable model, plus vector helpers.

The model is a factory ``make_model() -> predict(texts: np.ndarray) -> 2-D array``,
built once per Python worker by Spark's ``predict_batch_udf`` and fed Arrow
batches of ``batch_size`` texts. Every batch is checked: one vector per text
and the declared width (the reference checked only the count). Transient
errors from remote models are retried with exponential waits; losing a
worker is handled by Spark's task retry.

The default, download-free model is signed feature hashing of lower-case word tokens (MD5 picks
dimension and sign), L2-normalised. Words are found by native expressions and counted Arrow batch by Arrow batch: a batch's
words are dictionary-encoded, so a word is hashed once a batch however often it occurs. ``hashed_runs`` is the sparse form, all native.
"""

from __future__ import annotations

import functools
import hashlib
import time
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, IntegerType

from docyard.functions.text import bind_column

BATCH_ERROR = "embed_batch_size must be greater than 0"
CONCURRENCY_ERROR = "embed_max_concurrency must be greater than 0"


@dataclass(frozen=True)
class RetryPolicy:
    """Bounded retry for transient model errors (attempts, wait 1..60 s doubling)."""
    attempts: int = 5
    min_wait: float = 1.0
    max_wait: float = 60.0
    retry_on: tuple = field(default_factory=lambda: (ConnectionError, TimeoutError))

    def call(self, fn, *args, sleep=time.sleep):
        for attempt in range(1, self.attempts + 1):
            try:
                return fn(*args)
            except self.retry_on:
                if attempt == self.attempts:
                    raise
                sleep(min(self.max_wait, max(self.min_wait, self.min_wait * 2 ** (attempt - 1))))
        raise RuntimeError("unreachable")


# Fixed value: what counts as a word of the default model.
WORD = r"[\p{L}\p{M}\p{N}]+"
#: Counters filled at once in a Python worker.
BLOCK_CELLS = 1 << 20


def words(text: Column | str) -> Column:
    """The text's lower-case words in order; none for a missing text."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(WORD), 0)


def _let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often ``use`` refers to it."""
    return F.get(F.transform(F.array(value), use), 0)


def hashed_runs(text: Column | str, vector_size: int = 64) -> Column:
    """Signed feature hashing, sparse: (place, n) per dimension that a word falls on, by place.

    A word's first eight MD5 digits choose its dimension, the ninth its sign (8 to f: minus). The words' codes (place
    and sign in one integer) are sorted; a run of one place is one entry: n is its words counted with their signs.
    """
    def code(word: Column) -> Column:
        return _let(F.md5(word), lambda digest: (
            F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint") % vector_size * 2
            + F.when(F.substring(digest, 9, 1) < "8", 0).otherwise(1)).cast("int"))

    place = lambda x: F.shiftright(x, 1)

    def runs(codes: Column) -> Column:
        marked = F.transform(codes, lambda x, i: F.named_struct(
            F.lit("place"), place(x), F.lit("at"), i, F.lit("before"), place(F.get(codes, i - 1))))
        return _let(F.filter(marked, lambda r: r["before"].isNull() | (r["before"] != r["place"])), lambda first: F.transform(
            first, lambda r, j: F.named_struct(F.lit("place"), r["place"], F.lit("n"), F.aggregate(
                F.slice(codes, r["at"] + 1, F.coalesce(F.get(first, j + 1)["at"], F.size(codes)) - r["at"]),
                F.lit(0), lambda n, x: n + F.lit(1) - F.lit(2) * x.bitwiseAND(F.lit(1))))))

    return _let(F.sort_array(F.transform(words(text), code)), runs)


def word_places(words: list[str], vector_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Each word's dimension and sign."""
    digests = np.frombuffer(b"".join(hashlib.md5(w.encode()).digest()[:5] for w in words), dtype=np.uint8).reshape(-1, 5)
    head = np.ascontiguousarray(digests[:, :4]).view(">u4").ravel().astype(np.int64)
    return head % vector_size, np.where(digests[:, 4] < 0x80, 1, -1)


def dense_counts(words: pa.Array, vector_size: int) -> pa.Array:
    """Signed word counts per dimension of each row's words; rows are counted in blocks of bounded size."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    ends = np.concatenate([[0], np.cumsum(words.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int64)
    coded = words.flatten().dictionary_encode()
    places, signs = word_places(coded.dictionary.to_pylist(), vector_size)
    at = coded.indices.to_numpy(zero_copy_only=False)
    out = np.zeros((len(words), vector_size), dtype=np.int32)
    block = max(1, BLOCK_CELLS // vector_size)
    for a in range(0, len(words), block):
        n = min(block, len(words) - a)
        mine = at[ends[a]:ends[a + n]]
        cells = np.repeat(np.arange(n) * vector_size, np.diff(ends[a:a + n + 1])) + places[mine]
        out[a:a + n] = np.bincount(cells, signs[mine], n * vector_size).reshape(n, vector_size)
    offsets = pa.array(np.arange(len(words) + 1, dtype=np.int64) * vector_size, pa.int32())
    return pa.ListArray.from_arrays(offsets, pa.array(out.ravel(), pa.int32()))


@functools.lru_cache(maxsize=None)
def _counts_udf(vector_size: int):
    @F.arrow_udf(ArrayType(IntegerType()))
    def hashed_word_counts(words: pa.Array) -> pa.Array:
        return dense_counts(words, vector_size)
    return hashed_word_counts


def hashed_counts(text: Column | str, vector_size: int = 64) -> Column:
    """``hashed_runs`` as a dense vector of integers.

    The work grows with words + width, not with their product.
    """
    return _counts_udf(vector_size)(words(text))


def hashed_embedding(df: DataFrame, text_col: str, out_col: str, vector_size: int = 64,
                     counts_col: str | None = None) -> DataFrame:
    """Add the counts at unit length (a text without words is the zero vector), and on request the counts."""
    at = counts_col or "_counts"
    counted = bind_column(df, at, hashed_counts(text_col, vector_size))
    out = counted.withColumn(out_col, F.transform(l2_normalize(at), lambda x: x.cast("float")))
    return out if counts_col else out.drop(at)


def checked_predict(model, vector_size: int, retry: RetryPolicy | None):
    """Wrap a model so every batch is retried on transient errors and checked."""
    state = {"batch": 0}

    def predict(texts: np.ndarray) -> np.ndarray:
        state["batch"] += 1
        vectors = retry.call(model, texts) if retry else model(texts)
        vectors = np.asarray(vectors, dtype=np.float32)
        if vectors.ndim != 2 or len(vectors) != len(texts):
            n = len(vectors) if vectors.ndim >= 1 else 0
            raise ValueError(f"Embedder returned {n} vectors for {len(texts)} chunks in batch {state['batch']}")
        if vectors.shape[1] != vector_size:
            raise ValueError(f"Embedder returned vectors of width {vectors.shape[1]}, expected {vector_size}")
        return vectors

    return predict


def embed(df: DataFrame, text_col: str = "text", out_col: str = "embedding", model_factory=None,
          vector_size: int = 64, batch_size: int = 256, max_concurrency: int | None = None,
          retry: RetryPolicy | None = RetryPolicy()) -> DataFrame:
    """Add ``out_col`` ARRAY<FLOAT> from the model, in Arrow batches of ``batch_size``.

    ``max_concurrency`` caps the tasks that call the model at once (for rate
    limited remote models) by spreading the rows over that many partitions;
    by default every task slot embeds.
    """
    from pyspark.ml.functions import predict_batch_udf

    if batch_size <= 0:
        raise ValueError(BATCH_ERROR)
    if max_concurrency is not None and max_concurrency <= 0:
        raise ValueError(CONCURRENCY_ERROR)
    src = df.repartition(max_concurrency) if max_concurrency else df
    if model_factory is None:
        return hashed_embedding(src, text_col, out_col, vector_size)

    def make_predict_fn():
        return checked_predict(model_factory(), vector_size, retry)

    udf = predict_batch_udf(make_predict_fn, return_type=ArrayType(FloatType()), batch_size=batch_size)
    return src.withColumn(out_col, udf(F.col(text_col)))


def l2_normalize(col: Column | str) -> Column:
    """Unit-length vector (a zero vector is returned unchanged), computed in double."""
    v = F.transform(F.col(col) if isinstance(col, str) else col, lambda x: x.cast("double"))
    # the norm is bound: inside the division it would be summed up again for every component
    return _let(v, lambda v: _let(vector_norm(v), lambda norm: F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)))


def vector_norm(col: Column | str) -> Column:
    v = F.transform(F.col(col) if isinstance(col, str) else col, lambda x: x.cast("double"))
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
