"""Tokenisers: a native lossless regex tokeniser and a byte-level BPE one.

``regex`` runs entirely in the JVM (``regexp_extract_all``); concatenating its
tokens gives back the text exactly, so character offsets are running sums of
token lengths. ``bpe`` needs the merge table and runs as an Arrow UDF with the
encoder built once per Python worker.
"""

from __future__ import annotations

import base64
import functools

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: lossless word/number/punctuation/space pattern (valid in Java and RE2).
TOKEN_PATTERN = (r"[ ]?[\p{L}\p{M}]+|[ ]?\p{N}{1,3}|[ ]?[^ \t\n\r\f\x0b\p{L}\p{M}\p{N}]+"
                 r"|[ \t\n\r\f\x0b]+")


def regex_tokens(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), 0)


def regex_token_count(col: Column | str) -> Column:
    """Number of regex tokens, counted without building the token array."""
    c = F.col(col) if isinstance(col, str) else col
    return F.regexp_count(c, F.lit(TOKEN_PATTERN))


@functools.lru_cache(maxsize=4)
def bpe_encoding(rank_file: str | None = None):
    """A tiktoken encoder over a local rank file; cached per Python worker."""
    import tiktoken
    try:
        import public_tokenizers as P
    except ImportError:  # pragma: no cover - optional package
        P = None
    if rank_file is None:
        if P is None:
            raise RuntimeError("no BPE rank file given and no bundled one installed")
        rank_file = P.path("byte_bpe_50k.tiktoken")
    pattern = getattr(P, "PATTERN", None) if P is not None else None
    if pattern is None:
        pattern = (r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
    with open(rank_file, "rb") as fh:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in fh if line.strip())}
    return tiktoken.Encoding("docyard-bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
