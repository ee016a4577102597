"""Chunking: one document row -> n chunk rows, metadata columns carried along.

* ``chunk_fixed``    token windows of ``size`` with ``int(size*pct)`` overlap.
* ``sentences``      rule-based sentence spans with offsets into the text.
* ``chunk_semantic`` greedy sentence packing with whole-sentence overlap.
* ``chunk``          the strategy switch (``fixed``; anything else = semantic).

Offsets index the text the chunker was given (the cleaned content). All chunk
text is cut natively (``slice``/``array_join``/``substring``); only int arrays
cross to Python for running sums and the packing fold.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from docyard.functions.arrays import make_pack_udf, prefix_offsets
from docyard.functions.text import PY_WS, PY_WS_CHARS, bind_column, py_strip
from docyard.operators.tokenize import bpe_encoding, regex_token_count, regex_tokens

STEP_ERROR = "chunk_overlap_pct must produce a positive chunk step"
TOKENIZER_ERROR = "tokenizer must be one of regex, bpe; bpe counts the tokens of fixed windows only, got "

# A sentence ends after . ! ? … (repeated), optional closing quotes or brackets, and white
# space; ideographic ends need no white space after them. Each match below is one lossless piece of the text.
CLOSERS = r"[\"')\]\x{201d}\x{2019}\x{bb}\x{ff09}\x{300d}\x{300f}\x{3011}]*"
SENTENCE_END = rf"(?:[.!?\x{{2026}}]+{CLOSERS}{PY_WS}+|[\x{{3002}}\x{{ff01}}\x{{ff1f}}\x{{ff61}}]+{CLOSERS}{PY_WS}*)"
SENTENCE_PIECE = rf"(?s).*?(?:{SENTENCE_END}|\z)"

CHUNK_COLUMNS = ("text", "chunk_index", "start_char", "end_char", "n_tokens", "chunk_strategy")


def overlap_tokens(size: int, overlap_pct: float) -> int:
    return int(size * overlap_pct)


def _chunk_count(n: Column, size: int, step: int) -> Column:
    return (F.when(n <= size, F.lit(1))
            .otherwise((F.ceil((n - F.lit(size)) / F.lit(step))).cast("int") + 1))


def chunk_fixed(df: DataFrame, size: int = 512, overlap_pct: float = 0.15, text_col: str = "content",
                tokenizer: str = "regex", offsets: bool = True) -> DataFrame:
    """Fixed token windows; the last window may be short; empty text gives none.

    Without ``offsets`` there are no ``start_char``/``end_char`` columns and nothing leaves the JVM.
    """
    overlap = overlap_tokens(size, overlap_pct)
    step = size - overlap
    if tokenizer == "bpe":
        return _chunk_fixed_bpe(df, size, overlap, text_col)
    keep = [c for c in df.columns if c != text_col]
    # The tokens are lossless, so "has tokens" is "non-empty text"; filtering on
    # the text keeps the tokenizer from running twice after filter pushdown.
    w = (df.filter(F.length(text_col) > 0)
           .withColumn("_toks", regex_tokens(text_col))
           .withColumn("_n", F.size("_toks")))
    if step <= 0:
        # Raised lazily, and only when a non-empty text is actually chunked.
        w = w.filter(F.raise_error(F.lit(STEP_ERROR)).isNull())
    ks = F.sequence(F.lit(0), _chunk_count(F.col("_n"), size, step) - 1)
    w = w.withColumn("_ks", ks)
    def window(k: Column) -> dict[str, Column]:
        tokens = F.slice("_toks", k * step + 1, size)
        return {"chunk_index": k, "text": F.array_join(tokens, ""), "n_tokens": F.size(tokens)}

    def struct(fields: dict[str, Column]) -> Column:
        return F.struct(*[c.alias(name) for name, c in fields.items()])

    if offsets:
        strides = F.transform("_ks", lambda k: F.length(F.array_join(F.slice("_toks", k * step + 1, step), "")))
        w = w.withColumn("_starts", prefix_offsets(strides))
        windows = F.zip_with("_ks", "_starts", lambda k, s: struct({**window(k), "start_char": s}))
        places = ["start_char", (F.col("start_char") + F.length("text")).alias("end_char")]
    else:
        windows = F.transform("_ks", lambda k: struct(window(k)))
        places = []
    out = w.select(*keep, F.inline(windows))
    return out.select(*keep, "text", "chunk_index", *places, "n_tokens", F.lit("fixed").alias("chunk_strategy"))


def fixed_window_counts(n: Column | str, size: int, overlap_pct: float) -> Column:
    """struct<chunks, tokens>: how many fixed windows a text of ``n`` tokens gives and
    how many tokens they hold, without cutting them (every window but the last is full)."""
    n = F.col(n) if isinstance(n, str) else n
    step = size - overlap_tokens(size, overlap_pct)
    if step <= 0:
        raise ValueError(STEP_ERROR)
    c = F.when(n > 0, _chunk_count(n, size, step)).otherwise(F.lit(0))
    tokens = F.when(c > 0, (c - 1) * F.lit(size) + (n - (c - 1) * F.lit(step))).otherwise(F.lit(0))
    return F.struct(c.alias("chunks"), tokens.alias("tokens"))


_BPE_CHUNK = ArrayType(StructType([
    StructField("chunk_index", IntegerType()), StructField("text", StringType()),
    StructField("start_char", IntegerType()), StructField("end_char", IntegerType()),
    StructField("n_tokens", IntegerType()),
]))


def bpe_windows(text: str, size: int, overlap: int, enc=None) -> list[tuple[int, str, int, int, int]]:
    """BPE windows of one text: (index, text, start_char, end_char, n_tokens).

    Windows follow from the token count alone; one running sum over the tokens' byte lengths places them. A
    window may cut a multi-byte character (the decoder then yields U+FFFD); a start offset is the
    number of UTF-8 lead bytes before the window.
    """
    enc = enc or bpe_encoding()
    tokens = enc.encode_ordinary(text)
    step = size - overlap
    if tokens and step <= 0:
        raise ValueError(STEP_ERROR)
    count = 0 if not tokens else 1 + max(0, -(-(len(tokens) - size) // step))
    raw = text.encode("utf-8")
    pieces = enc.decode_tokens_bytes(tokens)
    ends = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    leads = np.concatenate([[0], np.cumsum((np.frombuffer(raw, dtype=np.uint8) & 0xC0) != 0x80)])
    out = []
    for k in range(count):
        first, last = k * step, min(k * step + size, len(tokens))
        body = raw[ends[first]:ends[last]].decode("utf-8", "replace")
        at = int(leads[ends[first]])
        out.append((k, body, at, at + len(body), last - first))
    return out


def _make_bpe_udf(size: int, overlap: int):
    @F.arrow_udf(_BPE_CHUNK)
    def bpe_chunks(texts: pa.Array) -> pa.Array:
        enc = bpe_encoding()
        rows = [None if t is None else [dict(zip(("chunk_index", "text", "start_char", "end_char", "n_tokens"), w))
                                        for w in bpe_windows(t, size, overlap, enc)]
                for t in texts.to_pylist()]
        return pa.array(rows, type=pa.list_(pa.struct([
            ("chunk_index", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()),
            ("end_char", pa.int32()), ("n_tokens", pa.int32())])))
    return bpe_chunks


def _chunk_fixed_bpe(df: DataFrame, size: int, overlap: int, text_col: str) -> DataFrame:
    keep = [c for c in df.columns if c != text_col]
    udf = _make_bpe_udf(size, overlap)
    # inline the UDF call itself: over a bare column Spark would infer a size
    # filter and evaluate the UDF a second time below earlier operators
    out = df.select(*keep, F.inline(udf(F.col(text_col))))
    return out.select(*keep, "text", "chunk_index", "start_char", "end_char", "n_tokens",
                      F.lit("fixed").alias("chunk_strategy"))


def with_sentences(df: DataFrame, text_col: str = "content", out_col: str = "_sents",
                   keep_pieces: bool = False) -> DataFrame:
    """Add array<struct<text, start_char, end_char, n_tokens, piece, piece_offset>> of
    stripped non-empty sentences.

    Pieces come from one regex pass (materialised once as a column), their
    running offsets from one Arrow call over the piece lengths. The pieces
    concatenate to the text, so ``keep_pieces`` lets callers cut slices of
    the text from them without indexing into the whole document.
    """
    pieces = F.regexp_extract_all(F.col(text_col), F.lit(SENTENCE_PIECE), 0)
    w = df.withColumn("_pieces", pieces)
    w = w.withColumn("_poffs", prefix_offsets(F.transform("_pieces", lambda p: F.length(p))))

    def one(p, oi):
        o = oi["o"]
        lead = F.length(p) - F.length(F.ltrim(p, F.lit(PY_WS_CHARS)))
        trail = F.length(p) - F.length(F.rtrim(p, F.lit(PY_WS_CHARS)))
        stripped = py_strip(p)
        return F.struct(stripped.alias("text"), (o + lead).alias("start_char"),
                        (o + F.length(p) - trail).alias("end_char"),
                        regex_token_count(stripped).alias("n_tokens"),
                        oi["i"].alias("piece"), o.alias("piece_offset"))

    indexed = F.transform("_poffs", lambda o, i: F.struct(o.alias("o"), i.alias("i")))
    sents = F.filter(F.zip_with("_pieces", indexed, one), lambda s: s["text"] != F.lit(""))
    w = bind_column(w, out_col, sents).drop("_poffs")
    return w if keep_pieces else w.drop("_pieces")


def sentences(df: DataFrame, text_col: str = "content") -> DataFrame:
    """One row per sentence: sentence_index, text, start_char, end_char, n_tokens."""
    keep = [c for c in df.columns if c != text_col]
    # inline over a computed array: an explode over a bare column makes Spark infer
    # a size filter and push a copy of the whole sentence computation below the input.
    numbered = F.transform("_sents", lambda s, i: F.struct(
        i.alias("sentence_index"), s["text"].alias("text"), s["start_char"].alias("start_char"),
        s["end_char"].alias("end_char"), s["n_tokens"].alias("n_tokens")))
    return with_sentences(df, text_col).select(*keep, F.inline(numbered))


def chunk_semantic(df: DataFrame, size: int = 512, overlap_pct: float = 0.15,
                   text_col: str = "content") -> DataFrame:
    """Sentence-aligned chunks; chunk text is the document slice, so inner spacing is kept."""
    overlap = overlap_tokens(size, overlap_pct)
    keep = [c for c in df.columns if c != text_col]
    pack = make_pack_udf(size, overlap)
    w = with_sentences(df, text_col, keep_pieces=True)   # no sentences -> no chunks
    w = w.withColumn("_stoks", F.transform("_sents", lambda s: s["n_tokens"]))
    w = w.withColumn("_spans", pack(F.col("_stoks")))

    def one_chunk(sp, i):
        first = F.element_at("_sents", sp["first"] + 1)
        last = F.element_at("_sents", sp["last"] + 1)
        # the chunk is the text from its first sentence's start to its last one's end:
        # join just those pieces and trim, instead of indexing into the whole document
        joined = F.array_join(F.slice("_pieces", first["piece"] + 1, last["piece"] - first["piece"] + 1), "")
        text = F.substring(joined, first["start_char"] - first["piece_offset"] + 1,
                           last["end_char"] - first["start_char"])
        return F.struct(
            i.alias("chunk_index"), text.alias("text"),
            first["start_char"].alias("start_char"), last["end_char"].alias("end_char"),
            F.aggregate(F.slice("_stoks", sp["first"] + 1, sp["last"] - sp["first"] + 1),
                        F.lit(0), lambda a, x: a + x).alias("n_tokens"))

    out = w.select(*keep, F.inline(F.transform("_spans", one_chunk)))
    return out.select(*keep, "text", "chunk_index", "start_char", "end_char", "n_tokens",
                      F.lit("semantic").alias("chunk_strategy"))


def chunk(df: DataFrame, strategy: str = "fixed", size: int = 512, overlap_pct: float = 0.15,
          text_col: str = "content", tokenizer: str = "regex", chunker=None, offsets: bool = True) -> DataFrame:
    """Strategy switch: ``fixed`` is token windows, anything else sentence packing.

    ``chunker`` (documents -> rows with ``CHUNK_COLUMNS`` besides the carried ones) replaces both. A tokenizer
    that the strategy cannot count with is refused.
    """
    if chunker is not None:
        out = chunker(df)
        missing = [c for c in ("text", "chunk_index") if c not in out.columns]
        if missing:
            raise ValueError(f"chunker gives no column {', '.join(missing)}")
        return out
    if tokenizer not in ("regex", "bpe") or (tokenizer == "bpe" and strategy != "fixed"):
        raise ValueError(f"{TOKENIZER_ERROR}{tokenizer} with {strategy}")
    if strategy == "fixed":
        return chunk_fixed(df, size, overlap_pct, text_col, tokenizer, offsets)
    return chunk_semantic(df, size, overlap_pct, text_col)


@udtf(returnType="chunk_index int, start_char int, end_char int, text string")
class LineWindows:
    """Windows of lines as a table function: the extension form for chunkers that are plain Python over one text.

    Its arguments are the text, the lines of a window and the lines between two windows' starts.
    """

    def eval(self, text: str, size: int, step: int):
        if not text:
            return
        lines = text.split("\n")
        start = 0
        for k, at in enumerate(range(0, max(1, len(lines) - size + step), step)):
            window = "\n".join(lines[at:at + size])
            yield k, start, start + len(window), window
            start += sum(len(line) + 1 for line in lines[at:at + step])


def chunk_by_table_function(df: DataFrame, function, *args: Column, text_col: str = "content") -> DataFrame:
    """Chunks of every document by a table function over its text: a lateral join, so all other columns are carried.

    The function returns ``chunk_index``, ``start_char``, ``end_char`` and ``text`` (``LineWindows`` is one).
    """
    called = function(F.col(text_col).outer(), *args)
    return df.lateralJoin(called).drop(text_col)


def chunk_lines(df: DataFrame, size: int, step: int, text_col: str = "content") -> DataFrame:
    """The same windows of lines natively."""
    lines = F.split(F.col(text_col), "\n", -1)
    windows = F.transform(F.array(lines), lambda ls: F.transform(
        F.sequence(F.lit(0), F.greatest(F.ceil((F.size(ls) - size) / F.lit(step)).cast("int"), F.lit(0))), lambda k: F.named_struct(
            F.lit("chunk_index"), k,
            F.lit("start_char"), F.length(F.array_join(F.slice(ls, 1, k * step), "\n")) + F.when(k > 0, 1).otherwise(0),
            F.lit("text"), F.array_join(F.slice(ls, k * step + 1, size), "\n"))))
    keep = [c for c in df.columns if c != text_col]
    out = df.filter(F.length(text_col) > 0).select(*keep, F.inline(F.get(windows, 0)))
    return out.withColumn("end_char", F.col("start_char") + F.length("text"))


def document_id(tenant: Column | str = "tenant_id", source_path: Column | str = "source_path",
                page_number: Column | str | None = "page_number") -> Column:
    """Deterministic document id (the reference draws a random one per run)."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    page = F.coalesce(c(page_number), F.lit(0)) if page_number is not None else F.lit(0)
    return F.sha2(F.to_json(F.struct(F.coalesce(c(tenant), F.lit("")).alias("t"),
                                     c(source_path).alias("p"), page.alias("n"))), 256)


__all__ = ["chunk_fixed", "chunk_semantic", "chunk", "sentences", "with_sentences", "bpe_windows",
           "document_id", "LineWindows", "chunk_by_table_function", "chunk_lines"]
