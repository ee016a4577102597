"""Gold chunks of given passages: which chunks of a corpus hold a passage.

Passage and chunk texts become sets of hashed word shingles. The passages' shingles are a posting list (shingle ->
passage); the chunks' shingles are joined to it and the hits are counted per (chunk, passage), combined map-side. A chunk holds a passage
when it has at least ``share`` of the passage's distinct shingles. Only hashes and keys are joined, no text;
Spark broadcasts the postings where they are small by its own check, and sorts and merges both sides where not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docyard.operators.embed import words

SHINGLE = 5
SHARE = 0.8


def shingle_hashes(text: Column | str, n: int = SHINGLE) -> Column:
    """Distinct hashes of the text's n-word shingles (lower case); a shorter text is one shingle, one without words none."""
    starts = lambda w: F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1)))
    # the words one after the other, unjoined; places behind a short text's end are null, which the hash passes over
    shingle = lambda w, i: F.xxhash64(*[F.get(w, i + (j - 1)) for j in range(n)])
    hashed = F.transform(F.array(words(text)), lambda w: F.when(F.size(w) > 0, F.array_distinct(F.transform(
        starts(w), lambda i: shingle(w, i)))).otherwise(F.array().cast("array<bigint>")))
    return F.get(hashed, 0)


def gold_chunks(passages: DataFrame, chunks: DataFrame, keys: tuple[str, ...], share: float = SHARE,
                passage_col: str = "passage_id", text_col: str = "text", n: int = SHINGLE) -> DataFrame:
    """(passage, *keys) of every chunk that holds the passage. ``passages``: ids are unique."""
    wanted = passages.select(passage_col, shingle_hashes(text_col, n).alias("_hs"))
    postings = wanted.select(passage_col, F.size("_hs").alias("_size"), F.explode("_hs").alias("_h"))
    have = chunks.select(*keys, F.explode(shingle_hashes(text_col, n)).alias("_h"))
    hits = have.join(postings, "_h").groupBy(passage_col, *keys, "_size").agg(F.count(F.lit(1)).alias("_n"))
    return hits.filter(F.col("_n") >= F.ceil(F.lit(share) * F.col("_size"))).select(passage_col, *keys)
