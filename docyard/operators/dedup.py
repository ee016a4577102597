"""Content-hash dedup of chunks per tenant, against an index and within a batch.

Semantics kept from the reference:
* the tenant key is the tenant id, or NULL when it is missing or empty;
* a chunk with a tenant is a duplicate if the index holds its hash *for that
  tenant*; a chunk without tenant is a duplicate if *any* tenant holds it;
* within the batch the first chunk per (tenant, hash) in input order wins,
  NULL tenant being a group of its own.

Plan shape: the decision is made on narrow rows. ``first_keys`` is one grouped minimum
of the input order per (tenant, hash), combined map-side, so a hash on a third of all rows leaves
each map task as one row; ``new_keys`` is one anti join of those keys against the index. Both
tenant rules share that join: its key is the hash, the tenants are compared in what is left of the condition. An index bucketed by
hash (``docyard.sinks.hash_index``) is then read bucket by bucket and never shuffled. Only then are the chosen chunks picked out of the wide
table, by one semi join: the text moves at most once, and not at all when Spark broadcasts the keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docyard.functions.hashing import chunk_hash, point_id

#: Input order of chunks: the path, the page in the file, the chunk in the page.
ORDER = ("source_path", "page_number", "chunk_index")


def tenant_key(col: Column | str = "tenant_id") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.nullif(c.cast("string"), F.lit(""))


def with_identity(chunks: DataFrame, text_col: str = "text") -> DataFrame:
    """Add ``chunk_hash`` (SHA-256 hex) and ``point_id`` (UUIDv5 of the hash)."""
    return (chunks.withColumn("chunk_hash", chunk_hash(text_col))
                  .withColumn("point_id", point_id("chunk_hash")))


def _order(chunks: DataFrame, order_cols=ORDER) -> list[str]:
    return [c for c in order_cols if c in chunks.columns]


def first_keys(chunks: DataFrame, order_cols=ORDER, tenant_col: str = "tenant_id", carry=()) -> DataFrame:
    """Per (tenant key, hash): its first chunk's place (and ``carry`` columns) as ``_o``, and its copies ``_n``.

    Columns ``_t``, ``_h``, ``_o``, ``_n``. A narrow column that the caller wants of the first chunk rides along.
    """
    place = F.struct(*[F.col(c) for c in (*_order(chunks, order_cols), *carry)])
    return (chunks.select(tenant_key(tenant_col).alias("_t"), F.col("chunk_hash").alias("_h"), place.alias("_o"))
            .groupBy("_t", "_h").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n")))


def _pick(chunks: DataFrame, keys: DataFrame, order_cols, tenant_col: str) -> DataFrame:
    """The chunks at the places of ``keys``; every other column as it was."""
    same = tenant_key(chunks[tenant_col]).eqNullSafe(keys["_t"]) & (chunks["chunk_hash"] == keys["_h"])
    for c in _order(chunks, order_cols):
        same = same & chunks[c].eqNullSafe(keys[f"_o.{c}"])
    return chunks.join(keys, same, "left_semi")


def first_in_batch(chunks: DataFrame, order_cols=ORDER, tenant_col: str = "tenant_id") -> DataFrame:
    """Keep the first chunk per (tenant key, hash) in input order."""
    return _pick(chunks, first_keys(chunks, order_cols, tenant_col), order_cols, tenant_col)


def _against(rows: DataFrame, tenant: Column, digest: Column, index: DataFrame, how: str, tenant_col: str) -> DataFrame:
    """Join on the hash alone; the tenant rules are the rest of the condition, so the index is read as it lies."""
    keys = index.select(tenant_key(tenant_col).alias("_it"), F.col("chunk_hash").alias("_ih"))
    return rows.join(keys, (digest == keys["_ih"]) & (tenant.isNull() | (tenant == keys["_it"])), how)


def new_keys(firsts: DataFrame, index: DataFrame | None, tenant_col: str = "tenant_id") -> DataFrame:
    """The ``first_keys`` whose hash the index does not hold."""
    if index is None:
        return firsts
    return _against(firsts, firsts["_t"], firsts["_h"], index, "left_anti", tenant_col)


def new_against_index(chunks: DataFrame, index: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """Anti join: chunks whose hash the index does not hold (tenant rules above)."""
    return _against(chunks, tenant_key(chunks[tenant_col]), chunks["chunk_hash"], index, "left_anti", tenant_col)


def existing_in_index(chunks: DataFrame, index: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """Semi join: chunks whose hash the index already holds."""
    return _against(chunks, tenant_key(chunks[tenant_col]), chunks["chunk_hash"], index, "left_semi", tenant_col)


def filter_new_chunks(chunks: DataFrame, index: DataFrame | None = None, order_cols=ORDER,
                      tenant_col: str = "tenant_id") -> DataFrame:
    """Chunks to embed: first in batch and absent from the index.

    ``chunks`` must already carry ``chunk_hash``. Taking the first per key
    before or after the index check keeps the same rows (an indexed hash drops
    every copy), so the cheap minimum runs first and shrinks the join input.
    """
    keys = new_keys(first_keys(chunks, order_cols, tenant_col), index, tenant_col)
    return _pick(chunks, keys, order_cols, tenant_col)


def hashes_by_tenant(chunks: DataFrame, tenant_col: str = "tenant_id") -> DataFrame:
    """Report form of the hash grouping: distinct hashes per tenant key."""
    return (chunks.groupBy(tenant_key(tenant_col).alias("tenant_id"))
                  .agg(F.countDistinct("chunk_hash").alias("distinct_hashes"),
                       F.count(F.lit(1)).alias("chunks")))


def in_batch_counts(chunks: DataFrame, by: str = "tenant_id") -> DataFrame:
    """Per tenant key: total chunks, chunks kept by in-batch dedup, skipped copies.

    The counts do not depend on which copy survives, so this is two
    aggregations (per (tenant, hash), then per tenant) whose map-side partial
    aggregation collapses a hot hash before any shuffle.
    """
    per_key = chunks.groupBy(tenant_key(by).alias(by), "chunk_hash").agg(F.count(F.lit(1)).alias("_n"))
    out = per_key.groupBy(by).agg(F.sum("_n").alias("total_chunk_count"),
                                  F.count(F.lit(1)).alias("new_chunk_count"))
    return out.withColumn("skipped_count", F.col("total_chunk_count") - F.col("new_chunk_count"))


def marked_keys(chunks: DataFrame, held: str, order_cols=ORDER, tenant_col: str = "tenant_id", carry=()) -> DataFrame:
    """``first_keys`` with ``_held``: whether the index holds the key, where column ``held`` tells which chunks are indexed.

    One pass over the chunks answers first places, copies and index: the key of a tenant is held when one of its own chunks
    is, a key without tenant when any tenant's is (a window over the distinct keys of a hash).
    """
    place = F.struct(*[F.col(c) for c in (*_order(chunks, order_cols), *carry)])
    keys = (chunks.select(tenant_key(tenant_col).alias("_t"), F.col("chunk_hash").alias("_h"), place.alias("_o"),
                          F.coalesce(F.col(held), F.lit(False)).alias("_own"))
            .groupBy("_t", "_h").agg(F.min("_o").alias("_o"), F.count(F.lit(1)).alias("_n"), F.max("_own").alias("_own")))
    of_any = F.max(F.col("_own")).over(Window.partitionBy("_h"))
    return keys.withColumn("_held", F.when(F.col("_t").isNull(), of_any).otherwise(F.col("_own"))).drop("_own")


def tenant_counts(marked: DataFrame) -> DataFrame:
    """Per tenant key, from ``marked_keys``: total, new and skipped chunks."""
    out = marked.groupBy(F.col("_t").alias("tenant_id")).agg(F.sum("_n").alias("total_chunk_count"),
                                                             F.count_if(~F.col("_held")).alias("new_chunk_count"))
    return out.withColumn("skipped_count", F.col("total_chunk_count") - F.col("new_chunk_count"))


def skipped_counts(chunks: DataFrame, new_chunks: DataFrame, by=("tenant_id", "source_path")) -> DataFrame:
    """Per group: total chunks, new chunks, and skipped = existing + in-batch copies."""
    total = chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("total_chunk_count"))
    new = new_chunks.groupBy(*by).agg(F.count(F.lit(1)).alias("new_chunk_count"))
    out = total.join(new, list(by), "left").fillna(0, ["new_chunk_count"])
    return out.withColumn("skipped_count", F.col("total_chunk_count") - F.col("new_chunk_count"))
