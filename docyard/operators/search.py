"""Exact cosine top-k over a vector table, context assembly and recall@k.

Vectors are dealt over shards by a hash of id, vector and input partition (an id on many rows is spread, too) and every
shard meets the queries (of its tenant, when there is one) as a cogroup, so nothing is collected and neither
side is broadcast. The number of shards follows the number of vectors, so a shard stays within a task's memory at
any size. A shard multiplies blocks of bounded size and keeps its own top-k per query; the final ``row_number() <= k``
over (score desc, id asc) merges those lists, so at most shards x k rows per query are shuffled.
Ids may be of any type that Spark orders. Products are taken before norms divide them: on integer vectors (word counts)
equal scores come out equal to the last bit, wherever they were computed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Vectors a shard holds on average, and the least number of shards.
SHARD_VECTORS = 16_384
MIN_SHARDS = 8
#: Vectors and queries multiplied at once within a shard.
BLOCK_VECTORS, BLOCK_QUERIES = 8_192, 256


def centroid_queries(vectors: DataFrame, group_col: str = "label", vec_col: str = "embedding") -> DataFrame:
    """Mean vector per group (query_id = group), as ARRAY<DOUBLE>."""
    per_dim = (vectors.select(F.col(group_col).alias("query_id"), F.posexplode(vec_col).alias("pos", "x"))
                      .groupBy("query_id", "pos").agg(F.avg(F.col("x").cast("double")).alias("m")))
    return (per_dim.groupBy("query_id")
                   .agg(F.sort_array(F.collect_list(F.struct("pos", "m"))).alias("_c"))
                   .select("query_id", F.transform("_c", lambda s: s["m"]).alias("embedding")))


def matrix(vectors: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """The vectors as rows, and their norms."""
    m = np.stack([np.asarray(v, dtype=np.float64) for v in vectors])
    return m, np.sqrt((m * m).sum(axis=1))


def best_rows(q: np.ndarray, q_norm: np.ndarray, v: np.ndarray, v_norm: np.ndarray, ids: np.ndarray,
              k: int) -> list[list[tuple]]:
    """Per query its k best (-score, id), best first; vectors are multiplied block by block."""
    best: list[list[tuple]] = [[] for _ in range(len(q))]
    for b in range(0, len(v), BLOCK_VECTORS):
        both = q_norm[:, None] * v_norm[None, b:b + BLOCK_VECTORS]
        scores = np.divide(q @ v[b:b + BLOCK_VECTORS].T, both, out=np.zeros(both.shape), where=both > 0)
        keep = min(k, scores.shape[1])
        floor = np.partition(scores, -keep, axis=1)[:, -keep]
        for j, i in zip(*np.nonzero(scores >= floor[:, None])):
            best[j].append((-scores[j, i], ids[b + i]))
        best = [sorted(x)[:k] for x in best]
    return best


def shard_topk(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of one shard for each query: columns of ``queries``' key, ``_id`` and ``score``."""
    found = []
    if len(queries) and len(vectors):
        ids = vectors["_id"].to_numpy()
        v, v_norm = matrix(vectors["_v"])
        for a in range(0, len(queries), BLOCK_QUERIES):
            block = queries.iloc[a:a + BLOCK_QUERIES]
            best = best_rows(*matrix(block["_q"]), v, v_norm, ids, k)
            found += [(query, i, -s) for query, mine in zip(block["query_id"], best) for s, i in mine]
    return pd.DataFrame(found, columns=["query_id", "_id", "score"])


def cosine_topk(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id",
                vec_col: str = "embedding", query_vec_col: str = "embedding",
                tenant_col: str | None = None, shards: int | None = None) -> DataFrame:
    """(query_id, id, score, rank) of the k most cosine-similar vectors per query (ties: smaller id).

    With ``tenant_col`` (a column of both sides) a query only sees its own tenant's vectors.
    ``shards`` defaults to what the number of vectors asks for (one count of the corpus).
    """
    shards = shards or max(MIN_SHARDS, -(-corpus.count() // SHARD_VECTORS))
    tenant = F.col(tenant_col).cast("string") if tenant_col else F.lit(None).cast("string")
    v = corpus.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v"), tenant.alias("_t"),
                      F.pmod(F.xxhash64(id_col, vec_col, F.spark_partition_id()), F.lit(shards)).cast("int").alias("_s"))
    q = queries.select("query_id", F.col(query_vec_col).alias("_q"), tenant.alias("_t"),
                       F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("_s"))
    found = (q.groupBy("_t", "_s").cogroup(v.groupBy("_t", "_s"))
             .applyInPandas(lambda a, b: shard_topk(a, b, k), found_schema(corpus, queries, id_col)))
    return best_of(found, k, id_col)


def found_schema(corpus: DataFrame, queries: DataFrame, id_col: str) -> str:
    """Schema of what a shard returns."""
    return (f"query_id {queries.schema['query_id'].dataType.simpleString()}, "
            f"_id {corpus.schema[id_col].dataType.simpleString()}, score double")


def best_of(found: DataFrame, k: int, id_col: str) -> DataFrame:
    """The shards' lists merged: rank 1 to k per query."""
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return (found.withColumnRenamed("_id", id_col)
            .withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k))


def assemble_context(ranked: DataFrame, texts: DataFrame, id_col: str = "vec_id", text_col: str = "text",
                     sep: str = "\n\n") -> DataFrame:
    """Per query: the hit texts joined in rank order."""
    hits = ranked.join(texts.select(id_col, text_col), id_col)
    return (hits.groupBy("query_id")
                .agg(F.sort_array(F.collect_list(F.struct("rank", text_col))).alias("_h"))
                .select("query_id", F.size("_h").alias("n_chunks"),
                        F.array_join(F.transform("_h", lambda h: h[text_col]), sep).alias("context")))


def recall_at_k(ranked: DataFrame, gold: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Per query: hits among the top k, gold size, recall = hits/gold, precision = hits/k."""
    g = gold.select("query_id", id_col).distinct()
    sizes = g.groupBy("query_id").agg(F.count(F.lit(1)).alias("gold_count"))
    # the ranking is read once: every query keeps a row, its hits are counted beside it
    out = (ranked.select("query_id", id_col).join(g.withColumn("_hit", F.lit(1)), ["query_id", id_col], "left")
                 .groupBy("query_id").agg(F.count("_hit").alias("hits"))
                 .join(sizes, "query_id", "left").fillna(0, ["gold_count"]))
    return out.select("query_id", "hits", "gold_count",
                      F.when(F.col("gold_count") > 0, F.col("hits") / F.col("gold_count")).alias("recall"),
                      (F.col("hits") / F.lit(k)).alias("precision"))
