"""Exact top-k inner-product search by MaxScore over sharded impact postings.

A vector's dimensions are its terms. Vectors are dealt over shards by a hash of id, vector and input partition (an id on a third of all rows is spread, too); a shard keeps one
posting list of integer impacts per dimension with the list's least and largest impact. Queries meet the
shards in blocks. For a query and a shard, every term has a score bound (its largest possible gain
over its least one); terms in order of their bounds split into *non-essential* ones, whose gains together cannot
lift a vector over the query's k-th best score so far, and *essential* ones. Essential postings are traversed
block by block; only vectors that can still compete are probed in the remaining terms, largest bound
first, and leave as soon as their best possible score falls behind. Each shard returns its k best per query and a
window merges the shards.

The threshold only drops vectors that are strictly worse, so equal scores are decided by the smaller id, exactly.

Defined results: rows without id, vectors that are null or hold a null or non-finite component take no part;
vectors of different width meet in their common dimensions; repeated rows are candidates of their own, a query id
is answered once (for its smallest vector where rows of one id differ); scores beyond a long stop at its limits;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import table

K = 5
SCALE = 256
QUERY_STEP = 50
#: Vectors per shard, the least number of shards, and queries per block.
SHARD_VECTORS = 16_384
MIN_SHARDS = 16
QUERY_BLOCK = 4_096
#: Vectors of a shard that are scored between two updates of the threshold.
BLOCK = 2_048
#: Terms probed between two looks at which vectors still compete.
PROBE = 8
LONGEST = (1 << 63) - 1


def usable(vectors: DataFrame) -> DataFrame:
    """Rows that take part."""
    bad = F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vectors.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~bad)


def as_integers(rows: list, width: int) -> np.ndarray:
    """floor(SCALE * x) per component, missing ones 0; float64 while exact, else Python integers."""
    out = np.zeros((len(rows), width))
    for k, row in enumerate(rows):
        out[k, :len(row)] = np.floor(SCALE * np.asarray(row, dtype=np.float64))
    return out


def exact_type(a: np.ndarray, b: np.ndarray) -> type:
    """float64 when every partial inner product is an integer that it holds exactly, else Python integers."""
    most = lambda x: float(np.abs(x).max()) if x.size else 0.0
    return np.float64 if most(a) * most(b) * max(1, a.shape[1]) < 2.0 ** 52 else object


class Postings:
    """Impact lists of one shard: ``impact[d]`` holds dimension d's impacts in the order of the ids."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.impact = np.ascontiguousarray(vectors[order].T)
        self.least = self.impact.min(axis=1) if len(ids) else np.zeros(len(self.impact))
        self.most = self.impact.max(axis=1) if len(ids) else np.zeros(len(self.impact))

    def search(self, query_id: int, query: np.ndarray, k: int) -> list[tuple[int, int]]:
        """The k best (score, id) of the shard, best first."""
        terms = np.flatnonzero(query != 0)
        q = query[terms]
        ends = (q * self.least[terms], q * self.most[terms])
        low, high = np.minimum(*ends), np.maximum(*ends)
        order = np.argsort((low - high).astype(float), kind="stable")  # largest bound first
        terms, q, low, gain = terms[order], q[order], low[order], (high - low)[order]
        base = low.sum() if len(low) else 0
        rest = np.append(np.cumsum(gain[::-1])[::-1], 0)  # rest[t]: what terms t, t+1, ... can add together
        best: list[tuple[int, int]] = []
        for a in range(0, len(self.ids), BLOCK):
            ids = self.ids[a:a + BLOCK]
            alive = np.flatnonzero(ids != query_id)
            bar = best[-1][0] if len(best) == k else None
            # essential: the first terms; the others together cannot reach the bar
            t = len(terms) if bar is None else int(np.searchsorted(-(base + rest).astype(float), -float(bar), "right"))
            t = min(max(t, 1), len(terms))
            score = base + (q[:t] @ self.impact[terms[:t], a:a + BLOCK][:, alive] - low[:t].sum()) \
                if len(terms) else np.zeros(len(alive), dtype=query.dtype)
            while bar is not None and len(alive):
                keep = score + rest[t] >= bar
                alive, score = alive[keep], score[keep]
                if t == len(terms) or not len(alive):
                    break
                more = slice(t, min(t + PROBE, len(terms)))
                score = score + q[more] @ self.impact[terms[more], a:a + BLOCK][:, alive] - low[more].sum()
                t = more.stop
            score = np.clip(score, -LONGEST - 1, LONGEST) if score.dtype == object else score
            if len(alive) > k:  # the block's k best, ties included
                bound = np.sort(score)[-k]
                alive, score = alive[score >= bound], score[score >= bound]
            if len(alive):
                best = sorted(best + [(int(s), int(i)) for s, i in zip(score, ids[alive])],
                              key=lambda x: (-x[0], x[1]))[:k]
        return best


def search_shard(queries: pd.DataFrame, vectors: pd.DataFrame, k: int) -> pd.DataFrame:
    """k best of one shard for one block of queries."""
    columns = ["query_id", "vec_id", "score"]
    if queries.empty or vectors.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in columns})
    width = max(max(map(len, queries["embedding"])), max(map(len, vectors["embedding"])))
    v, q = as_integers(vectors["embedding"].to_list(), width), as_integers(queries["embedding"].to_list(), width)
    kind = exact_type(v, q)
    if kind is object:
        v, q = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (v, q))
    postings = Postings(vectors["vec_id"].to_numpy(dtype=np.int64), v)
    rows = [(int(i), doc, s)
            for i, query in zip(queries["query_id"], q) for s, doc in postings.search(int(i), query, k)]
    return pd.DataFrame(rows, columns=columns).astype("int64")


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score of each query's k best vectors. Both: vec_id, embedding."""
    vectors = usable(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "embedding")
    queries = (usable(queries).groupBy(F.col("vec_id").cast("long").alias("query_id"))
               .agg(F.min("embedding").alias("embedding")))
    shards = int(max(MIN_SHARDS, -(-vectors.count() // SHARD_VECTORS)))
    blocks = int(max(1, -(-queries.count() // QUERY_BLOCK)))
    dealt = (vectors.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding", F.spark_partition_id()), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = (asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
             .applyInPandas(lambda q, v: search_shard(q, v, k), "query_id long, vec_id long, score long"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter(F.col("vec_id") % QUERY_STEP == 0))


SQL = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     scored AS (SELECT q.vec_id AS query_id, c.vec_id,
                       list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
                FROM v q JOIN v c ON q.vec_id % {QUERY_STEP} = 0 AND q.vec_id <> c.vec_id),
     ranked AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                       vec_id, score FROM scored)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
