"""Approximate cosine top-k: signed random projections, several tables, probing, exact re-ranking.

Every table cuts the space by ``bits`` planes; the sides a vector lies on are its bucket. The planes' components are +1
or -1 by the MD5 of (table, bit, component), and vectors are taken as integers, so a bucket is the same on every machine and can be stated
in SQL. A query visits, in each table, the ``probes`` buckets that differ from its own in at most two planes and whose planes it
lies nearest to. In a bucket all its vectors are scored exactly against the queries that visit it; lists of k best are merged,
so candidates are never emitted as pairs.

A bucket with more vectors than ``SHARD_VECTORS`` (many copies of one vector) is split by hash and its visitors
meet every part: groups stay bounded and no vector is left out. The number of planes follows the number of vectors, so an average
bucket does not grow with the corpus. A vector takes part when it has the given width and only finite components.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docyard.operators.search import BLOCK_QUERIES, MIN_SHARDS, SHARD_VECTORS, best_of, best_rows, found_schema, matrix
from docyard.session import cut_lineage

TABLES = 16
#: The least number of planes per table, and the vectors an average bucket may hold before there are more.
BITS = 8
BUCKET_VECTORS = 4_096
PROBES = 12
#: Planes a probe may cross.
CROSSED = 2
#: Components are taken as integers of this resolution.
RESOLUTION = 1 << 16


def bits_for(vectors: int) -> int:
    return max(BITS, ceil(log2(max(1, vectors / BUCKET_VECTORS))))


def planes(tables: int, bits: int, width: int) -> np.ndarray:
    """One row of +1 and -1 per plane: table by table, bit by bit."""
    sign = lambda *at: 1.0 if hashlib.md5(":".join(map(str, at)).encode()).hexdigest()[0] < "8" else -1.0
    return np.array([[sign(t, b, d) for d in range(width)] for t in range(tables) for b in range(bits)])


def projected(vectors: list, cut: np.ndarray, bits: int) -> np.ndarray:
    """Exact integer projections: vector x table x bit."""
    x = np.floor(RESOLUTION * np.stack([np.asarray(v, dtype=np.float64) for v in vectors]))
    return (x @ cut.T).reshape(len(x), -1, bits)


def crossings(bits: int) -> np.ndarray:
    """All sets of at most ``CROSSED`` planes as masks, ascending."""
    return np.array(sorted(sum(1 << b for b in some) for n in range(CROSSED + 1) for some in combinations(range(bits), n)))


def buckets(vec: Column, tables: int, bits: int, width: int) -> Column:
    """The vector's bucket in every table."""
    @F.pandas_udf("array<long>")
    def own_buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut, weight = planes(tables, bits, width), 1 << np.arange(bits)
        for vectors in batches:
            code = (projected(vectors.to_list(), cut, bits) > 0) @ weight if len(vectors) else []
            yield pd.Series(list(code), dtype="object")
    return own_buckets(vec)


def visited(vec: Column, tables: int, bits: int, width: int, probes: int) -> Column:
    """The buckets a query visits, ``probes`` for each table in turn (least crossing distance, then smaller mask)."""
    @F.pandas_udf("array<long>")
    def near_buckets(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        cut, weight, masks = planes(tables, bits, width), 1 << np.arange(bits), crossings(bits)
        member = (masks[:, None] >> np.arange(bits)) & 1
        for vectors in batches:
            out = []
            for p in (projected(vectors.to_list(), cut, bits) if len(vectors) else []):
                near = np.argsort(np.abs(p) @ member.T, axis=1, kind="stable")[:, :probes]
                out.append((((p > 0) @ weight)[:, None] ^ masks[near]).ravel())
            yield pd.Series(out, dtype="object")
    return near_buckets(vec)


def visits(asked: pd.DataFrame, stored: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k best of every visited bucket for each visitor; both sides hold many buckets, named by ``_k``."""
    columns = ["query_id", "_id", "score"]
    if asked.empty or stored.empty:
        return pd.DataFrame({c: pd.Series(dtype="object") for c in columns})
    asked, stored = asked.sort_values("_k", kind="stable"), stored.sort_values("_k", kind="stable")
    (q, q_norm), (v, v_norm) = matrix(asked["_q"]), matrix(stored["_v"])
    keys, starts = np.unique(asked["_k"].to_numpy(), return_index=True)
    ends = np.append(starts[1:], len(asked))
    have = stored["_k"].to_numpy()
    first, last = np.searchsorted(have, keys, "left"), np.searchsorted(have, keys, "right")
    queries, ids, found = asked["query_id"].to_numpy(), stored["_id"].to_numpy(), []
    for a, b, c, d in zip(starts, ends, first, last):
        for at in range(a, b if d > c else a, BLOCK_QUERIES):
            rows = slice(at, min(b, at + BLOCK_QUERIES))
            for query, mine in zip(queries[rows], best_rows(q[rows], q_norm[rows], v[c:d], v_norm[c:d], ids[c:d], k)):
                found += [(query, i, -s) for s, i in mine]
    return pd.DataFrame(found, columns=columns)


def cosine_topk_lsh(corpus: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
                    query_vec_col: str = "embedding", width: int = 64, tables: int = TABLES, bits: int | None = None,
                    probes: int = PROBES) -> DataFrame:
    """(query_id, id, score, rank) of the k best vectors in the buckets a query visits (ties: smaller id)."""
    total = corpus.count()
    bits = bits or bits_for(total)
    probes = min(probes, len(crossings(bits)))
    fit = lambda c: (F.size(c) == width) & ~F.exists(c, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = corpus.select(F.col(id_col).alias("_id"), F.col(vec_col).alias("_v")).filter(fit("_v"))
    q = queries.select("query_id", F.col(query_vec_col).alias("_q")).filter(fit("_q"))
    # index and queries with their buckets, kept once: bucket sizes are counted and rows dealt from there
    index = cut_lineage(v.withColumn("_c", buckets(F.col("_v"), tables, bits, width)))
    stored = index.select("_id", "_v", F.posexplode("_c").alias("_t", "_b"))
    asked = cut_lineage(q.withColumn("_c", visited(F.col("_q"), tables, bits, width, probes))).select(
        "query_id", "_q", F.posexplode("_c").alias("_at", "_b"))
    asked = asked.withColumn("_t", F.floor(F.col("_at") / probes).cast("int")).drop("_at")
    # buckets too large for one group, with their number of parts: few and narrow
    large = (stored.groupBy("_t", "_b").agg(F.ceil(F.count(F.lit(1)) / SHARD_VECTORS).cast("int").alias("_n"))
             .filter(F.col("_n") > 1))
    parts = F.coalesce("_n", F.lit(1))
    stored = (stored.join(large, ["_t", "_b"], "left")
              .withColumn("_s", F.pmod(F.xxhash64("_id", "_v", F.spark_partition_id()), parts).cast("int")).drop("_n"))
    asked = (asked.join(large, ["_t", "_b"], "left")
             .withColumn("_s", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_n"))
    # many small buckets share a group; ``_k`` names a bucket's part
    groups = max(MIN_SHARDS, -(-total * tables // SHARD_VECTORS))
    part = F.xxhash64("_t", "_b", "_s")
    asked, stored = (x.withColumn("_k", part).withColumn("_g", F.pmod(F.col("_k"), F.lit(groups)).cast("int"))
                     .drop("_t", "_b", "_s") for x in (asked, stored))
    found = (asked.groupBy("_g").cogroup(stored.groupBy("_g"))
             .applyInPandas(lambda a, b: visits(a, b, k), found_schema(corpus, queries, id_col)))
    return best_of(found.groupBy("query_id", "_id").agg(F.max("score").alias("score")), k, id_col)
