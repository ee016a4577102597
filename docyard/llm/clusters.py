"""Centroid clustering (Lloyd's rounds on integers) with a PCA-rotated filter.

All vectors are rotated once by the principal axes of their covariance, taken over all rows. Stored per vector, beside its integers: its
``LEAD`` leading rotated coordinates and the norm of the rest (the residual). For a vector and a centroid, the squared
distance of the leading coordinates plus the squared difference of the residual norms is a lower bound of
the squared distance. Each vector is measured exactly, in integers, against the centroid of the least bound; then only
centroids whose bound does not exceed the best distance so far are verified, again in integers. The bound is lowered by far more than
the rounding of the rotation can be, so floats decide only what is not measured, never a result.

A round reads the stored table; each task adds up its vectors per cluster in exact integers and sends at most one row per cluster and
component, which Spark sums as decimals. The driver holds the centroids alone.

Results: vectors that are null, have another width, or hold a null or non-finite component take no part. Integers beyond a long
stop at its limits, as do distances and sums of distances. The starts are chosen by hash of the id (rows without id last, equal
ids by their vector); with fewer vectors than centroids every vector is a start. A row without id is clustered like any other, repeated rows
each for themselves. Equal distances go to the smaller cluster; a cluster that loses all its vectors keeps its centroid.
An empty table gives an empty result. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.llm.common import cut, table
from docyard.session import drop_path, scratch_path

WIDTH = 64
SCALE = 64
CENTROIDS = 16
ROUNDS = 3
SEED = "1:"
#: Leading rotated coordinates that are stored.
LEAD = 8
#: Below this size of components int64 holds every squared distance; beyond, Python integers.
SMALL = 1 << 25
#: Share of the squared norms by which bounds are lowered: rounding errors are below 1e-12 of them.
SLACK = 1e-9
LONGEST = (1 << 63) - 1


def usable(vectors: DataFrame, width: int = WIDTH) -> DataFrame:
    """vec_id and the integer vector ``x`` of the rows that take part."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return vectors.filter(F.col("embedding").isNotNull() & (F.size("embedding") == width) & ~bad).select(
        F.col("vec_id").cast("long").alias("vec_id"),
        F.transform("embedding", lambda c: F.floor(c.cast("double") * SCALE)).alias("x"))


def matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    """A list column of one width as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


class Rotation:
    """Principal axes: rotates vectors into leading coordinates and a residual norm."""

    def __init__(self, mean: np.ndarray, axes: np.ndarray, lead: int):
        self.mean, self.axes, self.lead = mean, axes, lead

    def __call__(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        y = (x.astype(np.float64) - self.mean) @ self.axes
        return y[:, :self.lead], np.sqrt(np.square(y[:, self.lead:]).sum(axis=1))


def fit_rotation(vectors: DataFrame, width: int, lead: int) -> Rotation:
    """The rotation of all vectors' covariance; one row of sums per task, added up by Spark."""
    def sums(batches):
        total = np.zeros(1 + width + width * width)
        for batch in batches:
            x = matrix(batch, "x", width).astype(np.float64)
            total += np.concatenate([[len(x)], x.sum(axis=0), (x.T @ x).ravel()])
        yield pa.RecordBatch.from_pydict({"s": pa.array([total.tolist()], pa.list_(pa.float64()))})

    parts = vectors.select("x").mapInArrow(sums, "s array<double>").select(F.posexplode("s").alias("at", "s"))
    got = {r["at"]: r["s"] for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect()}
    s = np.array([got.get(k, 0.0) for k in range(1 + width + width * width)])
    n = max(s[0], 1.0)
    mean = s[1:1 + width] / n
    _, axes = np.linalg.eigh(s[1 + width:].reshape(width, width) / n - np.outer(mean, mean))
    return Rotation(mean, np.ascontiguousarray(axes[:, ::-1]), lead)  # largest spread first


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of the rows of ``x`` to ``c``."""
    d = x - c
    return (d * d).sum(axis=1)


def nearest(x: np.ndarray, lead: np.ndarray, rest: np.ndarray, centroids: np.ndarray,
            rotation: Rotation) -> tuple[np.ndarray, np.ndarray, int]:
    """Cluster and exact squared distance per row, and how many distances were measured."""
    most = max(np.abs(x.astype(np.float64)).max(initial=0), np.abs(centroids.astype(np.float64)).max(initial=0))
    kind = np.int64 if most < SMALL else object
    x, centroids = x.astype(kind), centroids.astype(kind)
    c_lead, c_rest = rotation(centroids)
    norm = lambda a, b: np.sqrt(np.square(a).sum(axis=1) + b * b)
    bound = np.square(rest[:, None] - c_rest[None, :])
    for k in range(lead.shape[1]):
        bound += np.square(lead[:, k:k + 1] - c_lead[None, :, k])
    bound -= SLACK * np.square(norm(lead, rest)[:, None] + norm(c_lead, c_rest)[None, :])
    cluster = bound.argmin(axis=1)
    best = squared(x, centroids[cluster])
    first, near, measured = cluster.copy(), best.astype(np.float64) * (1 + 1e-12), len(x)
    for c in range(len(centroids)):
        rows = np.flatnonzero((bound[:, c] <= near) & (first != c))
        if len(rows):
            d = squared(x[rows], centroids[c])
            better = (d < best[rows]) | ((d == best[rows]) & (c < cluster[rows]))
            rows, d = rows[better], d[better]
            cluster[rows], best[rows] = c, d
            near[rows] = d.astype(np.float64) * (1 + 1e-12)
            measured += len(better)
    return cluster, best, measured


def _stored(batch: pa.RecordBatch, width: int, lead: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (matrix(batch, "x", width), matrix(batch, "lead", lead),
            batch.column("rest").to_numpy(zero_copy_only=False))


def cluster_sums(store: DataFrame, centroids: list[list[int]], rotation: Rotation) -> dict[int, tuple[int, list[int]]]:
    """Per non-empty cluster: its number of vectors and the exact sum of each component."""
    width = len(centroids[0])

    def work(batches):
        at = np.array(centroids, dtype=object)
        total = np.zeros((len(at), width + 1), dtype=object)
        for batch in batches:
            x, lead, rest = _stored(batch, width, rotation.lead)
            cluster, _, _ = nearest(x, lead, rest, at, rotation)
            safe = np.abs(x.astype(np.float64)).max(initial=0) * max(1, len(x)) < 2.0 ** 62
            x = x if safe else x.astype(object)
            for c in np.unique(cluster):
                rows = x[cluster == c]
                total[c, 0] += len(rows)
                total[c, 1:] += rows.sum(axis=0).astype(object)
        c, k = np.nonzero(total)
        yield pa.RecordBatch.from_pydict({
            "c": pa.array(c.astype(np.int32)), "k": pa.array(k.astype(np.int32)),
            "s": pa.array([Decimal(int(v)) for v in total[c, k]], pa.decimal128(38, 0))})

    parts = store.select("x", "lead", "rest").mapInArrow(work, "c int, k int, s decimal(38,0)")
    rows = {(r["c"], r["k"]): int(r["s"]) for r in parts.groupBy("c", "k").agg(F.sum("s").alias("s")).collect()}
    return {c: (n, [rows.get((c, k), 0) for k in range(1, width + 1)]) for (c, zero), n in rows.items() if zero == 0}


def assign(store: DataFrame, centroids: list[list[int]], rotation: Rotation) -> DataFrame:
    """vec_id, cluster, distance."""
    width = len(centroids[0])

    def work(batches):
        at = np.array(centroids, dtype=object)
        for batch in batches:
            x, lead, rest = _stored(batch, width, rotation.lead)
            cluster, best, _ = nearest(x, lead, rest, at, rotation)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)),
                 pa.array(np.minimum(best, LONGEST).astype(np.int64))], ["vec_id", "cluster", "distance"])

    return store.mapInArrow(work, "vec_id long, cluster int, distance long")


def write_store(vectors: DataFrame, rotation: Rotation, path: str, width: int) -> None:
    """The table of integers, leading coordinates and residual norms, once, in the shared folder."""
    def work(batches):
        for batch in batches:
            lead, rest = rotation(matrix(batch, "x", width))
            ends = pa.array(np.arange(len(lead) + 1, dtype=np.int32) * rotation.lead)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(lead.ravel())),
                 pa.array(rest)], ["vec_id", "x", "lead", "rest"])

    vectors.mapInArrow(work, "vec_id long, x array<long>, lead array<double>, rest double").write.parquet(path)


def centroid_clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH, lead: int = LEAD,
                      seed: str = SEED) -> DataFrame:
    """Per vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    spark = vectors.sparkSession
    own = usable(vectors, width)
    code = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256)
    centroids = [r["x"] for r in own.orderBy(code.asc_nulls_last(), "x").limit(k).collect()]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, "
                                         "centroid_sha256 string")
    rotation = fit_rotation(own, width, min(lead, width))
    path = scratch_path(spark, "clusters")
    try:
        write_store(own, rotation, path, width)
        store = spark.read.parquet(path)
        for _ in range(rounds):
            for c, (n, sums) in cluster_sums(store, centroids, rotation).items():
                centroids[c] = [s // n for s in sums]
        assigned = cut(assign(store, centroids, rotation))
    finally:
        drop_path(spark, path)
    spread = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster")
              .agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    own_sum = F.array(*[F.lit(min(spread.get(c, 0), LONGEST)).cast("long") for c in range(len(centroids))])
    digest = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    return assigned.select("vec_id", "cluster", "distance", F.get(own_sum, F.col("cluster")).alias("cluster_inertia"),
                           F.lit(min(sum(spread.values()), LONGEST)).cast("long").alias("inertia"),
                           F.get(digest, F.col("cluster")).alias("centroid_sha256"))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroid_clusters(table(spark, sf_dir, "embeddings"))


def _round_sql(n: int) -> str:
    """Assignment to the centroids c<n> (a<n>) and the next centroids."""
    d = "(list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))))::BIGINT"
    assigned = f"""a{n} AS MATERIALIZED (SELECT v.row, min({{'d': {d}, 'c': c.c}}) AS m FROM v JOIN c{n} c ON TRUE GROUP BY v.row)"""
    if n == ROUNDS:
        return assigned
    floor = "((s - ((s % n + n) % n)) // n)::BIGINT"
    return f"""{assigned},
     s{n} AS (SELECT a.m.c AS c, p.pos, sum(v.x[p.pos]) AS s, count(*) AS n
              FROM a{n} a JOIN v ON v.row = a.row JOIN (SELECT unnest(range(1, {WIDTH} + 1)) AS pos) p ON TRUE GROUP BY 1, 2),
     c{n + 1} AS MATERIALIZED (SELECT o.c, coalesce(t.x, o.x) AS x FROM c{n} o
              LEFT JOIN (SELECT c, list({floor} ORDER BY pos) AS x FROM s{n} GROUP BY c) t ON t.c = o.c)"""


SQL = f"""
WITH v AS MATERIALIZED (
       SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS x
       FROM embeddings WHERE len(embedding) = {WIDTH} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     c0 AS MATERIALIZED (
       SELECT row_number() OVER (ORDER BY sha256('{SEED}' || vec_id) NULLS LAST, x) - 1 AS c, x FROM v
       QUALIFY row_number() OVER (ORDER BY sha256('{SEED}' || vec_id) NULLS LAST, x) <= {CENTROIDS}),
     {(','+chr(10)+'     ').join(_round_sql(n) for n in range(ROUNDS + 1))}
SELECT v.vec_id, a.m.c::INTEGER AS cluster, a.m.d AS distance, (sum(a.m.d) OVER (PARTITION BY a.m.c))::BIGINT AS cluster_inertia,
       (sum(a.m.d) OVER ())::BIGINT AS inertia,
       sha256(array_to_string(list_transform(c.x, lambda y: y::VARCHAR), ',')) AS centroid_sha256
FROM a{ROUNDS} a JOIN v ON v.row = a.row JOIN c{ROUNDS} c ON c.c = a.m.c
"""
