"""Hard-negative mining over STR-packed R-trees.

Vectors are dealt over shards by a hash (of id, vector and input partition, so repeated rows spread as well). Every shard
packs its vectors into an R-tree by sort-tile-recursion: cut by label first, then tile by tile along the coordinates of
the largest spread, ``LEAF`` neighbours a leaf and ``FAN`` boxes a parent. A box keeps the least and largest value
of every coordinate and of the label. With an anchor's vector, each coordinate of a box gives an interval of
products, and their sum an interval that holds every inner product below it.

A best-first queue opens the box with the highest upper end. A box is pruned when its labels cannot serve, when its
interval misses every score window that is still asked for, or when it lies strictly below the k-th best score of each; equal scores are
looked at, so ties go to the smaller id, exactly. Positives come first (one open window), their scores set the windows of the
negatives, and a second search answers all windows of an anchor in one walk. Anchors meet the shards in blocks; each shard
returns its best rows and a window merges the shards.

Results: rows without id or label, or whose vector is null or holds a null or non-finite component, take no part; vectors of different
width meet in their common dimensions. Anchors that repeat are answered once per id (for their smallest label, then vector); rows
that share an anchor's id are neither its positives nor its negatives. Other repeated rows are candidates of their own. An anchor
without positives has no row, nor has a positive whose window is empty (scores below zero). Scores beyond a long stop at its limits; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import cut, table
from docyard.llm.topk import LONGEST, as_integers, exact_type, usable

POSITIVES = 5
NEGATIVES = 3
#: A negative scores between these percentages of its positive.
LOW, HIGH = 50, 95
SCALE = 256
ANCHOR_STEP = 50
#: Every so manyth id carries a label moved by one, of so many labels.
MOVED_STEP, LABELS = 7, 10
#: Vectors per shard, the least number of shards, and anchors per block.
SHARD_VECTORS = 16_384
MIN_SHARDS = 16
ANCHOR_BLOCK = 4_096
#: Vectors a leaf and boxes a parent.
LEAF = 256
FAN = 16


def tile(rows: np.ndarray, vectors: np.ndarray, dims: np.ndarray, leaf: int) -> list[np.ndarray]:
    """Sort-tile-recursion: leaves of at most ``leaf`` rows."""
    pages = -(-len(rows) // leaf)
    if pages <= 1:
        return [rows]
    use = dims[:max(1, int(pages - 1).bit_length())]
    if not len(use):
        return np.array_split(rows, pages)
    slabs = pages if len(use) == 1 else int(np.ceil(pages ** (1 / len(use))))
    size = leaf * -(-pages // slabs)
    ordered = rows[np.argsort(vectors[rows, use[0]], kind="stable")]
    return [page for a in range(0, len(ordered), size) for page in tile(ordered[a:a + size], vectors, use[1:], leaf)]


def pack(labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Leaves in packing order: labels with enough vectors have tiles of their own, rare ones share."""
    order = np.argsort(labels, kind="stable")
    groups, few = [], []
    for run in np.split(order, np.flatnonzero(np.diff(labels[order])) + 1):
        if len(run) >= leaf:
            groups.append(run)
        else:
            few.append(run)
            if sum(map(len, few)) >= leaf:
                groups.append(np.concatenate(few))
                few = []
    if few:
        groups.append(np.concatenate(few))
    out = []
    for rows in groups:
        spread = vectors[rows].astype(np.float64).std(axis=0)
        out += tile(rows, vectors, np.argsort(-spread, kind="stable"), leaf)
    return out


class RTree:
    """Boxes over one shard's vectors, leaves first; ``levels[h]`` holds the boxes of height h."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, leaf: int = LEAF, fan: int = FAN):
        leaves = pack(labels, vectors, leaf)
        order = np.concatenate(leaves)
        self.ids, self.labels, self.vectors = ids[order], labels[order], vectors[order]
        self.levels = []
        low = high = self.vectors
        first = last = self.labels
        starts = np.cumsum([0, *map(len, leaves)])
        while True:
            at, ends = starts[:-1], starts
            low, high = np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            first, last = np.minimum.reduceat(first, at), np.maximum.reduceat(last, at)
            self.levels.append((low, high, first, last, ends))
            if len(at) == 1:
                break
            starts = np.append(np.arange(0, len(at), fan), len(at))
        self.opened = 0

    def search(self, anchor: int, label: int, q: np.ndarray, windows: list[tuple], k: int, same: bool) -> list[list[tuple]]:
        """Per window (low, high): its k best (score, id), best first, of the anchor's label or of the other labels."""
        up, down = np.maximum(q, 0), np.minimum(q, 0)
        best: list[list[tuple]] = [[] for _ in windows]
        bars = [low for low, _ in windows]  # below, a score is of no use to the window

        def boxes(height: int, a: int, b: int):
            low, high, first, last, _ = (x[a:b] for x in self.levels[height])
            keep = (first <= label) & (label <= last) if same else (first != label) | (last != label)
            top, least = high @ up + low @ down, low @ up + high @ down
            if top.dtype == object:
                top, least = np.clip(top, -LONGEST - 1, LONGEST), np.clip(least, -LONGEST - 1, LONGEST)
            return [(-t, height, a + k, s) for k, (t, s) in enumerate(zip(top, least)) if keep[k]]

        queue = boxes(len(self.levels) - 1, 0, 1)
        heapq.heapify(queue)
        while queue:
            top, height, at, least = heapq.heappop(queue)
            top = -top
            if top < min(bars):
                break  # every box left lies strictly below each window's bar
            if not any(min(top, high) >= bar and least <= high for bar, (_, high) in zip(bars, windows)):
                continue
            ends = self.levels[height][4]
            a, b = ends[at], ends[at + 1]
            if height:
                for box in boxes(height - 1, a, b):
                    heapq.heappush(queue, box)
                continue
            self.opened += 1
            score = self.vectors[a:b] @ q
            if score.dtype == object:
                score = np.clip(score, -LONGEST - 1, LONGEST)
            mine = (self.ids[a:b] != anchor) & ((self.labels[a:b] == label) == same)
            for w, (_, high) in enumerate(windows):
                rows = np.flatnonzero(mine & (score >= bars[w]) & (score <= high))
                if len(rows):
                    found = best[w] + [(int(score[r]), int(self.ids[a + r])) for r in rows]
                    best[w] = sorted(found, key=lambda x: (-x[0], x[1]))[:k]
                    if len(best[w]) == k:
                        bars[w] = max(bars[w], best[w][-1][0])
        return best


def window_of(score: int, low: int = LOW, high: int = HIGH) -> tuple[int, int]:
    """Least and largest score s with low * score <= 100 * s <= high * score."""
    return -(-low * score // 100), high * score // 100


def search_shard(anchors: pd.DataFrame, rows: pd.DataFrame, k: int, same: bool, low: int, high: int) -> pd.DataFrame:
    """The best rows of one shard for one block of anchors; ``turn`` numbers an anchor's windows from 0."""
    names = ["anchor_id", "turn", "vec_id", "score"]
    if anchors.empty or rows.empty:
        return pd.DataFrame({c: pd.Series(dtype="int64") for c in names})
    width = max(max(map(len, anchors["embedding"])), max(map(len, rows["embedding"])))
    v, q = as_integers(rows["embedding"].to_list(), width), as_integers(anchors["embedding"].to_list(), width)
    kind = exact_type(v, q)
    if kind is object:
        v, q = (np.vectorize(int, otypes=[object])(x) if x.size else x.astype(object) for x in (v, q))
    tree = RTree(rows["vec_id"].to_numpy(np.int64), rows["label"].to_numpy(np.int64), v)
    out = []
    everything = [(-LONGEST - 1, LONGEST)]
    for n, (anchor, label) in enumerate(zip(anchors["vec_id"], anchors["label"])):
        windows = everything if same else [window_of(int(s), low, high) for s in anchors["scores"].iat[n]]
        asked = [(t, w) for t, w in enumerate(windows) if w[0] <= w[1]]
        if asked:
            got = tree.search(int(anchor), int(label), q[n], [w for _, w in asked], k, same)
            out += [(int(anchor), t, i, s) for (t, _), best in zip(asked, got) for s, i in best]
    return pd.DataFrame(out, columns=names).astype("int64")


def _search(anchors: DataFrame, rows: DataFrame, k: int, same: bool, shards: int, blocks: int, low: int, high: int) -> DataFrame:
    """The k best rows per anchor and window over all shards, ranked from 1."""
    dealt = (rows.withColumn("shard", F.pmod(F.xxhash64("vec_id", "embedding", F.spark_partition_id()), F.lit(shards)).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
    asked = (anchors.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int"))
             .withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))))
    found = (asked.groupBy("shard", "block").cogroup(dealt.groupBy("shard", "block"))
             .applyInPandas(lambda a, r: search_shard(a, r, k, same, low, high), "anchor_id long, turn long, vec_id long, score long"))
    order = Window.partitionBy("anchor_id", "turn").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _taking_part(rows: DataFrame) -> DataFrame:
    return usable(rows).filter(F.col("label").isNotNull()).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")


def hard_negatives(rows: DataFrame, anchors: DataFrame, positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW,
                   high: int = HIGH) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score. Both: vec_id, label, embedding."""
    rows = _taking_part(rows)
    anchors = (_taking_part(anchors).groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("a"))
               .select("vec_id", "a.label", "a.embedding"))
    shards = int(max(MIN_SHARDS, -(-rows.count() // SHARD_VECTORS)))
    blocks = int(max(1, -(-anchors.count() // ANCHOR_BLOCK)))
    first = _search(anchors.withColumn("scores", F.array().cast("array<long>")), rows, positives, True, shards, blocks, low, high)
    listed = first.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("p"))
    known = cut(anchors.join(listed, anchors["vec_id"] == listed["anchor_id"]).select(
        "vec_id", "label", "embedding", F.col("p.score").alias("scores"), F.col("p.vec_id").alias("ids")))
    second = _search(known.drop("ids"), rows, negatives, False, shards, blocks, low, high)
    turn = F.col("turn").cast("int")
    return (second.join(known.select(F.col("vec_id").alias("anchor_id"), "scores", "ids"), "anchor_id")
            .select("anchor_id", F.get("ids", turn).alias("positive_id"), "rank", F.col("vec_id").alias("negative_id"),
                    F.get("scores", turn).alias("positive_score"), F.col("score").alias("negative_score")))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % MOVED_STEP == 0, (F.col("label").cast("long") + 1) % LABELS).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").select("vec_id", moved.alias("label"), "embedding")
    return hard_negatives(rows, rows.filter(F.col("vec_id") % ANCHOR_STEP == 0))


SQL = f"""
WITH v AS (SELECT vec_id, CASE WHEN vec_id % {MOVED_STEP} = 0 THEN (label + 1) % {LABELS} ELSE label END AS label,
                  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)::BIGINT) AS e
           FROM embeddings
           WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
     s AS (SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same,
                  list_sum(list_transform(list_zip(a.e, c.e), lambda z: z[1] * z[2]))::BIGINT AS score
           FROM v a JOIN v c ON a.vec_id % {ANCHOR_STEP} = 0 AND a.vec_id <> c.vec_id),
     p AS (SELECT anchor_id, vec_id, score, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) AS turn
           FROM s WHERE same QUALIFY turn <= {POSITIVES}),
     n AS (SELECT p.anchor_id, p.vec_id AS positive_id, s.vec_id AS negative_id, p.score AS positive_score,
                  s.score AS negative_score,
                  row_number() OVER (PARTITION BY p.anchor_id, p.turn ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
           FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same
                        AND {LOW} * p.score <= 100 * s.score AND 100 * s.score <= {HIGH} * p.score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM n WHERE rank <= {NEGATIVES}
"""
