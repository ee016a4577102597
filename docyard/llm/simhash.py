"""SimHash near-duplicates through a Gray-order hierarchical index.

*Fingerprint.* A text's words (ASCII white space separates, A-Z lower-cased) form three-word
shingles, repeats included; each shingle is hashed with XXH64 (seed 42); a bit of the fingerprint is
1 when it is set in more than half of the hashes. Fewer than three words are one shingle, no
words give fingerprint zero.

*Index.* Distinct fingerprints are sorted by **Gray rank**, so neighbours in the order share most of
their bits. Runs of neighbours become nodes of a tree; the bits all members share (a mask and
its pattern) are factored out into the node, and each level keeps only the bits that its
parent does not already hold. A search adds up the differing bits from the root down and drops a
whole group once they exceed the limit.

*Distribution.* The order is cut into shards of bounded size. The upper part of the tree (one node per
shard) is small and travels with the tasks: a fingerprint visits only those later shards whose shared
pattern is within the limit, so nothing is compared across pruned shards. A shard with many visitors
is searched in blocks. Each task keeps a spanning forest of the links it finds, not the pairs, and
components come from large-star / small-star rounds over those forest links.

Exact copies meet in one fingerprint before any comparison, so a group of copies holding a third of all
rows is one entry of the index.

Defined results: null and empty texts have fingerprint zero and are linked like any other; repeated
rows belong to one component, and the filter keeps one of them; an empty table gives an empty
result; a null id takes no part in the smallest id of a component (a component of null ids only has
a null id), and the filter keeps rows with a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import cut, fresh, table
from docyard.session import ship_package

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
#: Wanted fingerprints per shard, and the least and the largest number of shards.
SHARD_CODES = 16_384
MIN_SHARDS = 64
MAX_SHARDS = 65_536
#: Searching fingerprints per task of one shard.
BLOCK_QUERIES = 262_144
FANOUT = 8
#: Pairs of (fingerprint, node) looked at together; more are split.
FRONTIER = 1 << 20


def fingerprint(text: str | None, width: int = SHINGLE_WORDS) -> int:
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[:-width].tolist()]
    stops = (ends[width - 1:] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    counts, n = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, n, 65_536):  # bounded memory for very long texts
        hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[at:at + 65_536], stops[at:at + 65_536])),
                             dtype=np.uint64)
        bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << k for k in range(64) if 2 * counts[k] > n))


def fingerprint_column(text: str, width: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long with the same bits."""
    @F.pandas_udf("long")
    def udf(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            codes = np.fromiter((fingerprint(t, width) for t in texts), dtype=np.uint64, count=len(texts))
            yield pd.Series(codes.view(np.int64))
    return udf(F.col(text))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence (unsigned 64 bits)."""
    rank = codes.astype(np.uint64)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank ^ (rank >> np.uint64(shift))
    return rank


def gray_rank_column(code: str) -> Column:
    """The same rank in Spark, moved into signed order."""
    rank = F.col(code)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Tree over patterns given in Gray order; masks tell which bits of a pattern are shared (default: all)."""

    def __init__(self, patterns: np.ndarray, masks: np.ndarray | None = None, fanout: int = FANOUT):
        patterns = patterns.astype(np.uint64)
        masks = np.full(len(patterns), ~np.uint64(0)) if masks is None else masks.astype(np.uint64)
        self.fanout, self.size = fanout, len(patterns)
        self.patterns, self.masks = [patterns], [masks]
        while len(self.patterns[-1]) > fanout:
            starts = np.arange(0, len(self.patterns[-1]), fanout)
            every = np.bitwise_and.reduceat(self.patterns[-1], starts)
            some = np.bitwise_or.reduceat(self.patterns[-1], starts)
            shared = np.bitwise_and.reduceat(self.masks[-1], starts) & ~(every ^ some)
            self.patterns.append(every & shared)
            self.masks.append(shared)
        # a level holds only the bits that its parent does not
        self.own = [m & ~np.repeat(up, fanout)[:len(m)] for m, up in zip(self.masks, self.masks[1:])] + [self.masks[-1]]

    def search(self, queries: np.ndarray, limit: int, after: np.ndarray | None = None,
               frontier: int = FRONTIER) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Yield (query numbers, leaf numbers) within ``limit`` bits; only leaves behind ``after`` when given."""
        if self.size == 0 or len(queries) == 0:
            return
        queries = queries.astype(np.uint64)
        top = len(self.patterns) - 1
        width = len(self.patterns[top])
        step = max(1, frontier // width)
        for a in range(0, len(queries), step):
            q = np.repeat(np.arange(a, min(a + step, len(queries))), width)
            node = np.tile(np.arange(width), len(q) // width)
            stack = [(top, q, node, np.zeros(len(q), dtype=np.uint8))]
            while stack:
                level, q, node, spent = stack.pop()
                spent = spent + np.bitwise_count((queries[q] ^ self.patterns[level][node]) & self.own[level][node])
                keep = spent <= limit
                if after is not None:
                    keep &= (node + 1) * self.fanout ** level - 1 > after[q]
                q, node, spent = q[keep], node[keep], spent[keep]
                if len(q) == 0:
                    continue
                if level == 0:
                    yield q, node
                    continue
                part = max(1, frontier // self.fanout)
                for b in range(0, len(q), part):
                    pq, pn, ps = q[b:b + part], node[b:b + part], spent[b:b + part]
                    child = (pn[:, None] * self.fanout + np.arange(self.fanout)).ravel()
                    real = child < len(self.patterns[level - 1])
                    stack.append((level - 1, np.repeat(pq, self.fanout)[real], child[real],
                                  np.repeat(ps, self.fanout)[real]))


def merge(parent: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Union the numbered nodes ``u[i]`` and ``v[i]``; every node then points at its component's least node."""
    while True:
        pu, pv = parent[u], parent[v]
        live = pu != pv
        if not live.any():
            return parent
        u, v = u[live], v[live]
        np.minimum.at(parent, np.maximum(pu, pv)[live], np.minimum(pu, pv)[live])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up


def forest(index_codes: np.ndarray, own_queries: np.ndarray, visitors: np.ndarray,
           limit: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (code, root code) spanning all codes of one shard block within ``limit`` bits of each other."""
    codes = index_codes[np.argsort(gray_rank(index_codes))]
    index = GrayIndex(codes)
    place = pd.Series(np.arange(len(codes)), index=codes)
    at = place.loc[own_queries].to_numpy() if len(own_queries) else np.zeros(0, dtype=np.int64)
    nodes = np.concatenate([codes, visitors])
    parent = np.arange(len(nodes))
    for q, leaf in index.search(codes[at], limit, after=at):
        parent = merge(parent, at[q], leaf)
    for q, leaf in index.search(visitors, limit):
        parent = merge(parent, len(codes) + q, leaf)
    linked = parent != np.arange(len(nodes))
    return nodes[linked], nodes[parent[linked]]


def shard_table(codes: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Upper bounds of the shards' Gray ranks, and each shard's shared pattern and mask (at most MAX_SHARDS rows)."""
    shards = int(min(MAX_SHARDS, max(MIN_SHARDS, -(-n // SHARD_CODES)), max(n, 1)))
    ranked = codes.select("code", gray_rank_column("code").alias("rank"))
    cuts: list[int] = []
    if shards > 1:
        at = [k / shards for k in range(1, shards)]
        got = ranked.agg(F.percentile_approx("rank", at, max(10_000, 20 * shards)).alias("q")).first()["q"]
        cuts = sorted(set(got or []))
    bounds = np.array(cuts, dtype=np.int64)

    @F.pandas_udf("int")
    def shard_of(rank: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, rank.to_numpy(), side="left").astype(np.int32))

    rows = (ranked.groupBy(shard_of("rank").alias("shard"))
            .agg(F.expr("bit_and(code)").alias("every"), F.expr("bit_or(code)").alias("some")).collect())
    every = np.zeros(len(bounds) + 1, dtype=np.int64)
    some = np.full(len(bounds) + 1, -1, dtype=np.int64)
    for r in rows:
        every[r["shard"]], some[r["shard"]] = r["every"], r["some"]
    mask = ~(every ^ some)
    return bounds, (every & mask).view(np.uint64), mask.view(np.uint64)


def links(codes: DataFrame, n: int, limit: int = MAX_BITS) -> DataFrame:
    """Links (a, b) whose components are those of all pairs within ``limit`` bits. ``codes``: distinct ``code``."""
    bounds, patterns, masks = shard_table(codes, n)

    def home(values: np.ndarray) -> np.ndarray:
        return np.searchsorted(bounds, (gray_rank(values) ^ np.uint64(1 << 63)).view(np.int64), side="left")

    def visits(values: np.ndarray, tree: GrayIndex) -> tuple[np.ndarray, np.ndarray]:
        own = home(values)
        found = [(q[s > own[q]], s[s > own[q]]) for q, s in tree.search(values, limit, after=own)]
        empty = np.zeros(0, dtype=np.int64)
        return (np.concatenate([f[0] for f in found] or [empty]), np.concatenate([f[1] for f in found] or [empty]))

    def count_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, total = GrayIndex(patterns, masks), np.zeros(len(patterns), dtype=np.int64)
        for pdf in batches:
            values = pdf["code"].to_numpy(dtype=np.int64).view(np.uint64)
            total += np.bincount(visits(values, tree)[1], minlength=len(patterns))
            total += np.bincount(home(values), minlength=len(patterns))
        busy = np.nonzero(total)[0]
        yield pd.DataFrame({"shard": busy, "n": total[busy]})

    blocks = np.ones(len(patterns), dtype=np.int64)
    for r in codes.mapInPandas(count_visits, "shard long, n long").groupBy("shard").agg(F.sum("n").alias("n")).collect():
        blocks[r["shard"]] = max(1, -(-int(r["n"]) // BLOCK_QUERIES))

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Kind 0: indexed only, 1: indexed and searching, 2: visitor."""
        tree = GrayIndex(patterns, masks)
        for pdf in batches:
            values = pdf["code"].to_numpy(dtype=np.int64).view(np.uint64)
            salt = (values * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
            own = home(values)
            copies = blocks[own]
            who = np.repeat(np.arange(len(values)), copies)
            block = np.arange(len(who)) - np.repeat(np.cumsum(copies) - copies, copies)
            mine = block == (salt[who] % copies[who].astype(np.uint64)).astype(np.int64)
            q, shard = visits(values, tree)
            yield pd.DataFrame({
                "shard": np.concatenate([own[who], shard]).astype(np.int32),
                "block": np.concatenate([block, (salt[q] % blocks[shard].astype(np.uint64)).astype(np.int64)]).astype(np.int32),
                "kind": np.concatenate([mine.astype(np.int8), np.full(len(q), 2, dtype=np.int8)]),
                "code": np.concatenate([values[who], values[q]]).view(np.int64)})

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        values, kind = pdf["code"].to_numpy(dtype=np.int64).view(np.uint64), pdf["kind"].to_numpy()
        a, b = forest(values[kind < 2], values[kind == 1], values[kind == 2], limit)
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    return (codes.mapInPandas(route, "shard int, block int, kind byte, code long")
            .groupBy("shard", "block").applyInPandas(search, "a long, b long"))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root being the least node of its component.

    Large-star and small-star rounds as joins: minima are combined before they are shuffled, and a
    node with very many neighbours is only ever one side's key of a join that Spark can split.
    """
    pairs = cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now[0] == 0 or now == state:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .filter("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (large.join(low, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        pairs = cut(small)


def near_duplicates(docs: DataFrame, width: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """(doc_id, code, component_id) per row of ``docs`` (checkpointed, narrow)."""
    marked = cut(docs.select("doc_id", fingerprint_column("text", width).alias("code")))
    codes = cut(marked.groupBy("code").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(codes.select("code"), codes.count(), limit))
    rooted = codes.join(roots, codes["code"] == roots["node"], "left").select(
        "code", "first_id", F.coalesce("root", "code").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    classes = rooted.join(least, "root").select("code", "component_id")
    return marked.join(classes, "code")


def keep_one(docs: DataFrame, width: int = SHINGLE_WORDS, limit: int = MAX_BITS) -> DataFrame:
    """``docs`` with one row of every component (its smallest id); columns as they were.

    Rows that repeat an id and a text leave one; where such rows differ in other columns, which one it is is not defined.
    """
    found = near_duplicates(docs.select("doc_id", "text"), width, limit)
    (keep, turn) = fresh(docs.columns, "_keep", "_turn")
    heads = found.filter("component_id is not null").select(F.col("component_id").alias(keep)).distinct()
    stay = docs.join(heads, docs["doc_id"] == heads[keep], "left_semi")
    # repeated rows leave one; different texts under one id are different documents
    same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("doc_id")
    once = stay.withColumn(turn, F.row_number().over(same))
    return (once.filter(F.col(turn) == 1).select(*docs.columns)
            .unionByName(docs.filter(F.col("doc_id").isNull())))


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return keep_one(docs)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("code"), 16, "0")).alias("fingerprint"), "component_id")
