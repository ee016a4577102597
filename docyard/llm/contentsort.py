"""Exact dedup by a content sort, in DataFrame functions only.

Texts count as equal when they are identical after lower-casing A-Z. The order of the sort is: the first
characters of the normalised text, the hash of all its bytes, the whole text, the id. Splitters sampled
from all rows cut that order into buckets of about ``BUCKET_BYTES``; a row finds its bucket by a binary search over the
splitters and goes there directly. Inside a bucket the external sort places equal texts next to each other, and
the window walks the sorted rows, comparing each with its neighbour over the full text; the first row of a run stays.

A splitter also names an id and an input partition, so a text on a third of all rows is cut over
as many buckets as its bytes need, even where all its rows are alike. Only a text that a splitter was taken from can
lie in several buckets. Its runs, one row per bucket, are merged by their full texts and the result, at most two runs a
bucket, is broadcast to the narrow rows.

Results: of equal texts the row with the smallest id stays (``largest=True``: the largest). A null text counts as the empty
one. Rows without id come last: one of them stays only where no copy has an id. Of repeated rows of the winning id exactly one
stays. An empty table gives an empty result. Very long texts are compared whole, only their first characters and
their hash enter the splitters. Other columns are ignored by ``content_groups`` and carried by ``drop_copies``; their names may
clash with any name used here.
"""

from __future__ import annotations

import json
import string

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docyard.llm.common import cut, fresh, table, text_or_empty

#: Bytes of text that a bucket holds on average, and the most buckets (beyond, buckets grow and their sorts spill).
BUCKET_BYTES = 32 << 20
MAX_BUCKETS = 16_384
#: Rows sampled per bucket to choose its splitter.
SAMPLED = 32
#: Characters of the text at the front of the sort order.
HEAD = 24
KEY = "array<struct<head: string, code: bigint, id: bigint, place: int>>"


def normalised(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed."""
    plain = F.octet_length(text) == F.length(text)  # ASCII only, where the fast general form is the same
    return F.when(plain, F.lower(text)).otherwise(
        F.translate(text, string.ascii_uppercase, string.ascii_lowercase))


class ContentSort:
    """The sort of one table; column names of its own that clash with none of the table's."""

    def __init__(self, docs: DataFrame, largest: bool):
        self.largest = largest
        self.names = fresh(docs.columns, "norm", "head", "code", "place", "bucket", "divided", "first", "n", "turn", "whole", "sha",
                           "keep", "size", "winner")
        (self.norm, self.head, self.code, self.place, self.bucket, self.divided, self.first, self.n, self.turn, self.whole,
         self.sha, self.keep, self.size, self.winner) = self.names
        spark = docs.sparkSession
        text = docs.withColumn(self.norm, normalised(text_or_empty()))
        self.rows = (text.withColumn(self.head, F.substring(self.norm, 1, HEAD))
                     .withColumn(self.code, F.xxhash64(self.norm)).withColumn(self.place, F.spark_partition_id()))
        self.key = F.struct(F.col(self.head).alias("head"), F.col(self.code).alias("code"),
                            F.col("doc_id").cast("long").alias("id"), F.col(self.place).alias("place"))
        total, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
        wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES))
        self.splitters = self._splitters(total, min(wanted, MAX_BUCKETS))

    def _splitters(self, total: int, buckets: int) -> list[dict]:
        """Every ``SAMPLED``-th key of a sorted sample of rows; at most ``buckets - 1`` narrow keys."""
        if total == 0:
            return []
        share = min(1.0, SAMPLED * buckets / total)
        sample = self.rows.select(self.key.alias("k")).sample(fraction=share, seed=11).orderBy("k")
        keys = [r["k"].asDict() for r in sample.collect()]
        step = max(1, -(-len(keys) // buckets))
        cuts = keys[step::step]
        return [k for a, k in zip([None, *cuts], cuts) if k != a]

    def runs(self, carry: list[str]) -> DataFrame:
        """The sorted rows: ``carry``, the run's first id and length, the row's place in it."""
        n = len(self.splitters)
        cuts = F.from_json(F.lit(json.dumps(self.splitters)), KEY)  # a literal once the plan is optimised
        steps = F.array(*[F.lit(1 << b) for b in reversed(range(max(1, n.bit_length())))])
        find = F.transform(F.array(self.key), lambda key: F.aggregate(steps, F.lit(0), lambda at, step: F.when(
            (at + step <= n) & (F.get(cuts, at + step - 1) <= key), at + step).otherwise(at)))
        dealt = self.rows.withColumn(self.bucket, F.get(find, F.lit(0)) if n else F.lit(0))
        near = lambda at: F.coalesce(F.get(cuts, at)["code"] == F.col(self.code), F.lit(False))
        dealt = (dealt.withColumn(self.divided, near(F.col(self.bucket) - 1) | near(F.col(self.bucket)))
                 .select(*carry, self.norm, self.head, self.code, self.bucket, self.divided)
                 .repartitionById(n + 1, F.col(self.bucket)))
        ident = F.col("doc_id").cast("long")
        best = ident.desc_nulls_last() if self.largest else ident.asc_nulls_last()
        run = Window.partitionBy(self.bucket, self.head, self.code, self.norm).orderBy(best)
        whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        return dealt.select(
            *carry, self.bucket, self.divided, F.row_number().over(run).alias(self.turn),
            F.first(ident).over(whole).alias(self.first), F.count(F.lit(1)).over(whole).alias(self.n), self.norm,
        ).select(
            *carry, self.bucket, self.divided, self.turn, self.first, self.n, F.sha2(self.norm, 256).alias(self.sha),
            F.when(F.col(self.divided) & (F.col(self.turn) == 1), F.col(self.norm)).alias(self.whole))

    def merged(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the kept id, the group's size and the bucket of the row that stays."""
        best = F.col(self.first).desc_nulls_last() if self.largest else F.col(self.first).asc_nulls_last()
        order = Window.partitionBy(self.whole).orderBy(best, self.bucket)
        group = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        heads = rows.filter(F.col(self.whole).isNotNull()).select(
            self.bucket, self.sha, F.first(self.first).over(group).alias(self.keep),
            F.sum(self.n).over(group).alias(self.size), F.first(self.bucket).over(group).alias(self.winner))
        own = F.coalesce(self.winner, self.bucket)
        # two texts a bucket at most are divided (and their like by hash): no more rows than twice the buckets
        return rows.join(F.broadcast(heads), [self.bucket, self.sha], "left").withColumns({
            self.keep: F.when(F.col(self.winner).isNull(), F.col(self.first)).otherwise(F.col(self.keep)),
            self.size: F.coalesce(self.size, self.n), self.winner: (F.col(self.turn) == 1) & (own == F.col(self.bucket))})


def content_groups(docs: DataFrame, largest: bool = False) -> DataFrame:
    """Per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (of the normalised text)."""
    sort = ContentSort(docs.select("doc_id", "text"), largest)
    out = sort.merged(cut(sort.runs(["doc_id"])))
    return out.select("doc_id", F.col(sort.keep).alias("keep_id"), F.col(sort.size).alias("group_size"),
                      F.col(sort.winner).alias("kept"), F.col(sort.sha).alias("text_sha256"))


def drop_copies(docs: DataFrame, largest: bool = False) -> DataFrame:
    """One row of each group of equal texts, with all columns as they were."""
    sort = ContentSort(docs, largest)
    heads = cut(sort.runs(docs.columns).filter(F.col(sort.turn) == 1))
    return sort.merged(heads).filter(sort.winner).select(*docs.columns)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return content_groups(table(spark, sf_dir, "documents"), largest=True)


SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS norm
           FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       row_number() OVER (PARTITION BY norm ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(norm) AS text_sha256
FROM d
"""
