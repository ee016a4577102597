"""Line dedup by distinct-site spread, in DataFrame functions only.

A line that many *sites* (sources) share is boilerplate, however often one site repeats it. Per line
hash, HyperLogLog sketches of the sites are built on the map side and merged by the aggregation, so
a line on a third of all rows reaches its reducer as one sketch per task. Lines whose estimate is near the threshold
get an exact distinct count; the others are decided by the estimate, far outside its error.
A boilerplate line goes from every document but the first one (smallest id) that holds it, so no text
leaves the corpus altogether.

Only hashes, ids and positions are exploded and shuffled; the text itself moves once, in the
join that brings each document its removed positions.

Both thresholds are absolute: on a table with fewer than ``MIN_SITES`` distinct sources nothing is removed at all, a line on
fewer sites stays on however many documents it is, and a line shorter than ``MIN_CHARS`` stays on however many sites.

Defined results: null and empty texts keep their value and have no removable line; lines shorter
than ``MIN_CHARS`` after trimming blanks stay; rows without a source count for no site; of rows that
repeat with the same id all hold the same lines; a line seen only in rows without id stays; an empty
table gives an empty result. Other columns are carried, ``n_chars`` follows a changed text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.llm.common import cut, fresh, table

#: A line on at least so many distinct sites is boilerplate.
MIN_SITES = 5
#: Shorter lines (trimmed, code points) are never removed.
MIN_CHARS = 12
#: log2 of the sketch's registers: a relative error of 1.6 %.
LG_K = 12
#: Lines whose estimate lies within this share of the threshold (two sites at least) are counted exactly.
NEAR = 0.15
#: Parts that the occurrences of one line are dealt over in joins, also those of one repeated row (a third of all rows).
SALTS = 32


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def occurrences(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough: line hash, site, id, row key, position. No text."""
    row = docs.select("doc_id", F.col("source").alias("site"),
                      F.xxhash64("doc_id", "text").alias("row_key"),
                      F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    trimmed = F.trim("line")
    return (row.filter(F.length(trimmed) >= min_chars)
            .select(F.xxhash64(trimmed).alias("key"), "site", "doc_id", "row_key", "pos",
                    F.pmod(F.xxhash64("row_key", F.spark_partition_id()), F.lit(SALTS)).cast("int").alias("salt")))


def _salted(lines: DataFrame) -> DataFrame:
    """Chosen lines (few, next to their occurrences), once per salt."""
    return lines.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """(key, first_id) of the lines on at least ``min_sites`` sites."""
    seen = occurrences(docs, min_chars)
    band = max(2.0, NEAR * min_sites)
    spread = seen.groupBy("key").agg(
        F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"), F.min("doc_id").alias("first_id"))
    likely = cut(spread.filter(F.col("sites") > min_sites - band))
    near = likely.filter(F.col("sites") < min_sites + band)
    exact = (seen.join(_salted(near.select("key")), ["key", "salt"], "left_semi").filter("site is not null")
             .groupBy("key", "site").agg(F.lit(1).alias("one"))
             .groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_sites))
    return cut(likely.filter(F.col("sites") >= min_sites + band).select("key", "first_id")
               .unionByName(near.join(exact.select("key"), "key", "left_semi").select("key", "first_id")))


def _without(lines: Column, gone: Column) -> Column:
    """The lines without the positions in ``gone`` (sorted, from 0), by slices between them: linear in the text."""
    stops = F.concat(gone, F.array(F.size(lines)))
    return F.flatten(F.transform(stops, lambda stop, i: F.slice(
        lines, F.when(i == 0, F.lit(1)).otherwise(F.get(stops, i - 1) + 2),
        stop - F.when(i == 0, F.lit(0)).otherwise(F.get(stops, i - 1) + 1))))


def with_removed(docs: DataFrame, lines: DataFrame, min_chars: int = MIN_CHARS) -> tuple[DataFrame, str]:
    """``docs`` plus a column with the sorted positions of its lines to remove (null: none); its name."""
    gone, row_key, owner, key = fresh(docs.columns, "_gone", "_row_key", "_owner", "_hash")
    hits = (occurrences(docs, min_chars).join(_salted(lines), ["key", "salt"])
            .filter(F.col("first_id").isNotNull() & ~F.col("doc_id").eqNullSafe(F.col("first_id")))
            .groupBy(F.col("row_key").alias(row_key), F.col("doc_id").alias(owner))
            .agg(F.sort_array(F.collect_set("pos")).alias(gone)))
    keyed = docs.withColumn(key, F.xxhash64("doc_id", "text"))
    joined = keyed.join(hits, (keyed[key] == hits[row_key]) & keyed["doc_id"].eqNullSafe(hits[owner]), "left")
    return joined.drop(key, row_key, owner), gone


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with boilerplate lines taken out of ``text``; columns as they were."""
    marked, gone = with_removed(docs, boilerplate(docs, min_sites, min_chars), min_chars)
    text = F.when(F.col(gone).isNull(), F.col("text")).otherwise(
        F.array_join(_without(_lines(F.col("text")), F.col(gone)), "\n"))
    out = marked.withColumn("text", text)
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        out = out.withColumn("n_chars", F.when(F.col(gone).isNull(), F.col("n_chars"))
                             .otherwise(F.length("text").cast(kind)))
    return out.select(*docs.columns)


def line_report(docs: DataFrame, min_sites: int = MIN_SITES, min_chars: int = MIN_CHARS) -> DataFrame:
    """Per document: its lines, how many were removed, and the remaining text (null text: empty)."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), "source")
    marked, gone = with_removed(docs, boilerplate(docs, min_sites, min_chars), min_chars)
    lines = _lines(F.col("text"))
    return marked.select(
        "doc_id", F.size(lines).cast("long").alias("n_lines"),
        F.coalesce(F.size(gone), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col(gone).isNull(), F.col("text"))
        .otherwise(F.array_join(_without(lines, F.col(gone)), "\n")).alias("text"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_boilerplate(docs)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_report(table(spark, sf_dir, "documents"))


SQL = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text, source FROM documents),
     cells AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                      generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM docs),
     shared AS (SELECT trim(line, ' ') AS line, min(doc_id) AS first_id FROM cells
                WHERE length(trim(line, ' ')) >= {MIN_CHARS}
                GROUP BY trim(line, ' ') HAVING count(DISTINCT source) >= {MIN_SITES}),
     marked AS (SELECT c.doc_id, c.line, c.pos,
                       (s.first_id IS NOT NULL AND s.first_id <> c.doc_id) AS gone
                FROM cells c LEFT JOIN shared s ON trim(c.line, ' ') = s.line)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed,
       coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '') AS text
FROM marked GROUP BY doc_id
"""
