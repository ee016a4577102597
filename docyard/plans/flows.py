"""Registered queries of whole flows: ingest run twice, ingest as a stream, an own model, own cleaning steps, files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from docyard.config import IngestConfig
from docyard.operators import chunking as K
from docyard.operators.clean import clean_text, python_step
from docyard.operators.embed import RetryPolicy, embed
from docyard.plans import sqltext as S
from docyard.plans.catalog import (FIXED_SQL, INGEST_SQL, OVERLAP_PCT, SIZE, STEP, _language_model, normalize_types, register)
from docyard.session import cut_lineage, drop_path, scratch_path
from docyard.sources.tables import as_documents, corpus_documents, read_table, stream_table, with_file_rows

COUNTS = ("document_count", "cleaned_document_count", "total_chunk_count", "chunk_count", "skipped_count")


# ---------------------------------------------------------------- the whole flow, twice
@register("ingest_twice", INGEST_SQL.split("idx AS (")[0] + """
r AS (SELECT *, row_number() OVER (PARTITION BY nullif(tenant_id, ''), chunk_hash ORDER BY source_path, chunk_index) AS rn FROM h),
dc AS (SELECT source AS tenant_id, count(*) AS document_count FROM documents GROUP BY 1),
ec AS (SELECT tenant_id, count(*) AS cleaned_document_count FROM en GROUP BY 1),
hc AS (SELECT tenant_id, count(*) AS total_chunk_count, count(*) FILTER (WHERE rn = 1) AS first FROM r GROUP BY 1)
SELECT run, dc.tenant_id, document_count, coalesce(cleaned_document_count, 0) AS cleaned_document_count,
       coalesce(total_chunk_count, 0) AS total_chunk_count,
       CAST(CASE WHEN run = 1 THEN coalesce(first, 0) ELSE 0 END AS BIGINT) AS chunk_count,
       CAST(coalesce(total_chunk_count, 0) - CASE WHEN run = 1 THEN coalesce(first, 0) ELSE 0 END AS BIGINT) AS skipped_count
FROM dc LEFT JOIN ec USING (tenant_id) LEFT JOIN hc USING (tenant_id), (SELECT unnest([1, 2])::BIGINT AS run)
""")
def q_ingest_twice(spark, sf):
    """Load, clean, chunk, dedup, embed and upsert the whole corpus, and all of it again: the second run skips every chunk."""
    from docyard.plans.ingest import ingest
    model = _language_model(spark, sf)
    points = scratch_path(spark, "ingest-twice")
    try:
        runs = [ingest(corpus_documents(spark, sf), points, IngestConfig(), model).counters.withColumn("run", F.lit(n))
                for n in (1, 2)]
    finally:
        drop_path(spark, points)
        model.drop()
    both = runs[0].unionByName(runs[1])
    return normalize_types(both.groupBy("run", "tenant_id").agg(*[F.sum(c).alias(c) for c in COUNTS]))


# ---------------------------------------------------------------- the flow as a stream
@register("ingest_stream", f"""
WITH d AS (SELECT doc_id, source AS tenant_id, {S.clean('text')} AS content FROM documents),
t AS (SELECT doc_id, tenant_id, {S.tokens('content')} AS toks FROM d WHERE length(content) >= 100),
c AS (SELECT *, len(toks) AS n FROM t WHERE len(toks) > 0),
k AS (SELECT tenant_id, toks, unnest(range(0, {S.chunk_count('n', SIZE, STEP)})) AS chunk_index FROM c),
h AS (SELECT tenant_id, sha256(array_to_string(toks[chunk_index*{STEP}+1:chunk_index*{STEP}+{SIZE}], '')) AS chunk_hash FROM k)
SELECT tenant_id, count(DISTINCT chunk_hash) AS points, 0::BIGINT AS written_again FROM h GROUP BY tenant_id
""")
def q_ingest_stream(spark, sf):
    """The documents as a stream of files into the vector table: points per tenant, and what a second stream over them adds."""
    from docyard.sinks.points import points_per_tenant, read_points
    from docyard.streaming.incremental import ingest_stream
    points = scratch_path(spark, "ingest-stream")
    progress = [scratch_path(spark, "ingest-stream-progress") for _ in range(2)]
    found = []
    try:
        for folder in progress:
            query = ingest_stream(stream_table(spark, sf, "documents"), points, folder, as_documents,
                                  IngestConfig(target_language=None))
            query.awaitTermination()
            found.append(cut_lineage(read_points(spark, points).select("tenant_id", "point_id", "ingest_seq")))
    finally:
        for folder in (points, *progress):
            drop_path(spark, folder)
    again = found[1].groupBy("tenant_id").agg(F.max("ingest_seq").alias("late")).join(
        found[0].groupBy("tenant_id").agg(F.max("ingest_seq").alias("early")), "tenant_id", "left")
    more = points_per_tenant(found[1]).withColumnRenamed("points", "after")
    return (points_per_tenant(found[0]).join(more, "tenant_id").join(again, "tenant_id")
            .select("tenant_id", "points", (F.col("after") - F.col("points") + F.when(F.col("late") > F.col("early"), 1).otherwise(0))
                    .cast("long").alias("written_again")))


# ---------------------------------------------------------------- an own model
#: What the example model counts.
LETTERS = "aeiou"


def letter_model():
    """A deterministic model that fails once per worker, as a remote one may: length, words, and five letters of a text."""
    calls = []

    def predict(texts: np.ndarray) -> np.ndarray:
        calls.append(len(texts))
        if len(calls) == 1:
            raise ConnectionError("not ready yet")
        return np.array([[len(t), t.count(" "), *(t.count(c) for c in LETTERS)] for t in texts], dtype=np.float32)

    return predict


@register("embed_model", FIXED_SQL + f"""
SELECT doc_id, CAST(chunk_index AS BIGINT) AS chunk_index, CAST({2 + len(LETTERS)} AS BIGINT) AS dim,
       length(text) || ',' || (length(text) - length(replace(text, ' ', '')))
       {' '.join(f"|| ',' || (length(text) - length(replace(text, '{c}', '')))" for c in LETTERS)} AS vector
FROM w
""")
def q_embed_model(spark, sf):
    """Every fixed chunk through an own model: Arrow batches of 256, checked, retried, built once per worker."""
    c = K.chunk_fixed(corpus_documents(spark, sf), SIZE, OVERLAP_PCT, offsets=False).select("doc_id", "chunk_index", "text")
    v = embed(c, "text", "embedding", letter_model, 2 + len(LETTERS), 256, retry=RetryPolicy(min_wait=0.01))
    return normalize_types(v.select(
        "doc_id", "chunk_index", F.size("embedding").alias("dim"),
        F.array_join(F.transform("embedding", lambda x: x.cast("long").cast("string")), ",").alias("vector")))


# ---------------------------------------------------------------- an own cleaning step
def spelled(text: str) -> str:
    """An example of a rule in Python: ampersands spelled out, vowels after q marked."""
    return text.replace("&", " and ").replace("qu", "kw")


@register("clean_python_step", f"""
SELECT doc_id, replace(replace({S.normalize_whitespace('text')}, '&', ' and '), 'qu', 'kw') AS content FROM documents
""")
def q_clean_python_step(spark, sf):
    """A built-in step, then a Python one."""
    from docyard.functions.text import normalize_whitespace
    d = read_table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return clean_text(d, "content", [normalize_whitespace, python_step(spelled)])


# ---------------------------------------------------------------- an own chunker
LINES, LINE_STEP = 4, 3


@register("chunk_line_windows", f"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE length(text) > 0),
k AS (SELECT doc_id, ls, unnest(range(0, CAST(greatest(ceil((len(ls) - {LINES}) / {float(LINE_STEP)}), 0) AS BIGINT) + 1)) AS chunk_index FROM l),
w AS (SELECT doc_id, chunk_index, array_to_string(ls[chunk_index*{LINE_STEP}+1:chunk_index*{LINE_STEP}+{LINES}], chr(10)) AS text,
             length(array_to_string(ls[1:chunk_index*{LINE_STEP}], chr(10))) + CASE WHEN chunk_index > 0 THEN 1 ELSE 0 END AS start_char FROM k)
SELECT doc_id, chunk_index, CAST(start_char AS BIGINT) AS start_char, CAST(start_char + length(text) AS BIGINT) AS end_char,
       sha256(text) AS chunk_hash FROM w
""")
def q_chunk_line_windows(spark, sf):
    """Windows of lines by a Python table function, joined laterally to the documents."""
    d = corpus_documents(spark, sf)
    c = K.chunk_by_table_function(d, K.LineWindows, F.lit(LINES), F.lit(LINE_STEP))
    return normalize_types(c.select("doc_id", "chunk_index", "start_char", "end_char", F.sha2("text", 256).alias("chunk_hash")))


# ---------------------------------------------------------------- files
@register("source_files", """
SELECT 'documents.parquet' AS file_name, count(*) AS n_rows, count(*) AS distinct_rows, count(*) - 1 AS last_row FROM documents
""")
def q_source_files(spark, sf):
    """Rows per file of the corpus and their places, from the reader's own columns."""
    d = with_file_rows(read_table(spark, sf, "documents"))
    return d.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("file_row").alias("distinct_rows"),
                                      F.max("file_row").alias("last_row"))


# ---------------------------------------------------------------- ids and metadata of documents
@register("document_ids", f"""
WITH d AS (SELECT doc_id, 'team-' || source AS tenant_id, printf('%s/%08d.txt', source, doc_id) AS source_path FROM documents),
j AS (SELECT *, {S.sha1_name('''('{"t":"' || tenant_id || '","p":"' || source_path || '","r":"run-1"}')''')} AS s1 FROM d)
SELECT doc_id AS given_id, tenant_id, sha256('{{"t":"' || tenant_id || '","p":"' || source_path || '","n":0}}') AS doc_id,
       {S.uuid5_from_sha1('s1')} AS job_id, 'queued' AS status, 'kind=note,origin=second' AS extra FROM j
""")
def q_document_ids(spark, sf):
    """Every document under a new tenant: its deterministic id, its queued job, and metadata merged twice (the later wins)."""
    from docyard.sinks.jobs import create_jobs
    from docyard.sources.loaders import attach_tenant, with_extra
    d = attach_tenant(corpus_documents(spark, sf).withColumnRenamed("doc_id", "given_id"), F.concat(F.lit("team-"), "tenant_id"))
    d = with_extra(with_extra(d, {"origin": "first", "kind": "note"}), {"origin": "second"})
    d = d.withColumn("doc_id", K.document_id("tenant_id", "source_path", None))
    jobs = create_jobs(d.select("doc_id", "source_path", "tenant_id"), "run-1").select(F.col("doc_id").alias("of"), "job_id", "status")
    shown = F.array_join(F.transform(F.array_sort(F.map_entries("extra")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return d.join(jobs, d["doc_id"] == jobs["of"]).select("given_id", "tenant_id", "doc_id", "job_id", "status", shown.alias("extra"))
