"""The ingest flow over a whole corpus at once.

documents -> clean (text steps, length, language) -> chunk -> hash + id ->
first-in-batch -> not in the index -> embed -> upsert, with per-source
counters and job events. Within a tenant, sequential file-by-file dedup is
the same as one in-batch minimum of the order (source_path, page, chunk) after
one check against the starting index, so the whole corpus is one plan.

The chunk table is written once into the shared scratch folder; the dedup decision is made on its
narrow key columns, and the chosen chunks are read from it for embedding. The folder goes when the run ends.
Input rows that failed to load (``error_message`` set) end as ``failed`` jobs with their message while the
others go on; ``queued`` and ``running`` are written before the work.
"""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from docyard.config import IngestConfig
from docyard.operators import chunking as K
from docyard.operators import dedup as D
from docyard.operators.clean import clean_documents
from docyard.operators.embed import RetryPolicy, embed
from docyard.session import cut_lineage, drop_path, scratch_path
from docyard.sources.loaders import with_extra

SOURCE = ("tenant_id", "source_path")
#: Of a broken run's message, what a job event keeps.
MESSAGE_CHARS = 8_000


@dataclass
class IngestPlan:
    documents: DataFrame
    chunks: DataFrame
    new_keys: DataFrame


@dataclass
class IngestResult:
    run_id: str
    written: int
    counters: DataFrame
    job_events: DataFrame | None
    stage_seconds: dict          # wall time per stage of this run (chunk table, dedup, embed + write)


def prepared(docs: DataFrame, cfg: IngestConfig) -> DataFrame:
    """Documents with an id and the run's extra metadata."""
    if "doc_id" not in docs.columns:
        page = "page_number" if "page_number" in docs.columns else None
        docs = docs.withColumn("doc_id", K.document_id("tenant_id", "source_path", page))
    return with_extra(docs, cfg.extra)


def chunk_table(docs: DataFrame, cfg: IngestConfig = IngestConfig(), model=None, offsets: bool = True) -> DataFrame:
    """Lazy plan of the chunks, with hash and point id, of the documents that loaded."""
    good = docs.filter(F.col("error_message").isNull()).drop("error_message") if "error_message" in docs.columns else docs
    cleaned = clean_documents(good, cfg, model)
    return D.with_identity(K.chunk(cleaned, cfg.chunker_strategy, cfg.chunk_size_tokens, cfg.chunk_overlap_pct,
                                   tokenizer=cfg.tokenizer, chunker=cfg.chunker, offsets=offsets))


def counters(plan: IngestPlan, by=SOURCE) -> DataFrame:
    """Per source: documents, cleaned documents, chunks, new chunks, skipped chunks.

    Left-joined from the document list, so sources that yield no text or no
    new chunks still appear with zeros. A cleaned document is one with a chunk. Only ids and keys are read.
    """
    out = plan.documents.groupBy(*by).agg(F.count(F.lit(1)).alias("document_count"))
    chunks = plan.chunks.groupBy(*by).agg(F.countDistinct("doc_id").alias("cleaned_document_count"),
                                          F.count(F.lit(1)).alias("total_chunk_count"))
    # a key's first chunk names its source; the key's tenant is missing where the tenant is empty
    in_key = {"tenant_id": F.col("_t"), "source_path": F.col("_o.source_path")}
    new = plan.new_keys.select(*[in_key[c].alias(c) for c in by]).groupBy(*by).agg(F.count(F.lit(1)).alias("chunk_count"))
    out = _left(_left(out, chunks, by), new, by, F.nullif(out["tenant_id"], F.lit("")))
    out = out.fillna(0, ["cleaned_document_count", "total_chunk_count", "chunk_count"])
    return out.withColumn("skipped_count", F.col("total_chunk_count") - F.col("chunk_count"))


def _left(out: DataFrame, part: DataFrame, by, tenant=None) -> DataFrame:
    """Left join on ``by``, missing values equal; ``tenant`` stands for the left side's tenant."""
    right = part.select(*[F.col(c).alias(f"_r_{c}") for c in by], *[c for c in part.columns if c not in by])
    same = F.lit(True)
    for c in by:
        left = tenant if tenant is not None and c == "tenant_id" else out[c]
        same = same & left.eqNullSafe(right[f"_r_{c}"])
    return out.join(right, same, "left").drop(*[f"_r_{c}" for c in by])


def _no_counts(spark) -> DataFrame:
    return spark.createDataFrame([], "tenant_id string, source_path string, chunk_count long, skipped_count long")


def ingest(docs: DataFrame, points_path: str, cfg: IngestConfig = IngestConfig(), model=None,
           jobs_path: str | None = None, run_id: str | None = None, ingest_seq: int | None = None,
           model_factory=None) -> IngestResult:
    """Run the whole flow and write points (and job events when ``jobs_path`` is given)."""
    from docyard.sinks import jobs as J
    from docyard.sinks import points as P

    spark = docs.sparkSession
    run_id = run_id or uuid.uuid4().hex
    docs = prepared(docs, cfg)
    kept = None
    if "error_message" in docs.columns:  # rows of loaders: parsed once, not again by every reader
        kept = scratch_path(spark, f"documents-{run_id}")
        docs.write.parquet(kept)
        docs = spark.read.schema(docs.schema).parquet(kept)
    P.ensure_table(spark, points_path, cfg.vector_size, key=cfg.upsert_key)   # create before reading it
    index = P.index_keys(spark, points_path)
    t0 = time.perf_counter()
    why = F.max("error_message") if "error_message" in docs.columns else F.lit(None).cast("string")
    # one narrow row per source file: what the job events and the counters start from
    sources = cut_lineage(docs.groupBy(*SOURCE).agg(F.min("doc_id").cast("string").alias("doc_id"), why.alias("error_message")))
    if jobs_path:
        started = J.create_jobs(sources, run_id)
        running = started.withColumn("status", F.lit("running")).withColumn("seq", F.lit(1).cast("long"))
        started.unionByName(running).write.mode("append").parquet(jobs_path)
    folder = scratch_path(spark, f"chunks-{run_id}")
    try:
        cut = Observation()
        chunk_table(docs, cfg, model).observe(cut, F.count(F.lit(1)).alias("rows")).write.parquet(folder)
        chunks = spark.read.parquet(folder)
        t1 = time.perf_counter()
        keys = cut_lineage(D.new_keys(D.first_keys(chunks), index))
        t2 = time.perf_counter()
        retry = RetryPolicy() if cfg.embed_retry == "default" else cfg.embed_retry
        vectors = embed(D._pick(chunks, keys, D.ORDER, "tenant_id"), "text", "embedding", model_factory=model_factory,
                        vector_size=cfg.vector_size, batch_size=cfg.embed_batch_size,
                        max_concurrency=cfg.embed_max_concurrency, retry=retry)
        seq = ingest_seq if ingest_seq is not None else int(time.time() * 1_000_000)
        written = P.upsert(P.build_points(vectors), points_path, seq)
        t3 = time.perf_counter()
        stats = cut_lineage(counters(IngestPlan(docs.select("doc_id", *SOURCE), chunks, keys)))
    except Exception as problem:
        if jobs_path:  # the run as a whole broke off: every file says so
            broken = sources.withColumn("error_message", F.coalesce("error_message", F.lit(str(problem)[:MESSAGE_CHARS])))
            J.finish_jobs(broken, _no_counts(spark), run_id, time.perf_counter() - t0).write.mode("append").parquet(jobs_path)
        raise
    finally:
        drop_path(spark, folder)
        if kept:
            drop_path(spark, kept)
    stages = {"chunks": t1 - t0, "dedup": t2 - t1, "embed_write": t3 - t2}
    events = None
    if jobs_path:
        ended = J.finish_jobs(sources, stats, run_id, t3 - t0, {k: int(1000 * s) for k, s in stages.items()},
                              {"chunks": int(cut.get.get("rows") or 0), "written": written})
        ended.write.mode("append").parquet(jobs_path)
        events = spark.read.parquet(jobs_path).filter(
            F.col("job_id") == J.job_id_for("tenant_id", "source_path", F.lit(run_id)))
    return IngestResult(run_id, written, stats, events, stages)
