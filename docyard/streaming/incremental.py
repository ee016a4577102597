"""Incremental ingest with Structured Streaming.

New files in a source folder are picked up by the file source (explicit
schema, ``maxFilesPerTrigger``), and each micro-batch runs the batch ingest
flow inside ``foreachBatch``. Sequences are the time of the write, as in batch runs, so a stream and
batch runs may take turns on one table and a stream may start over with a new checkpoint folder.
A batch replayed after a failure finds the chunks it already stored by their content
hash and skips them: the vector table itself is the state, no watermark is needed for late files.
A run is named by the checkpoint folder and the batch: a replay has the ids of its first try, a stream begun
again with another folder has ids of its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from docyard.config import IngestConfig


def run_name(checkpoint_path: str, batch_id: int) -> str:
    return f"{hashlib.sha256(checkpoint_path.rstrip('/').encode()).hexdigest()[:16]}-batch-{batch_id}"


def ingest_stream(stream: DataFrame, points_path: str, checkpoint_path: str, to_documents: Callable[[DataFrame], DataFrame],
                  cfg: IngestConfig = IngestConfig(), model=None, jobs_path: str | None = None,
                  available_now: bool = True) -> StreamingQuery:
    """Start ingesting a stream of raw rows; ``to_documents`` shapes them into the document schema."""
    from docyard.plans.ingest import ingest

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        ingest(to_documents(batch), points_path, cfg, model, jobs_path=jobs_path, run_id=run_name(checkpoint_path, batch_id))

    writer = stream.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint_path)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()


def incremental_ingest(spark: SparkSession, source_dir: str, schema, points_path: str, checkpoint_path: str,
                       to_documents: Callable[[DataFrame], DataFrame], cfg: IngestConfig = IngestConfig(),
                       model=None, jobs_path: str | None = None, max_files_per_trigger: int = 100,
                       available_now: bool = True, file_format: str = "parquet") -> StreamingQuery:
    """``ingest_stream`` over the files of a folder."""
    stream = (spark.readStream.format(file_format).schema(schema)
                   .option("maxFilesPerTrigger", max_files_per_trigger).load(source_dir))
    return ingest_stream(stream, points_path, checkpoint_path, to_documents, cfg, model, jobs_path, available_now)
