"""Streaming job-status validation with per-job state.

Status requests arrive as a stream; each job keeps its current status in
Spark's state store and every request is checked against it as it arrives,
the way the reference checks each update against the stored row:

* no job yet: only ``queued`` creates it, anything else is "not found";
* otherwise the request must be an allowed transition from the current status.

Within a micro-batch a job's requests are applied in (event time, sequence)
order; across batches, in arrival order. The batch form
(``docyard.sinks.jobs.validate_transitions``) gives the same answer when the
whole log is one batch.

A job's requests come Arrow batch by Arrow batch. One batch is sorted and applied as it is. Where there are more (a job on a third
of the log), every batch is sorted and put aside in the state store in pieces; then the sorted runs are merged,
one piece of each in memory at a time, and the pieces are removed as they are used up. The state needs the RocksDB store: start the stream
within ``state_store(spark)``.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docyard.session import cut_lineage, drop_path, scratch_path
from docyard.sinks.jobs import INVALID, NOT_FOUND, VALID_TRANSITIONS

OUTPUT_SCHEMA = "job_id string, seq long, status string, valid boolean, rejection string, state_after string"
#: Requests of one piece of a run that is put aside.
PIECE = 2_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ALLOWED = {}
for a, b in VALID_TRANSITIONS:
    _ALLOWED.setdefault(a, set()).add(b)


class JobState(StatefulProcessor):
    """The current status of one job, and the sorted runs of a large micro-batch while they are merged."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.current = handle.getValueState("current", "status string")
        self.aside = handle.getMapState("aside", "run int, piece int", "at array<long>, seq array<long>, status array<string>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        runs = (self._sorted(pdf) for pdf in rows if len(pdf))
        first, second = next(runs, None), next(runs, None)
        if first is None:
            return
        if second is None:
            yield from self._apply(key[0], self._requests(first))
            return
        lengths = [self._put_aside(0, first), self._put_aside(1, second)]
        for n, run in enumerate(runs, 2):
            lengths.append(self._put_aside(n, run))
        yield from self._apply(key[0], heapq.merge(*[self._read(n, pieces) for n, pieces in enumerate(lengths)]))

    @staticmethod
    def _sorted(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["at", "seq"], kind="stable")

    @staticmethod
    def _requests(run: pd.DataFrame) -> Iterator[tuple[int, int, str]]:
        return zip(run["at"].tolist(), run["seq"].tolist(), run["status"].tolist())

    def _put_aside(self, run: int, pdf: pd.DataFrame) -> int:
        """Store a sorted run in pieces; how many."""
        pieces = range(0, len(pdf), PIECE)
        for n, a in enumerate(pieces):
            part = pdf.iloc[a:a + PIECE]
            self.aside.updateValue((run, n), (part["at"].tolist(), part["seq"].tolist(), part["status"].tolist()))
        return len(pieces)

    def _read(self, run: int, pieces: int) -> Iterator[tuple[int, int, str]]:
        for n in range(pieces):
            part = self.aside.getValue((run, n))
            self.aside.removeKey((run, n))
            yield from zip(*part)

    def _apply(self, job: str, requests) -> Iterator[pd.DataFrame]:
        held = self.current.get()
        start = current = held[0] if held else None
        out: list[tuple] = []
        for _, seq, status in requests:
            if current is None:
                why = None if status == "queued" else f"{NOT_FOUND}{job}"
            else:
                why = None if status in _ALLOWED.get(current, ()) else f"{INVALID}{current} -> {status}"
            current = status if why is None else current
            out.append((job, seq, status, why is None, why, current))
            if len(out) == PIECE:
                yield self._frame(out)
                out = []
        if current != start:
            self.current.update((current,))
        if out:
            yield self._frame(out)

    @staticmethod
    def _frame(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=["job_id", "seq", "status", "valid", "rejection", "state_after"])

    def close(self) -> None:
        pass


@contextmanager
def state_store(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)


def validate_stream(events: DataFrame) -> DataFrame:
    """Streaming events (job_id, status, event_at, seq) -> validated rows; rows without a job id belong to no job and are left out."""
    at = F.unix_micros(F.col("event_at").cast("timestamp"))
    return (events.filter(F.col("job_id").isNotNull()).select("job_id", "status", at.alias("at"), F.col("seq").cast("long").alias("seq"))
                  .groupBy("job_id")
                  .transformWithStateInPandas(JobState(), OUTPUT_SCHEMA, "append", "None"))


def validated_log(events: DataFrame) -> DataFrame:
    """Run a stream of events to its present end; the validated rows of all its micro-batches."""
    spark = events.sparkSession
    out, progress = scratch_path(spark, "job-stream"), scratch_path(spark, "job-stream-state")
    try:
        with state_store(spark):
            query = (validate_stream(events).writeStream.format("parquet").option("path", out)
                     .option("checkpointLocation", progress).trigger(availableNow=True).start())
        query.awaitTermination()
        return cut_lineage(spark.read.schema(OUTPUT_SCHEMA).parquet(out))
    finally:
        drop_path(spark, out)
        drop_path(spark, progress)
