"""Ingestion job audit trail as an append-only event table.

Each status request is an event row (job_id, status, fields, event time,
sequence). The reference keeps one mutable row per job and validates each
update against it; here the whole log is validated at once.

Every event is a map from state to state: where it is an allowed transition it moves the state, elsewhere it leaves it. A
job's events are cut into blocks of time. Within a block, for each state the block may begin in, the first events that
move it are grouped minima (the states have no cycle, so there are at most three moves); together they are the
block's own map. A second, narrow pass over the blocks finds the state each block begins in, and with it every event knows the state
before it. A job that holds a third of the log is many blocks, so it never lands in one task; the log is shuffled once.

The current-state view takes every field from the last valid event (a
later update overwrites counts and errors with NULL unless it gives them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docyard.functions.hashing import uuid5

# Job states and the allowed transitions between them.
JOB_STATES = ("queued", "running", "done", "failed")
VALID_TRANSITIONS = (("queued", "running"), ("running", "done"), ("running", "failed"))
NOT_FOUND = "ingestion job not found: "
INVALID = "invalid job status transition: "

EVENT_COLUMNS = ("job_id", "doc_id", "source_path", "tenant_id", "status", "error_message",
                 "chunk_count", "skipped_count", "duration_seconds", "stage_ms", "stage_rows", "event_at", "seq")
STAGES = "map<string,bigint>"


def job_id_for(tenant: Column | str, source_path: Column | str, run_id: Column | str) -> Column:
    """Deterministic job id of one source file in one run."""
    def c(x):
        return F.col(x) if isinstance(x, str) else x
    return uuid5(F.to_json(F.struct(F.coalesce(c(tenant), F.lit("")).alias("t"), c(source_path).alias("p"),
                                    c(run_id).alias("r"))))


def create_jobs(sources: DataFrame, run_id: str, event_at: Column | None = None) -> DataFrame:
    """One ``queued`` event per source file (columns doc_id, source_path, tenant_id)."""
    return sources.select(
        job_id_for("tenant_id", "source_path", F.lit(run_id)).alias("job_id"),
        "doc_id", "source_path", "tenant_id", F.lit("queued").alias("status"),
        F.lit(None).cast("string").alias("error_message"), F.lit(None).cast("int").alias("chunk_count"),
        F.lit(None).cast("int").alias("skipped_count"), F.lit(None).cast("double").alias("duration_seconds"),
        F.lit(None).cast(STAGES).alias("stage_ms"), F.lit(None).cast(STAGES).alias("stage_rows"),
        (event_at if event_at is not None else F.current_timestamp()).alias("event_at"),
        F.lit(0).cast("long").alias("seq"))


def _stages(values: dict[str, int] | None) -> Column:
    items = [x for k, v in (values or {}).items() for x in (F.lit(k), F.lit(v).cast("long"))]
    return (F.create_map(*items) if items else F.lit(None)).cast(STAGES)


def finish_jobs(sources: DataFrame, stats: DataFrame, run_id: str, seconds: float, stage_ms: dict[str, int] | None = None,
                stage_rows: dict[str, int] | None = None) -> DataFrame:
    """The last event of every source file: ``failed`` with its message, or ``done`` with its counts.

    ``stage_ms`` and ``stage_rows`` are the run's time and rows per stage.
    """
    counts = stats.select(F.col("tenant_id").alias("_t"), F.col("source_path").alias("_p"), "chunk_count", "skipped_count")
    both = sources.join(counts, sources["tenant_id"].eqNullSafe(counts["_t"]) & (sources["source_path"] == counts["_p"]), "left")
    failed = F.col("error_message").isNotNull()
    done = lambda value, kind: F.when(~failed, value).cast(kind)
    return both.select(
        job_id_for("tenant_id", "source_path", F.lit(run_id)).alias("job_id"),
        "doc_id", "source_path", "tenant_id", F.when(failed, F.lit("failed")).otherwise(F.lit("done")).alias("status"),
        "error_message", done(F.col("chunk_count"), "int").alias("chunk_count"),
        done(F.col("skipped_count"), "int").alias("skipped_count"), F.lit(seconds).cast("double").alias("duration_seconds"),
        _stages(stage_ms).alias("stage_ms"), _stages(stage_rows).alias("stage_rows"),
        F.current_timestamp().alias("event_at"), F.lit(2).cast("long").alias("seq"))


#: Place of each state in a map; the first is "no job yet".
_STATES = (None, *JOB_STATES)
#: Blocks of a job's events (a unit of ``date_trunc``).
BLOCK = "hour"


def _moves() -> dict[str, list[int]]:
    """Per requested status: the state (as its place) after it, for each state before it."""
    allowed = {(None, JOB_STATES[0]), *VALID_TRANSITIONS}
    return {to: [_STATES.index(to) if (at, to) in allowed else n for n, at in enumerate(_STATES)] for to in JOB_STATES}


def _depth(state: int) -> int:
    """How often a job in this state can still move."""
    return max((1 + _depth(m[state]) for m in _moves().values() if m[state] != state), default=0)


def _first_moves(rows: DataFrame, group, place: str, map_col: str, out: dict[int, str]) -> DataFrame:
    """Add, per state that a group may begin in, its moves (place, state after) in order; null where there are fewer.

    ``out`` names the column of each state. The n-th moves of all states are one window.
    """
    for n in range(max(map(_depth, out))):
        found = {}
        for start, name in out.items():
            if n >= _depth(start):
                continue
            state, after = F.lit(start), F.lit(True)
            if n:
                last = F.col(f"{name}_{n - 1}")
                state, after = last["to"], F.col(place) > last["at"]
            to = F.get(F.col(map_col), state)
            move = F.when(after & (to != state), F.struct(F.col(place).alias("at"), to.alias("to")))
            found[f"{name}_{n}"] = F.min(move).over(group)
        rows = rows.withColumns(found)
    steps = {name: [f"{name}_{n}" for n in range(_depth(start))] for start, name in out.items()}
    return rows.withColumns({name: F.array(*own) for name, own in steps.items()}).drop(*sum(steps.values(), []))


def _state_after(moves: Column, start: Column, before: Column | None = None) -> Column:
    """The state the moves lead to (those strictly before a place, when given)."""
    done = F.filter(moves, lambda m: m.isNotNull() if before is None else m["at"] < before)
    return F.coalesce(F.get(done, F.size(done) - 1)["to"], start)


def validate_transitions(events: DataFrame, order_cols=("event_at", "seq"), block: str = BLOCK) -> DataFrame:
    """Add ``valid``, ``rejection`` (why an event was rejected), ``created_at`` and ``indexed_at``.

    ``block`` is the unit of time that cuts a job's events; the result does not depend on it. Rows of no job are rejected.
    """
    moving = [s for s in range(len(_STATES)) if _depth(s)]
    kept = F.array(*[F.lit(s) for s in range(len(_STATES))])
    own_map = kept
    for status, to in _moves().items():
        own_map = F.when((F.col("status") == status) & F.col("job_id").isNotNull(), F.array(*map(F.lit, to))).otherwise(own_map)
    ev = events.withColumns({"_ord": F.struct(*[F.col(c) for c in order_cols]), "_map": own_map,
                             "_block": F.struct(F.date_trunc(block, order_cols[0]))})  # a struct: no time sorts first
    within = Window.partitionBy("job_id", "_block")
    ev = _first_moves(ev, within, "_ord", "_map", {s: f"_moves_{s}" for s in moving})

    # one narrow row per block: its moves from every state, and its map
    names = [f"_moves_{s}" for s in moving]
    blocks = ev.select("job_id", "_block", *names).groupBy("job_id", "_block").agg(*[F.first(n).alias(n) for n in names])
    after = [_state_after(F.col(f"_moves_{s}"), F.lit(s)) if s in moving else F.lit(s) for s in range(len(_STATES))]
    blocks = _first_moves(blocks.withColumn("_map", F.array(*after)), Window.partitionBy("job_id"), "_block", "_map", {0: "_steps"})
    blocks = blocks.withColumn("_start", _state_after(F.col("_steps"), F.lit(0), F.col("_block")))
    moves = F.array().cast(blocks.schema["_moves_0"].dataType)
    for s in moving:
        moves = F.when(F.col("_start") == s, F.col(f"_moves_{s}")).otherwise(moves)
    blocks = blocks.withColumn("_moves", F.filter(moves, lambda m: m.isNotNull()))
    moment = lambda state: F.max(F.get(F.filter("_moves", lambda m: m["to"] == _STATES.index(state)), 0)
                                 ["at"][order_cols[0]]).over(Window.partitionBy("job_id"))
    blocks = blocks.withColumns({"created_at": moment("queued"), "indexed_at": moment("done")}).select(
        F.col("job_id").alias("_job"), F.col("_block").alias("_b"), "_start", "_moves", "created_at", "indexed_at")

    ev = ev.drop(*names, "created_at", "indexed_at").join(
        blocks, ev["job_id"].eqNullSafe(blocks["_job"]) & ev["_block"].eqNullSafe(blocks["_b"]), "left")
    before = _state_after(F.col("_moves"), F.col("_start"), F.col("_ord"))
    named = F.get(F.array(*map(F.lit, _STATES)), before)
    valid = F.exists("_moves", lambda m: m["at"] == F.col("_ord"))
    why = (F.when(valid, F.lit(None).cast("string"))
            .when(before == 0, F.concat(F.lit(NOT_FOUND), F.col("job_id").cast("string")))
            .otherwise(F.concat(F.lit(INVALID), named, F.lit(" -> "), F.col("status"))))
    return (ev.withColumns({"valid": valid, "rejection": why})
              .drop("_ord", "_map", "_block", "_job", "_b", "_start", "_moves"))


def current_jobs(validated: DataFrame, order_cols=("event_at", "seq"),
                 fields=("status", "error_message", "chunk_count", "skipped_count", "duration_seconds",
                         "created_at", "indexed_at")) -> DataFrame:
    """One row per existing job: every field from its last valid event."""
    created = validated.filter(F.col("valid"))
    last = F.max_by(F.struct(*[F.col(f) for f in fields]), F.struct(*[F.col(c) for c in order_cols]))
    extra = [c for c in ("doc_id", "source_path", "tenant_id") if c in validated.columns]
    firsts = [F.min_by(F.col(c), F.struct(*[F.col(o) for o in order_cols])).alias(c) for c in extra]
    out = created.groupBy("job_id").agg(last.alias("_l"), *firsts)
    return out.select("job_id", *extra, *[F.col(f"_l.{f}").alias(f) for f in fields])


def get_job(events: DataFrame, job_ids: DataFrame, order_cols=("event_at", "seq")) -> DataFrame:
    """Point lookups in the log for a set of ids (0 or 1 row per id): only the events of these jobs are validated."""
    return current_jobs(validate_transitions(events.join(job_ids.select("job_id"), "job_id", "left_semi"), order_cols), order_cols)


def tenant_jobs(events: DataFrame, tenant_id: str, order_cols=("event_at", "seq")) -> DataFrame:
    """The current jobs of one tenant: only jobs with an event of the tenant are validated."""
    own = events.filter(F.col("tenant_id") == tenant_id).select("job_id")
    return (current_jobs(validate_transitions(events.join(own, "job_id", "left_semi"), order_cols), order_cols)
            .filter(F.col("tenant_id") == tenant_id))


def recent_jobs(current: DataFrame, tenant_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest jobs by ``created_at`` (ties by job id): for one tenant, or top-``limit`` per tenant."""
    if tenant_id is not None:
        return (current.filter(F.col("tenant_id") == tenant_id)
                       .orderBy(F.desc("created_at"), F.asc("job_id")).limit(limit))
    w = Window.partitionBy("tenant_id").orderBy(F.desc("created_at"), F.asc("job_id"))
    return current.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)


def audit_report(current: DataFrame, n: int = 10) -> DataFrame:
    """source_path, status, chunk_count, skipped_count of the newest ``n`` jobs, all tenants."""
    return (current.orderBy(F.desc("created_at"), F.asc("job_id")).limit(n)
                   .select("source_path", "status", "chunk_count", "skipped_count"))
