"""Vector table: Spark's own partitioned Parquet, one ``run`` partition per write, and the latest row per key as its view.

Every upsert appends ``data/run=<sequence>/tenant=<t>/`` with Spark's writer; nothing is rewritten, so a run that is repeated after a
failure only adds rows that the view resolves. Readers see, per key, the row with the highest ``ingest_seq``
(``row_number() = 1``, trimmed map-side by WindowGroupLimit). ``tenant`` and ``run`` are folder names only; ``tenant_id`` is a column
of the files as well, so a tenant that looks like a number stays a string. Rows are clustered by tenant (a large one over
several files) and sorted by hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from docyard.functions.hashing import chunk_hash, point_id

SIZE_ERROR = "vector_size must be greater than zero"
KEY_COLUMNS = ("tenant_id", "point_id")


def _found(spark: SparkSession, pattern: str) -> bool:
    """Whether a path (or a pattern of paths) is there."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(pattern)
    return bool(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p))


def _at(path: str, name: str) -> str:
    return f"{path.rstrip('/')}/{name}"


def table_properties(spark: SparkSession, path: str) -> dict | None:
    """What the table was made with; None when there is none."""
    if not _found(spark, _at(path, "properties")):
        return None
    return spark.read.schema(PROPERTIES).json(_at(path, "properties")).first().asDict()


PROPERTIES = "vector_size int, metric string, key array<string>, partitioned_by array<string>, indexed array<string>"


def ensure_table(spark: SparkSession, path: str, vector_size: int, metric: str = "cosine", key=KEY_COLUMNS) -> dict:
    """Create the table once; an existing one must have the same width."""
    if vector_size <= 0:
        raise ValueError(SIZE_ERROR)
    made = spark.createDataFrame([(vector_size, metric, list(key), ["tenant_id"], ["tenant_id", "chunk_hash"])], PROPERTIES)
    made.coalesce(1).write.mode("ignore").json(_at(path, "properties"))
    props = table_properties(spark, path)
    if props["vector_size"] != vector_size:
        raise ValueError(f"vector table at {path} holds vectors of width {props['vector_size']}, asked for {vector_size}")
    return props


def _properties(spark: SparkSession, path: str) -> dict:
    props = table_properties(spark, path)
    if props is None:
        raise ValueError(f"no vector table at {path}; call ensure_table first")
    return props


def build_points(chunks_with_vectors: DataFrame, text_col: str = "text", vector_col: str = "embedding") -> DataFrame:
    """Hash, deterministic id and payload columns (payload fields win on a name clash)."""
    df = chunks_with_vectors
    if "chunk_hash" not in df.columns:
        df = df.withColumn("chunk_hash", chunk_hash(text_col))
    return df.withColumn("point_id", point_id("chunk_hash"))


# Payload fields every point carries, written after the metadata (they win on a clash).
PAYLOAD_FIELDS = ("doc_id", "chunk_index", "start_char", "end_char", "text", "chunk_hash")


def payload_json(chunks: DataFrame, metadata_cols) -> DataFrame:
    """Add ``payload``: the chunk's metadata then its payload fields, as one JSON object."""
    meta = [c for c in metadata_cols if c not in PAYLOAD_FIELDS]
    return chunks.withColumn("payload", F.to_json(F.struct(*[F.col(c) for c in (*meta, *PAYLOAD_FIELDS)])))


def upsert(points: DataFrame, path: str, ingest_seq: int, vector_col: str = "embedding") -> int:
    """Add points under ``ingest_seq``; returns the number written, counted by the write itself."""
    size = _properties(points.sparkSession, path)["vector_size"]
    checked = points.withColumn(
        vector_col,
        F.when(F.size(vector_col) == size, F.col(vector_col))
         .otherwise(F.raise_error(F.concat(F.lit(f"vector width must be {size}, got "),
                                           F.size(vector_col).cast("string")))))
    out = checked.withColumns({"ingest_seq": F.lit(ingest_seq).cast("long"), "tenant_id": F.col("tenant_id").cast("string"),
                               "run": F.lit(ingest_seq).cast("string"), "tenant": F.col("tenant_id").cast("string")})
    seen = Observation()
    order = [c for c in ("tenant", "chunk_hash") if c in out.columns]
    (out.hint("rebalance", F.col("tenant")).sortWithinPartitions(*order).observe(seen, F.count(F.lit(1)).alias("written"))
     .write.mode("append").partitionBy("run", "tenant").parquet(_at(path, "data")))
    return int(seen.get.get("written") or 0)


def latest_by_key(df: DataFrame, key, order_col: str = "ingest_seq") -> DataFrame:
    """Per key, the row with the highest ``order_col`` (map-side trimmed top-1)."""
    w = Window.partitionBy(*key).orderBy(F.desc(order_col))
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def current_view(parts: list[DataFrame], key, order_col: str = "ingest_seq") -> DataFrame:
    """The current rows of several batches: all of them together, then the latest per key.

    No batch is left out by its sequence: a late batch with a smaller one adds every key nobody else has.
    """
    df = parts[0]
    for more in parts[1:]:
        df = df.unionByName(more, allowMissingColumns=True)
    return latest_by_key(df, key, order_col)


def _rows(spark: SparkSession, path: str) -> DataFrame | None:
    """All rows of all runs; None while no run has written any."""
    if not _found(spark, _at(path, "data/run=*")):
        return None
    return spark.read.option("mergeSchema", True).parquet(_at(path, "data")).drop("run", "tenant")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """The current points: every run, latest per key."""
    props, rows = _properties(spark, path), _rows(spark, path)
    if rows is None:
        raise ValueError(f"vector table at {path} holds no data yet")
    return latest_by_key(rows, props["key"])


def index_keys(spark: SparkSession, path: str) -> DataFrame | None:
    """(tenant_id, chunk_hash) of every stored point, for the dedup check.

    With the default key (tenant, point id), and the point id derived from the
    hash, a key once written stays present, so the keys are read straight from
    the files (two columns) without the
    latest-per-key window, i.e. without shuffling the whole table per run. With the point id alone as key
    a later tenant may have replaced an earlier one's point, so the latest
    view decides.
    """
    props = table_properties(spark, path)
    rows = _rows(spark, path) if props else None
    if rows is None:
        return None
    if tuple(props["key"]) != KEY_COLUMNS:
        rows = latest_by_key(rows, props["key"])
    return rows.select("tenant_id", "chunk_hash")


def points_per_tenant(points: DataFrame) -> DataFrame:
    """How many current points each tenant has."""
    return points.groupBy("tenant_id").agg(F.count(F.lit(1)).alias("points"))


def point_count(spark: SparkSession, path: str) -> int:
    rows = _rows(spark, path)
    return 0 if rows is None else latest_by_key(rows, _properties(spark, path)["key"]).count()
