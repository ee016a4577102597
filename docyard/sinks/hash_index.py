"""The index of stored hashes as a table bucketed and sorted by hash.

A run's new keys are appended as they are written; a check against the index joins on the hash, so Spark reads the table bucket by
bucket and only the (few, narrow) new keys are shuffled into its buckets. The number of buckets is fixed when the table is made:
choose it for the size the index will reach (``buckets`` times what one task reads).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 64


def append_index(keys: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Add (tenant_id, chunk_hash) rows; the first call makes the table (under ``path``, when given)."""
    rows = keys.select(F.col("tenant_id").cast("string").alias("tenant_id"), "chunk_hash")
    # dealt by bucket before writing: one file per bucket and run, not one per task and bucket
    writer = (rows.repartition(buckets, "chunk_hash").write.format("parquet").mode("append")
              .bucketBy(buckets, "chunk_hash").sortBy("chunk_hash"))
    (writer.option("path", path) if path else writer).saveAsTable(table)


def read_index(spark: SparkSession, table: str) -> DataFrame | None:
    """The index, or None while there is none."""
    return spark.table(table) if spark.catalog.tableExists(table) else None


def drop_index(spark: SparkSession, table: str) -> None:
    spark.sql(f"DROP TABLE IF EXISTS {table}")
