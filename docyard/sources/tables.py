"""Reading the given parquet tables and shaping them into canonical documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table as Spark splits it; no row is moved before the first operator that needs it."""
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table in the canonical document shape.

    ``source`` plays the tenant; the source path is a stable per-document name
    so that ordering by it reproduces a sorted directory walk.
    """
    return as_documents(read_table(spark, sf_dir, "documents"))


def as_documents(d: DataFrame) -> DataFrame:
    """Rows of the ``documents`` table (or of a stream of it) in the canonical document shape."""
    return d.select(
        "doc_id",
        F.col("text").alias("content"),
        F.col("source").alias("tenant_id"),
        F.format_string("%s/%08d.txt", F.col("source"), F.col("doc_id")).alias("source_path"),
        F.lit("text").alias("format"),
        F.col("lang").alias("given_language"),
    )


def with_file_rows(df: DataFrame) -> DataFrame:
    """Rows of files with where they lie: ``file_name``, ``file_size``, ``file_row`` (from 0), from the reader's hidden columns.

    (``file_name``, ``file_row``) names a row that has no id of its own, and orders rows as they were written.
    """
    at = {"file_name": "file_name", "file_size": "file_size", "file_row": "row_index"}
    return df.select("*", *[F.col(f"_metadata.{c}").alias(name) for name, c in at.items()])


def stream_table(spark: SparkSession, sf_dir: str, name: str, files_per_trigger: int | None = None) -> DataFrame:
    """A given table (one file or a folder of files) as a stream of its files, with the table's schema."""
    schema = read_table(spark, sf_dir, name).schema
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    files = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    folder = files.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(files).isDirectory()
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if folder:
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{name}.parquet").parquet(sf_dir)
