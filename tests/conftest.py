import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession
    from docyard.session import ensure_checkpoint_dir
    s = (SparkSession.builder.master("local[*]")
         .config("spark.sql.shuffle.partitions", "8")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.ui.enabled", "false")
         .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
         .getOrCreate())
    s.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(s)
    yield s


@pytest.fixture(scope="session")
def sample_text():
    # four short sentences, as in the reference's shared fixture
    return ("Retrieval systems split documents into chunks. Each chunk is embedded as a vector. "
            "Similar chunks are found by cosine similarity. The best matches form the context.")


def one(spark, col_expr, value, schema="x string"):
    df = spark.createDataFrame([(value,)], schema)
    return df.select(col_expr.alias("y")).first()["y"]
