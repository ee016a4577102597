"""A training-data pipeline over ``documents``: five stages, each one operator of ``docyard.llm``.

Quality rules and toxicity drop documents, line dedup takes boilerplate lines out of the texts, SimHash keeps
one document of each group of near copies, packing turns the rest into token sequences. Every stage is written
as Parquet into the shared checkpoint folder and read again, so a stage is never computed twice and a lost
executor costs its own tasks only. A stage's input goes as soon as its output is written: at most two stages lie there at a time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docyard.llm.common import table
from docyard.llm.linededup import line_dedup_stage
from docyard.llm.packing import packing_stage
from docyard.llm.quality import quality_stage
from docyard.llm.simhash import simhash_stage
from docyard.llm.toxicity import toxicity_stage
from docyard.session import drop_path, scratch_path

STAGES = [
    ("quality_rules", quality_stage),
    ("toxicity", toxicity_stage),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("packing", packing_stage),
]

#: Learned rules, a trained classifier and byte pair ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the ``documents`` table of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    base = scratch_path(spark, "corpus-pipeline")
    before = None
    for number, (name, stage) in enumerate(STAGES, 1):
        path = f"{base}/{number}-{name}"
        stage(spark, docs, sf_dir).write.mode("overwrite").parquet(path)
        docs = spark.read.parquet(path)
        if before:
            drop_path(spark, before)
        before = path
    return docs
