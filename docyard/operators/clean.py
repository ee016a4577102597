"""Document cleaning: text steps, minimum length, language filter.

Order matters and is kept: the text steps run first, the length check drops
short rows before the (costlier) language step ever sees them, and the
language filter runs last. With a language filter the cleaned rows are checkpointed once: their samples are scored by a join.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docyard.config import IngestConfig
from docyard.functions.text import apply_steps, default_cleaning_steps, with_column_where
from docyard.operators.language import LanguageModel, detect_language
from docyard.session import cut_lineage


def python_step(fn: Callable[[str], str]) -> Callable[[Column], Column]:
    """A Python ``str -> str`` function as a cleaning step: one Arrow batch at a time, null stays null.

    A built-in expression is faster; this is for rules that have none. The function must be importable on the workers.
    """
    @F.pandas_udf("string")
    def step(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else fn(t) for t in texts], dtype="object")

    return lambda text: step(text)


def clean_text(df: DataFrame, text_col: str = "content", steps=None, patterns=None) -> DataFrame:
    """Apply the ordered ``Column -> Column`` steps (``python_step`` makes one of a ``str`` function) to one column, in one projection."""
    steps = default_cleaning_steps(patterns) if steps is None else steps
    return df.withColumn(text_col, apply_steps(F.col(text_col), steps))


def clean_documents(df: DataFrame, cfg: IngestConfig = IngestConfig(), model: LanguageModel | None = None,
                    text_col: str = "content", steps=None) -> DataFrame:
    """Cleaned documents that pass the length and language checks, with ``language``."""
    steps = cfg.cleaning_steps if steps is None else steps
    steps = default_cleaning_steps(cfg.boilerplate_patterns) if steps is None else steps
    kept = with_column_where(df, text_col, apply_steps(F.col(text_col), steps),
                             lambda c: F.length(c) >= F.lit(cfg.min_content_chars))
    if model is None or cfg.target_language is None:
        return kept.withColumn("language", F.lit(None).cast("string"))
    # the cleaned rows have two readers, the language scores and the join that brings them back: cleaned once, kept once
    scored = detect_language(cut_lineage(kept), model, text_col, cfg.language_confidence_threshold, cfg.language_sample_chars)
    return scored.filter(F.col("language") == F.lit(cfg.target_language))
