"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docyard.session import ensure_checkpoint_dir, ship_package

DOCUMENT_COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, read by Spark (any path Spark can open)."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_or_empty(column: str = "text") -> Column:
    """The text; a null text counts as the empty one."""
    return F.coalesce(F.col(column), F.lit(""))


def fresh(taken, *names: str) -> list[str]:
    """Column names for internal use that clash with none of ``taken`` (case is ignored)."""
    used = {c.lower() for c in taken}
    out = []
    for name in names:
        while name.lower() in used:
            name = "_" + name
        used.add(name.lower())
        out.append(name)
    return out


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder: lineage ends here, every executor can read it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hashed_sample(df: DataFrame, key: str, bound: int, total: int | None = None) -> DataFrame:
    """About ``bound`` of the rows, chosen by a hash of ``key``; all rows when there are fewer.

    The choice depends on the key alone, so it is the same on every retry and
    needs neither a sort nor a single task.
    """
    n = df.count() if total is None else total
    if n <= bound:
        return df
    space = 1 << 30
    return df.filter(F.pmod(F.xxhash64(F.lit("sample"), F.col(key)), F.lit(space)) < int(space * bound / n))
