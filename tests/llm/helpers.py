"""Small tables for the operators' tests."""

import random
import re

#: Plan nodes that run Python on the executors.
PYTHON_NODES = re.compile(r"EvalPython|InPandas|InArrow|PythonUDF")

DOC_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Extra columns named like the operators' own results and inner columns.
CLASHES = ("code", "row_key", "key", "pos", "kept", "score", "label", "part", "salt", "sequence_id", "component_id",
           "_stats", "_score", "_gone", "_keep", "_turn", "n_words", "rule", "grp", "hits", "line")


def words(rng, n, alphabet="abcdefgh"):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(2, 6))) for _ in range(n))


def docs(spark, rows, clash=False):
    """rows: (doc_id, text[, source])."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s1", len(r[1]) if r[1] is not None else None) for r in rows]
    df = spark.createDataFrame(full, DOC_SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        for c in CLASHES:
            df = df.withColumn(c, F.lit("extra"))
    return df


def edge_rows(seed=3):
    """Nulls, empty and very long texts, repeated rows."""
    rng = random.Random(seed)
    long = words(rng, 30_000)
    return [(1, words(rng, 80)), (2, None), (3, ""), (None, words(rng, 60)), (5, long), (6, "one"), (7, "one two"),
            (8, "\n\n \t\n"), (9, "é ü 漢字 😀 \x00 end"), (10, "dup line here for all\n" * 3), (10, "dup line here for all\n" * 3),
            (11, words(rng, 80)), (None, None)]
