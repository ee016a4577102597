"""Language identification: character-trigram naive Bayes, trained and applied as joins and sums.

Training is a Spark aggregation over labelled text (words with their neighbours' letters are counted first, the
trigrams of each distinct one are cut once and summed, both combined map-side); ``training_share`` bounds
the labelled rows it reads. The model is a written table: one row per gram with its weight in every language. Nothing
of it passes through the driver but the languages' names, so it may grow with the corpus and its scripts.

Scoring: the grams of a sample (equal ones as one row where the profile is large) meet the profile on the gram's hash, then
the gram itself; one sum per
language is combined map-side for each sample, and the best language is the largest sum. Spark sees the profile's
size on disk and broadcasts it where its own limit allows; a larger one is joined by sort and merge. Equal
samples are one key (their hash), and only (hash, language, confidence) rows are joined back to the documents.

Text rule: the sample is the first ``sample_chars`` characters (None: the whole text), stripped
(empty sample -> NULL); lower case; every run of non-letters becomes one
space; the result is trimmed and padded with one space on each side; grams
are all substrings of length 3.
Score of language L: sum over the sample's grams of log((c[L,g]+1)/(T[L]+V)),
with c the training count, T[L] the training gram total of L, V the number of
distinct training grams. Probabilities are the softmax over languages; the
best language (ties: the first by name) is returned when its probability reaches the threshold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docyard.functions.text import py_strip, with_column_where
from docyard.session import drop_path, scratch_path

#: Profiles of more grams may outgrow a broadcast: then a sample's equal grams are one row before the join, at the price of a sort.
MANY_GRAMS = 250_000


def normalized_letters(col: Column | str) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}]+", " ")), F.lit(" "))


def trigrams(col: Column | str) -> Column:
    """All overlapping substrings of length 3 of the normalised text, in one regex pass."""
    return F.regexp_extract_all(normalized_letters(col), F.lit("(?=(.{3}))"), 1)


def detection_sample(col: Column | str, sample_chars: int | None = 2000) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return py_strip(c if sample_chars is None else F.substring(c, 1, sample_chars))


def train_profile(df: DataFrame, text_col: str = "text", label_col: str = "lang") -> DataFrame:
    """(lang, gram, n) counts over whole labelled texts: words are counted first, grams are cut from each distinct one once."""
    return (df.filter(F.col(label_col).isNotNull())
              .select(F.col(label_col).alias("lang"), F.explode(word_units(normalized_letters(text_col))).alias("unit"))
              .groupBy("lang", "unit").agg(F.count(F.lit(1)).alias("n"))
              .select("lang", "n", F.explode(F.regexp_extract_all("unit", F.lit("(?=(.{3}))"), 1)).alias("gram"))
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))


def word_units(normalized: Column) -> Column:
    """Each word of a normalised text with the spaces around it and the first letter of the next word.

    Every gram of the text lies in exactly one of them: its middle is a letter of that word, or the space after it.
    """
    return F.regexp_extract_all(normalized, F.lit("(?=( [^ ]+ [^ ]?))"), 1)


def gram_counts(normalized: Column) -> Column:
    """The grams of a normalised text in order, equal ones as one string of copies (``abcabc``: ``abc`` twice)."""
    ordered = F.array_join(F.sort_array(F.regexp_extract_all(normalized, F.lit("(?=(.{3}))"), 1)), "")
    return F.regexp_extract_all(ordered, F.lit(r"((.{3})\2*+)"), 1)


@dataclass
class LanguageModel:
    """A written profile: ``gram`` and ``weights``, one per language in the order of ``languages``; what any gram costs in each."""

    path: str
    languages: list[str]
    costs: list[float]
    profile: DataFrame
    grams: int = 0

    def drop(self) -> None:
        """Delete the written profile."""
        drop_path(self.profile.sparkSession, self.path)


def fit_language_model(df: DataFrame, text_col: str = "text", label_col: str = "lang",
                       training_share: float = 1.0) -> LanguageModel:
    """Train on Spark and write the profile into the shared scratch folder.

    ``training_share`` < 1 learns from that share of the labelled rows, chosen by a hash of the text.
    """
    if training_share < 1:
        df = df.filter(F.pmod(F.xxhash64(F.col(text_col)), F.lit(1_000_000)) < int(training_share * 1_000_000))
    spark = df.sparkSession
    counted = scratch_path(spark, "language-counts")
    path = scratch_path(spark, "language-profile")
    try:
        train_profile(df, text_col, label_col).groupBy("gram").agg(
            F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("counts")).write.parquet(counted)
        counts = spark.read.parquet(counted)
        vocabulary = float(counts.count())
        # one total per language: as many numbers as there are languages
        totals = counts.select(F.explode("counts").alias("lang", "n")).groupBy("lang").agg(F.sum("n").alias("t")).collect()
        totals = {r["lang"]: float(r["t"]) for r in sorted(totals, key=lambda r: r["lang"])}
        weight = lambda lang: F.log(F.coalesce(F.try_element_at("counts", F.lit(lang)), F.lit(0)) + 1.0)
        counts.select("gram", F.array(*map(weight, totals)).cast("array<double>").alias("weights")).write.parquet(path)
    finally:
        drop_path(spark, counted)
    return LanguageModel(path, list(totals), [math.log(t + vocabulary) for t in totals.values()], spark.read.parquet(path),
                         int(vocabulary))


def language_scores(samples: DataFrame, model: LanguageModel) -> DataFrame:
    """(_key, _lang, _sure) of each distinct ``_key``; ``samples``: _key and the normalised text _norm."""
    if model.grams > MANY_GRAMS:
        runs = samples.select("_key", F.posexplode(gram_counts(F.col("_norm"))).alias("at", "run"))
        grams = runs.select("_key", "at", F.substring("run", 1, 3).alias("gram"), (F.length("run") / 3).alias("n"))
    else:
        cut = F.regexp_extract_all("_norm", F.lit("(?=(.{3}))"), 1)
        grams = samples.select("_key", F.posexplode(cut).alias("at", "gram"), F.lit(1.0).alias("n"))
    grams = grams.withColumn("gram_code", F.xxhash64("gram"))
    scores = [F.coalesce(F.sum(F.col("n") * F.col(f"_w{j}")), F.lit(0.0)) - F.sum("n") * cost
              for j, cost in enumerate(model.costs)]
    weights = model.profile.select(F.col("gram").alias("_g"), F.xxhash64("gram").alias("_c"), *[F.get("weights", F.lit(j)).alias(f"_w{j}") for j in range(len(model.costs))])
    # a sample that occurs several times adds up as often
    # met on an integer, which Spark looks up fastest; grams of one length are equal when one starts with the other
    met = (F.col("gram_code") == F.col("_c")) & F.col("gram").startswith(F.col("_g"))
    per = grams.join(weights, met, "left").groupBy("_key").agg(
        F.count_if(F.col("at") == 0).alias("_copies"), F.array(*scores).cast("array<double>").alias("_all"))
    names = F.array(*map(F.lit, model.languages)).cast("array<string>")
    best = F.array_max("_all")
    odds = F.aggregate("_all", F.lit(0.0), lambda acc, s: acc + F.exp((s - best) / F.col("_copies")))
    return per.filter(F.size("_all") > 0).select(
        "_key", F.get(names, F.array_position("_all", best).cast("int") - 1).alias("_lang"), (F.lit(1.0) / odds).alias("_sure"))


def detect_language(df: DataFrame, model: LanguageModel, text_col: str = "content",
                    threshold: float = 0.9, sample_chars: int | None = 2000,
                    out_col: str = "language", confidence_col: str | None = None) -> DataFrame:
    """Add the detected language (NULL when empty or below ``threshold``)."""
    c = F.col(text_col) if sample_chars is None else F.substring(text_col, 1, sample_chars)
    # equal raw samples are one key: only the side that is scored normalises them (white space at the ends is no letter)
    own = F.md5(c)
    samples = with_column_where(df.select(own.alias("_key"), c.alias("_raw")), "_norm", normalized_letters("_raw"),
                                lambda s: F.length(s) >= 3)   # shorter: nothing to score
    scores = language_scores(samples.select("_key", "_norm"), model)
    lang = F.when(F.col("_sure") >= F.lit(threshold), F.col("_lang"))
    found = scores.select(F.col("_key").alias("_lid"), lang.alias(out_col), F.col("_sure").alias(confidence_col or "_conf"))
    rest = [c for c in df.columns if c not in (out_col, confidence_col)]
    out = df.select(*rest, own.alias("_key")).join(found, F.col("_key") == F.col("_lid"), "left")
    return out.select(*rest, out_col, *([confidence_col] if confidence_col else []))
