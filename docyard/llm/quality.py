"""Quality rules: a learned decision list over text statistics.

Per document, an Arrow UDF counts words, symbols, repeated lines and repeated
three-word windows over the whole text. Sequential covering then learns an
ordered list of threshold conjunctions from labelled rows: each rule *grows* by
the condition with the highest information gain, is *pruned* from its end on
rows held out from growing, and takes the rows it covers out of the training
set; learning ends when no rule keeps the wanted precision. The list is emitted
as one ordered Spark ``CASE WHEN`` over the statistics, so applying it needs no
model object and stays in the JVM.

Defined results: a null text has no words (all counts 0, base rule failed); an
empty table gives an empty result; without usable labels the list is empty and
only the base rule decides; repeated rows are judged alike, row by row; columns
beside ``doc_id`` and ``text`` are ignored by the report and carried by the filter.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docyard.llm.common import fresh, hashed_sample, table

#: Expected number of labelled rows that the list is learned from.
MAX_LABELLED = 20_000
MAX_RULES = 24
MAX_CONDITIONS = 4
#: Of the held-out rows that a rule rejects, this share must be labelled bad.
MIN_PRECISION = 0.95
MIN_COVER = 5
SPLITS = 48

#: Characters counted as symbols (fixed by the query's contract).
SYMBOLS = "#*$%&|<>"
BASE_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RATIOS = ("chars_per_word", "symbols_per_word", "dup_line_share", "repeat_share", "upper_share", "digit_share",
          "bang_per_word", "distinct_share", "words_per_line", "letters_share", "top_word_share", "punct_per_word")
STATS = BASE_COUNTS + RATIOS
STATS_TYPE = T.StructType([T.StructField(c, T.LongType()) for c in BASE_COUNTS]
                          + [T.StructField(c, T.DoubleType()) for c in RATIOS])

_BLANKS = b" \t\n\x0b\x0c\r"
_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGITS = b"0123456789"
_PUNCT = b".,;:!?"


def repeated_words(words: list[bytes]) -> tuple[int, int, int]:
    """(words inside three-word windows that occur twice or more, distinct words, most frequent word's count)."""
    n = len(words)
    if n == 0:
        return 0, 0, 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), dtype=np.int64, count=n)
    top = int(np.bincount(ids).max())
    k = len(number)
    if n < 4:
        return 0, k, top
    pair = ids[:-1] * k + ids[1:]
    if k < 2_000_000:
        window = pair[:-1] * k + ids[2:]
    else:  # three numbers no longer fit one 64-bit key: number the pairs first
        window = np.unique(pair[:-1], return_inverse=True)[1] * k + ids[2:]
    order = np.argsort(window, kind="stable")
    ordered = window[order]
    same = ordered[1:] == ordered[:-1]
    again = np.zeros(len(window), dtype=bool)
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    inside = np.zeros(n, dtype=bool)
    for shift in range(3):
        inside[shift:shift + len(again)] |= again
    return int(inside.sum()), k, top


def count_stats(text: str | None) -> tuple:
    """All statistics of one whole text, in the order of ``STATS``."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()  # splits bytes at exactly 0x20 and 0x09-0x0D
    n = len(words)
    word_chars = len(text) - sum(raw.count(b) for b in _BLANKS)
    symbols = sum(text.count(c) for c in SYMBOLS)
    lines = [line for line in raw.split(b"\n") if line.strip()]
    dup = len(lines) - len(set(lines))
    repeats, distinct, top = repeated_words(words)
    total = len(raw)
    upper = total - len(raw.translate(None, _UPPER))
    lower = total - len(raw.translate(None, _LOWER))
    digits = total - len(raw.translate(None, _DIGITS))
    punct = total - len(raw.translate(None, _PUNCT))
    ascii_chars = upper + lower
    per = max(n, 1)
    return (n, word_chars, symbols, dup, repeats,
            word_chars / per, symbols / per, dup / max(len(lines), 1), repeats / per,
            upper / max(ascii_chars, 1), digits / max(word_chars, 1), raw.count(b"!") / per,
            distinct / per, n / max(len(lines), 1), ascii_chars / max(word_chars, 1), top / per, punct / per)


@F.pandas_udf(STATS_TYPE)
def text_stats(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([count_stats(t) for t in texts], columns=list(STATS))


@dataclass(frozen=True)
class Condition:
    stat: str
    at_least: bool
    value: float

    def covers(self, x: dict[str, np.ndarray]) -> np.ndarray:
        return x[self.stat] >= self.value if self.at_least else x[self.stat] < self.value

    def column(self, prefix: str) -> Column:
        c = F.col(f"{prefix}.{self.stat}") if prefix else F.col(self.stat)
        return c >= self.value if self.at_least else c < self.value

    def __str__(self) -> str:
        return f"{self.stat} {'>=' if self.at_least else '<'} {self.value:g}"


Rule = tuple[Condition, ...]


def covered(rule: Rule, x: dict[str, np.ndarray], n: int) -> np.ndarray:
    out = np.ones(n, dtype=bool)
    for condition in rule:
        out &= condition.covers(x)
    return out


def _grow(x: dict[str, np.ndarray], bad: np.ndarray, max_conditions: int) -> Rule:
    """Add the condition of the highest gain until no good row is covered or nothing gains."""
    rule: Rule = ()
    inside = np.ones(len(bad), dtype=bool)
    while len(rule) < max_conditions:
        p0, n0 = int((inside & bad).sum()), int((inside & ~bad).sum())
        if p0 == 0 or n0 == 0:
            break
        before = np.log2(p0 / (p0 + n0))
        best, best_gain = None, 1e-9
        for stat, values in x.items():
            mine = values[inside]
            mine_bad = bad[inside]
            cuts = np.unique(np.concatenate([np.quantile(part, np.linspace(0, 1, SPLITS + 1))
                                             for part in (mine, mine[mine_bad], mine[~mine_bad])]))
            order = np.sort(mine)
            order_bad = np.sort(mine[mine_bad])
            below = np.searchsorted(order, cuts, "left")
            below_bad = np.searchsorted(order_bad, cuts, "left")
            for at_least in (True, False):
                p = (p0 - below_bad) if at_least else below_bad
                rows = (len(order) - below) if at_least else below
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(p > 0, p * (np.log2(p / np.maximum(rows, 1)) - before), -1.0)
                k = int(np.argmax(gain))
                if gain[k] > best_gain:
                    # halfway to the nearest value on the other side, so that a little less of the same still counts
                    lower = order[below[k] - 1] if below[k] else cuts[k]
                    best, best_gain = Condition(stat, at_least, float(lower + cuts[k]) / 2), float(gain[k])
        if best is None:
            break
        rule += (best,)
        inside &= best.covers(x)
    return rule


def _prune(rule: Rule, x: dict[str, np.ndarray], bad: np.ndarray) -> Rule:
    """The beginning of the rule that separates the held-out rows best (shorter wins ties)."""
    best, best_worth = rule, -2.0
    for length in range(1, len(rule) + 1):
        inside = covered(rule[:length], x, len(bad))
        p, n = int((inside & bad).sum()), int((inside & ~bad).sum())
        worth = (p - n) / (p + n) if p + n else -1.0
        if worth > best_worth + 1e-12:
            best, best_worth = rule[:length], worth
    return best


def learn_rules(stats: pd.DataFrame, bad: np.ndarray, hold_out: np.ndarray, max_rules: int = MAX_RULES,
                max_conditions: int = MAX_CONDITIONS, min_precision: float = MIN_PRECISION,
                min_cover: int = MIN_COVER) -> list[Rule]:
    """Sequential covering: an ordered list of rules that mark bad rows."""
    bad = np.asarray(bad, dtype=bool)
    # shares before counts: of two equally good conditions the one that ignores a text's length wins
    columns = {c: stats[c].to_numpy(dtype=float) for c in RATIOS + BASE_COUNTS if c in stats}
    part = lambda keep: ({c: v[keep] for c, v in columns.items()}, bad[keep])
    grow_left, prune_left = ~hold_out, hold_out.copy()
    rules: list[Rule] = []
    while len(rules) < max_rules:
        gx, gy = part(grow_left)
        px, py = part(prune_left)
        if gy.sum() < min_cover or py.sum() < 1:
            break
        rule = _grow(gx, gy, max_conditions)
        if not rule:
            break
        rule = _prune(rule, px, py)
        inside = covered(rule, px, len(py))
        p = int((inside & py).sum())
        if p < min_cover or p < min_precision * int(inside.sum()):
            break
        rules.append(rule)
        hit = covered(rule, columns, len(bad))
        grow_left &= ~hit
        prune_left &= ~hit
    return rules


def rejects(rules: list[Rule], prefix: str = "") -> Column:
    """The list as one ordered conditional: the number (from 1) of the first rule that fires, else 0."""
    out = None
    for k, rule in enumerate(rules, 1):
        test = rule[0].column(prefix)
        for condition in rule[1:]:
            test = test & condition.column(prefix)
        out = F.when(test, F.lit(k)) if out is None else out.when(test, F.lit(k))
    return F.lit(0) if out is None else out.otherwise(F.lit(0))


def base_failed(prefix: str = "") -> Column:
    at = f"{prefix}." if prefix else ""
    return (F.col(f"{at}n_words") < 50) | (100 * F.col(f"{at}n_repeat_words") > 50 * F.col(f"{at}n_words"))


def fit_rules(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> list[Rule]:
    """Learn the list from at most about ``max_labelled`` labelled ids (chosen by a hash), one row each (the least of its texts).

    Only rows that pass the base rule train it: the others are rejected anyway.
    """
    marks = (labels.select("doc_id", "quality").dropna().groupBy("doc_id")
             .agg((F.avg("quality") < 0.5).alias("bad")))
    marks = hashed_sample(marks, "doc_id", max_labelled)
    one = docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id").groupBy("doc_id").agg(
        F.min("text").alias("text"), F.first("bad").alias("bad"))
    rows = (one.select("bad", (F.pmod(F.xxhash64(F.lit("hold"), "doc_id"), F.lit(3)) == 0).alias("hold"),
                    text_stats("text").alias("s"))
            .select("bad", "hold", "s.*").toPandas())
    if rows.empty:
        return []
    rows = rows[~((rows.n_words < 50) | (100 * rows.n_repeat_words > 50 * rows.n_words))]
    return learn_rules(rows, rows["bad"].to_numpy(dtype=bool), rows["hold"].to_numpy(dtype=bool))


def quality_report(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """Per row of ``docs``: the counts, the base rule, the rule that fired (0: none) and the verdict."""
    s = docs.select("doc_id", text_stats("text").alias("s"))
    return s.select("doc_id", *[F.col(f"s.{c}").alias(c) for c in BASE_COUNTS],
                    base_failed("s").alias("base_failed"), rejects(rules, "s").alias("rule"),
                    (~base_failed("s") & (rejects(rules, "s") == 0)).alias("kept"))


def keep_good(docs: DataFrame, rules: list[Rule]) -> DataFrame:
    """``docs`` without the rows that the base rule or the list rejects; columns as they were."""
    (s,) = fresh(docs.columns, "_stats")
    marked = docs.withColumn(s, text_stats("text"))
    return marked.filter(~base_failed(s) & (rejects(rules, s) == 0)).select(*docs.columns)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, fit_rules(docs, table(spark, sf_dir, "labels")))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_report(docs, fit_rules(docs, table(spark, sf_dir, "labels")))
