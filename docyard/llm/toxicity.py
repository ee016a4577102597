"""Toxicity by weak supervision: voters, a generative label model, a linear classifier.

1. *Voters* look at a whole text and vote or stay silent: hand-written lexicons, hand-written
   patterns, and lexicons and word-beginning patterns mined from the labelled training rows.
   The annotator's label is one more voter, heard only in training.
2. A *label model* with a hidden class estimates, by expectation maximisation, each voter's
   accuracy (how often it votes on either class) and the correlations between voters: pairs
   that depend on each other given the class are linked in a maximum spanning forest, and a
   voter's probabilities are conditioned on its parent there, so echoes of one cue do not count twice.
3. A *linear classifier* (logistic regression) over word and word-beginning features is
   trained on the posteriors. It scores every document; neither labels, language, source
   nor id are inputs of a score.

Features count once per text, so a long text needs no more than one clear cue. Only a bounded
sample of labelled training rows reaches the driver, as small integer arrays; scoring is an Arrow
UDF with the classifier's weights in its closure (at most ``MAX_FEATURES`` entries).

Defined results: a null or empty text holds no feature and gets the classifier's base
probability; without labelled rows of both classes the hand-written voters alone decide
(score = share-of-voters posterior under default accuracies); repeated rows get equal scores; a row without id is not held out.
Texts are read whole, a very long one counts each of its features once; an empty table gives an empty result; other columns are
ignored by the report and carried by the stage. An id on many rows trains as one row.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docyard.llm.common import fresh, hashed_sample, table

#: Expected number of labelled training rows used to fit the models.
MAX_LABELLED = 24_000
#: Features the classifier may use.
MAX_FEATURES = 6_000
#: Mined voters: word groups and word-beginning patterns.
MINED_LEXICONS = 8
MINED_PATTERNS = 24
MIN_SUPPORT = 6
#: A feature takes part when it is toxic at least so many times as often as not.
MIN_ODDS = 4
#: A feature held by this share of the toxic rows is penalised at the nominal strength, a rarer one more.
SUPPORT_SHARE = 0.017
THRESHOLD = 0.7
#: Words whose features a task remembers; beyond it the memory starts anew.
MEMO_WORDS = 60_000

# Hand-written voters. Lexicons hold whole words (lower case), patterns are regular expressions.
LEXICONS: dict[str, tuple[str, ...]] = {
    "en_intellect": ("idiot", "idiots", "moron", "morons", "stupid", "imbecile", "dumb", "dimwit"),
    "en_character": ("loser", "losers", "pathetic", "clown", "clowns", "coward", "liar"),
    "en_worth": ("worthless", "useless", "trash", "garbage", "scum", "filth", "vermin"),
    "en_disgust": ("disgusting", "revolting", "repulsive", "vile", "nasty"),
    "de_insult": ("idiot", "dummkopf", "blödmann", "trottel", "abschaum", "widerlich", "wertlos", "versager", "dumm"),
    "fr_insult": ("idiot", "idiote", "imbécile", "débile", "minable", "ordure", "dégoûtant", "crétin", "stupide"),
    "es_insult": ("idiota", "imbécil", "estúpido", "estúpida", "basura", "asqueroso", "patético", "escoria", "inútil"),
}
PATTERNS: dict[str, str] = {
    "direct_address": r"\byou(?: are|'re)? (?:an? )?(?:complete |total |utter )?(?:idiot|moron|loser|clown|liar)",
    "this_insult": r"\b(?:this|that|the) (?:idiot|moron|loser|clown|scum|trash)\b",
    "shut_up": r"\bshut (?:the \w+ )?up\b",
    "threat": r"\b(?:kill|hurt|destroy) you\b",
}

_WORD = re.compile(r"[^\W\d_]+")
BEGINNINGS = (3, 4, 5, 6, 7)


def words_of(text: str | None) -> set[str]:
    """The distinct words (letters only, lower case) of a whole text."""
    return set(_WORD.findall((text or "").lower()))


def features_of(word: str) -> list[str]:
    """A word's features: the word and its beginnings (marked by a trailing ``*``)."""
    return [word] + [word[:k] + "*" for k in BEGINNINGS if len(word) > k]


def training_fold() -> Column:
    """Rows whose labels may be learned from: CRC-32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1


@F.pandas_udf(T.ArrayType(T.StringType()))
def _distinct_features(texts: pd.Series) -> pd.Series:
    def one(text):
        out: set[str] = set()
        for w in words_of(text):
            out.update(features_of(w))
        return list(out)
    return texts.map(one, na_action=None)


def mine_features(rows: DataFrame, n_features: int = MAX_FEATURES) -> pd.DataFrame:
    """The features that tell toxic texts best: columns feature, pos, neg (documents holding it).

    Only features that are clearly more often toxic than not take part: a long clean text holds
    thousands of words, and many weak cues must not add up to a strong one. ``rows`` has the columns ``text`` and ``toxic`` (0/1) and is a bounded sample. Spark counts
    the features of toxic rows first, then only those that can still qualify in the others.
    """
    totals = rows.agg(F.sum("toxic"), F.count(F.lit(1))).first()
    n_pos, n = int(totals[0] or 0), int(totals[1])
    if n_pos == 0 or n_pos == n:
        return pd.DataFrame({"feature": [], "pos": [], "neg": []})
    least = MIN_SUPPORT * MIN_ODDS / (MIN_ODDS + 1)  # fewer toxic rows cannot reach both limits
    held = (rows.filter("toxic = 1").select(F.explode(_distinct_features("text")).alias("feature"))
            .groupBy("feature").agg(F.count(F.lit(1)).alias("pos")).filter(F.col("pos") >= least))
    likely = held.toPandas()
    wanted = frozenset(likely["feature"])

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def known_features(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list({f for w in words_of(t) for f in features_of(w) if f in wanted}), na_action=None)

    against = (rows.filter("toxic = 0").select(F.explode(known_features("text")).alias("feature"))
               .groupBy("feature").agg(F.count(F.lit(1)).alias("neg")).toPandas())
    counts = likely.merge(against, "left", "feature").fillna({"neg": 0})
    counts = counts[(counts["pos"] + counts["neg"] >= MIN_SUPPORT) & (counts["pos"] >= MIN_ODDS * counts["neg"])].copy()
    rate_pos = (counts["pos"] + 0.5) / (n_pos + 1.0)
    rate_neg = (counts["neg"] + 0.5) / (n - n_pos + 1.0)
    counts["weight"] = (np.log(rate_pos / rate_neg) * np.sqrt(counts["pos"])).round(9)
    return counts.sort_values(["weight", "feature"], ascending=[False, True]).head(n_features).reset_index(drop=True)


@dataclass
class Voters:
    """Named voters over a text's words and its lower-cased text."""

    lexicons: dict[str, frozenset[str]] = field(default_factory=dict)
    beginnings: dict[str, str] = field(default_factory=dict)
    patterns: dict[str, str] = field(default_factory=dict)

    @property
    def names(self) -> list[str]:
        return [*self.lexicons, *self.beginnings, *self.patterns]

    def votes(self, text: str | None) -> list[int]:
        words = words_of(text)
        starts = {w[:k] for w in words for k in BEGINNINGS if len(w) > k}
        low = (text or "").lower()
        return ([int(not words.isdisjoint(v)) for v in self.lexicons.values()]
                + [int(v in starts) for v in self.beginnings.values()]
                + [int(bool(re.search(p, low))) for p in self.patterns.values()])


def build_voters(mined: pd.DataFrame) -> Voters:
    """Hand-written voters plus lexicons and word beginnings mined from labelled rows."""
    voters = Voters({k: frozenset(v) for k, v in LEXICONS.items()}, {}, dict(PATTERNS))
    telling = mined[mined["pos"] >= MIN_SUPPORT] if len(mined) else mined
    words = [f for f in telling["feature"] if not f.endswith("*")]
    for k in range(MINED_LEXICONS):
        if part := words[k::MINED_LEXICONS]:
            voters.lexicons[f"mined_words_{k}"] = frozenset(part)
    for f in telling["feature"]:
        start = f[:-1]
        if f.endswith("*") and len(voters.beginnings) < MINED_PATTERNS \
                and not any(start.startswith(b) for b in voters.beginnings.values()):
            voters.beginnings[f"starts_{start}"] = start
    return voters


@dataclass
class LabelModel:
    """P(class), and for every voter P(vote | class, parent's vote); parent -1: none."""

    prior: float
    parent: np.ndarray
    table: np.ndarray  # voter x class x parent's vote -> probability of a vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(votes), 1))
        for j, p in enumerate(self.parent):
            given = votes[:, p] if p >= 0 else np.zeros(len(votes), dtype=int)
            for y in (0, 1):
                q = self.table[j, y][given]
                log[:, y] += np.where(votes[:, j] == 1, np.log(q), np.log1p(-q))
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -60, 60)))


def _estimate(votes: np.ndarray, weight: np.ndarray, parent: np.ndarray) -> np.ndarray:
    out = np.zeros((votes.shape[1], 2, 2))
    for y, w in enumerate((1 - weight, weight)):
        for j, p in enumerate(parent):
            base = (w @ votes[:, j] + 0.5 * 0.1) / (w.sum() + 0.5)
            for v in (0, 1):
                use = w if p < 0 else w * (votes[:, p] == v)
                out[j, y, v] = (use @ votes[:, j] + 2.0 * base) / (use.sum() + 2.0)
    return np.clip(out, 1e-4, 1 - 1e-4)


def _correlations(votes: np.ndarray, weight: np.ndarray, least: float = 0.05) -> np.ndarray:
    """A spanning forest of voters over their strongest correlations given the class."""
    m = votes.shape[1]
    strength = np.zeros((m, m))
    for w in (1 - weight, weight):
        total = w.sum()
        if total < 1:
            continue
        centred = votes - (w @ votes) / total
        cov = (centred * w[:, None]).T @ centred / total
        sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
        strength = np.maximum(strength, np.abs(cov) / np.outer(sd, sd))
    np.fill_diagonal(strength, 0)
    parent, inside = np.full(m, -1), np.zeros(m, dtype=bool)
    best, source = np.zeros(m), np.full(m, -1)
    for _ in range(m):  # Prim's algorithm; an edge below ``least`` starts a new tree
        j = int(np.argmax(np.where(inside, -1.0, best)))
        inside[j] = True
        if best[j] >= least:
            parent[j] = source[j]
        closer = ~inside & (strength[j] > best)
        best[closer], source[closer] = strength[j][closer], j
    return parent


def fit_label_model(votes: np.ndarray, rounds: int = 30) -> LabelModel:
    """EM: first with independent voters, then with the correlations found under that posterior."""
    votes = np.asarray(votes, dtype=int)
    weight = np.clip(votes.sum(axis=1) * 0.45 + 0.02, 0.02, 0.95)
    parent = np.full(votes.shape[1], -1)
    for phase in range(2):
        if phase:
            parent = _correlations(votes, weight)
        for _ in range(rounds):
            model = LabelModel(float(np.clip(weight.mean(), 1e-3, 0.5)), parent, _estimate(votes, weight, parent))
            weight = model.posterior(votes)
    return model


@dataclass
class Classifier:
    weights: dict[str, float]
    bias: float

    def score(self, text: str | None, memo: dict[str, tuple[str, ...]]) -> float:
        """Probability of toxicity; ``memo`` keeps the known features of words seen before."""
        held: set[str] = set()
        for w in words_of(text):
            known = memo.get(w)
            if known is None:
                known = memo[w] = tuple(f for f in features_of(w) if f in self.weights)
            if known:
                held.update(known)
        z = self.bias + math.fsum(self.weights[f] for f in held)
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def train_linear(rows: list[np.ndarray], target: np.ndarray, n_features: int, epochs: int = 300,
                 l2: float = 2e-4, support: float = 25.0) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets over sets of features (full-batch Adam, balanced classes).

    The ridge penalty of a feature falls with the rows that hold it: a rare word's weight stays
    small, a cue seen in more than ``support`` rows may decide on its own.
    """
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate(rows) if len(rows) else np.zeros(0, dtype=int)
    at = np.repeat(np.arange(len(rows)), lengths)
    balance = np.where(target >= 0.5, 0.5 / max((target >= 0.5).mean(), 1e-3), 0.5 / max((target < 0.5).mean(), 1e-3))
    balance /= balance.mean()
    ridge = l2 * support / np.maximum(np.bincount(cols, minlength=n_features), 1)
    w, b = np.zeros(n_features), 0.0
    m, v = np.zeros(n_features + 1), np.zeros(n_features + 1)
    for step in range(1, epochs + 1):
        z = np.bincount(at, w[cols], minlength=len(rows)) + b
        err = balance * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - target) / len(rows)
        grad = np.append(np.bincount(cols, err[at], minlength=n_features) + ridge * w, err.sum())
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        step_by = 0.15 * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.99 ** step)) + 1e-8)
        w, b = w - step_by[:-1], b - step_by[-1]
    return w, float(b)


@dataclass
class ToxicityModel:
    voters: Voters
    label_model: LabelModel
    classifier: Classifier


def _hand_written() -> ToxicityModel:
    """No usable labels: every hand-written word is one cue of equal weight."""
    voters = build_voters(pd.DataFrame({"feature": [], "pos": [], "neg": []}))
    m = len(voters.names)
    model = LabelModel(0.1, np.full(m, -1), np.tile(np.array([[0.01, 0.01], [0.5, 0.5]]), (m, 1, 1)))
    return ToxicityModel(voters, model, Classifier({w: 4.0 for v in LEXICONS.values() for w in v}, -2.5))


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    marks = (labels.select("doc_id", "toxic").dropna().filter(training_fold())
             .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")))
    marks = hashed_sample(marks, "doc_id", max_labelled)
    # one row per labelled id (the least of its texts), so the bound on ids bounds the rows that are fitted on
    rows = (docs.select("doc_id", "text").join(F.broadcast(marks), "doc_id")
            .groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).select("text", "toxic"))
    mined = mine_features(rows)
    if mined.empty:
        return _hand_written()
    voters = build_voters(mined)
    features = {f: k for k, f in enumerate(mined["feature"])}

    @F.pandas_udf("struct<votes:array<int>,held:array<int>>")
    def observe(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            votes = [voters.votes(t) for t in texts]
            held = [sorted({features[f] for w in words_of(t) for f in features_of(w) if f in features}) for t in texts]
            yield pd.DataFrame({"votes": votes, "held": held})

    seen = rows.select("toxic", observe("text").alias("o")).select("toxic", "o.votes", "o.held").toPandas()
    votes = np.column_stack([np.vstack(seen["votes"].to_list()), seen["toxic"].to_numpy(dtype=int)])
    label_model = fit_label_model(votes)  # the last voter is the annotator
    posterior = label_model.posterior(votes)
    w, b = train_linear([np.asarray(h, dtype=int) for h in seen["held"]], posterior, len(features),
                        support=SUPPORT_SHARE * float(posterior.sum()))
    weights = {f: float(w[k]) for f, k in features.items() if abs(w[k]) > 1e-6}
    return ToxicityModel(voters, label_model, Classifier(weights, b))


def score_column(model: ToxicityModel, text: str = "text") -> Column:
    classifier = model.classifier

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        memo: dict[str, tuple[str, ...]] = {}
        for texts in batches:
            scores = np.empty(len(texts))
            for k, t in enumerate(texts):
                if len(memo) > MEMO_WORDS:
                    memo.clear()
                scores[k] = classifier.score(t, memo)
            yield pd.Series(scores)

    return score(F.col(text))


def toxicity_report(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    return (docs.select("doc_id", F.coalesce(~training_fold(), F.lit(False)).alias("held_out"), score_column(model).alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """``docs`` without the rows that score at or over the threshold; columns as they were."""
    (s,) = fresh(docs.columns, "_score")
    return docs.withColumn(s, score_column(model)).filter(F.col(s) < THRESHOLD).select(*docs.columns)


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_report(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
