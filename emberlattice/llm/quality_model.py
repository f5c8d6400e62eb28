"""Quality classifier: positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlattice.llm.common import fraction_of, let, text_of, words_of

FEATURES = ("log_words", "word_length", "symbols", "pipes", "capitals", "digits", "exclamations", "stops", "distinct_words",
            "distinct_lines", "line_words", "other", "vocabulary", "log_distinct")


def features_of(text: Column) -> Column:
    """Shape features of a whole text, an array in the order of ``FEATURES``; zeros for a blank one.

    Only the text enters: counts of characters, words and lines, as shares between 0 and 1 (roots of the
    rare ones) or logs.
    """
    def count(pattern):
        return F.regexp_count(text, F.lit(pattern))

    def measure(words):
        n = F.size(words)
        chars = F.greatest(F.length(F.array_join(words, "")), F.lit(1)).cast("double")
        lines = F.split(text, "\n", -1)
        share = F.size(F.array_distinct(words)) / n
        rare = [F.sqrt(count(c) / chars) for c in ("[#*$%&<>]", "[|]", "[A-Z]", "[0-9]", "!")]
        return F.when(n > 0, F.array(
            F.log1p(n), F.log1p(chars / n), *rare, count("[.]") / n, share, F.size(F.array_distinct(lines)) / F.size(lines),
            F.log1p(n / F.size(lines)), count("[^A-Za-z\\x20\\x09-\\x0D]") / chars, share * F.log1p(n), F.log(share + 0.02))
        ).otherwise(F.array(*[F.lit(0.0)] * len(FEATURES)))

    return let(words_of(text), measure)


@dataclass(frozen=True)
class PuModel:
    """Standardised features under a logistic function."""

    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    bias: float
    prior: float

    def score(self, features: Column) -> Column:
        k = len(self.centre)

        def total(x):
            z = F.lit(self.bias)
            for i in range(k):
                u = F.least(F.greatest((x[i] - F.lit(self.centre[i])) / F.lit(self.scale[i]), F.lit(-6.0)), F.lit(6.0))
                z = z + u * F.lit(self.weights[i])
            return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))

        return let(features, total)


def standardised(x: np.ndarray, centre, scale) -> np.ndarray:
    return np.clip((x - centre) / scale, -6.0, 6.0)


def fit_nnpu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 1500, rate: float = 0.05,
             penalty: float = 1e-4) -> PuModel:
    """Minimise pi*E_p[l(g)] + max(0, E_u[l(-g)] - pi*E_p[l(-g)]) with the logistic loss, by Adam.

    When the second term is negative, the step goes against its gradient, as the non-negative estimator
    asks. Without positives or unlabelled rows the model is the prior alone.
    """
    if not len(positive) or not len(unlabelled):
        k = len(FEATURES)
        return PuModel((0.0,) * k, (1.0,) * k, (0.0,) * k, float(np.log(prior / (1 - prior))), prior)
    centre, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-6
    xp, xu = standardised(positive, centre, scale), standardised(unlabelled, centre, scale)
    w, b = np.zeros(xp.shape[1]), 0.0
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1.0 / (1.0 + np.exp(-np.clip(z, -40, 40)))
    for t in range(1, steps + 1):
        sp, su = sigmoid(xp @ w + b), sigmoid(xu @ w + b)
        negative = np.mean(-np.log1p(-np.clip(su, 0, 1 - 1e-12))) - prior * np.mean(-np.log1p(-np.clip(sp, 0, 1 - 1e-12)))

        def slope(weight_p, weight_u):
            return np.append(xp.T @ weight_p / len(xp) + xu.T @ weight_u / len(xu), weight_p.mean() + weight_u.mean())

        rest = slope(-prior * sp, su)
        grad = slope(prior * (sp - 1), np.zeros(len(xu))) + rest if negative >= 0 else -rest
        grad[:-1] += penalty * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return PuModel(tuple(map(float, centre)), tuple(map(float, scale)), tuple(map(float, w)), float(b), prior)


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, least_share: float = 0.2) -> float:
    """The share of positives among the unlabelled rows, from these two samples alone.

    Any set holds at least prior * (its share of the positives) of the unlabelled rows, so the smallest ratio of the
    two shares bounds the prior, and meets it for a set without negatives. The sets are the rows above a score of
    a model of one half of the samples, taken over the other half; they hold ``least_share`` of its
    positives or more, so that no ratio rests on few rows. The result lies between 0.01 and 0.99; 0.5 without rows.
    """
    if len(positive) < 20 or len(unlabelled) < 20:
        return 0.5
    model = fit_nnpu(positive[::2], unlabelled[::2], 0.5, steps=500)
    line = lambda x: standardised(x, np.array(model.centre), np.array(model.scale)) @ np.array(model.weights)
    sp, su = np.sort(line(positive[1::2])), np.sort(line(unlabelled[1::2]))
    cuts = sp[:int(len(sp) * (1 - least_share)) + 1]
    share_p = 1 - np.searchsorted(sp, cuts) / len(sp)
    share_u = 1 - np.searchsorted(su, cuts) / len(su)
    return float(np.clip(np.min(share_u / share_p), 0.01, 0.99))


def held_out(key: Column) -> Column:
    """The fold kept for evaluation: crc32 of the key's text divisible by 5; null counts as empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000,
                  prior: float | None = None) -> PuModel:
    """Fit on at most about ``sample`` trusted positives and twice as many unlabelled documents.

    Positives are training-fold documents with label 1 (a document with several label rows needs 1 in
    all). The unlabelled side is a stable draw from the training fold. The class prior is estimated from these two
    (``estimate_prior``), unless given: rows with label 0 are never used. Rows that repeat a document count each.
    """
    keyed = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    keyed = keyed.groupBy("doc_id").agg(F.min(label).alias("label"))
    ones = keyed.where(F.col("label") == 1).count()
    training = docs.where(~held_out(F.col("doc_id"))).select("doc_id", "text")
    total = training.count()

    def rows(df):
        found = df.select(features_of(text_of()).alias("x")).toPandas()["x"]
        return np.array(found.tolist(), dtype=float).reshape(-1, len(FEATURES))

    # At most about ``sample`` identifiers: bounded by the parameter, whatever the tables hold.
    chosen = keyed.where(F.col("label") == 1).where(fraction_of("positive", F.col("doc_id")) < sample / max(ones, 1)).select("doc_id")
    positive = rows(training.join(F.broadcast(chosen), "doc_id", "left_semi"))
    unlabelled = rows(training.where(fraction_of("unlabelled", F.col("doc_id")) < 2 * sample / max(total, 1)))
    return fit_nnpu(positive, unlabelled, estimate_prior(positive, unlabelled) if prior is None else prior)


def score_quality(docs: DataFrame, model: PuModel, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """Add ``score`` and ``predicted`` (1 at ``threshold`` or more), row by row without a shuffle.

    Null text counts as empty; empty texts have a score too. Repeated rows each get theirs; input columns
    named score or predicted are replaced.
    """
    scored = docs.withColumn("score", model.score(features_of(text_of(text))))
    return scored.withColumn("predicted", F.when(F.col("score") >= threshold, 1).otherwise(0))


def keep_quality(docs: DataFrame, model: PuModel, threshold: float = 0.3) -> DataFrame:
    """The documents that the classifier accepts (a score equal to the threshold too), with their own columns; null text is empty."""
    return docs.where(model.score(features_of(text_of())) >= threshold)


def op10_quality_classifier(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents by a model of the training fold; nulls, blanks, repeats and ties as in ``score_quality``."""
    model = train_quality(docs, labels)
    scored = score_quality(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
