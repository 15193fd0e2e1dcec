"""Operator 10, toxicity: a linear classifier on character n-grams whose features are scaled by naive Bayes
log-count ratios. A text's features are the presence of its hashed n-grams, times the ratio; logistic regression
finds the weights. Learnt on the driver from a bounded sample of labelled rows; scored on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeleaf.llm.common import id_fold
from lakeleaf.llm.ngrams import codes, hashed


@dataclass(frozen=True)
class Settings:
    lengths: tuple[int, ...] = (4, 5, 6)
    bits: int = 20
    #: Bounds of the training sample: rows of each class, and characters of each class's rows.
    rows_per_class: int = 3000
    chars_per_class: int = 10_000_000
    #: An n-gram counts if so many sampled texts have it and its ratio is so far from 0.
    least_texts: int = 3
    least_ratio: float = 1.5
    smoothing: float = 1.0
    ridge: float = 0.03
    steps: int = 600


@dataclass
class Model:
    """weights: of each n-gram bucket, the ratio included."""

    weights: np.ndarray
    bias: float
    settings: Settings

    def score(self, text: str) -> float:
        total = self.bias
        found = [b[self.weights[b] != 0] for b in hashed(codes(text), self.settings.lengths, self.settings.bits)]
        if found:
            total += float(self.weights[np.unique(np.concatenate(found))].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(40.0, max(-40.0, total)))))


def fit(texts: list[str], toxic: list[int], settings: Settings = Settings()) -> Model:
    """With one class only, or nothing to learn from, every text gets the same score: near that class, else near 0."""
    size, y = 1 << settings.bits, np.asarray(toxic, dtype=np.float64)
    weights = np.zeros(size, dtype=np.float32)
    if not 0 < y.sum() < len(y):
        return Model(weights, 7.0 if y.sum() else -7.0, settings)

    def present(text: str) -> np.ndarray:
        found = hashed(codes(text), settings.lengths, settings.bits)
        return np.unique(np.concatenate(found)) if found else np.empty(0, np.uint32)

    # Twice over the texts, so that the driver never holds all their n-grams.
    counts = np.full((2, size), settings.smoothing, dtype=np.float32)
    for text, label in zip(texts, toxic):
        counts[label][present(text)] += 1
    enough = counts[0] + counts[1] >= settings.least_texts + 2 * settings.smoothing
    # Shares of texts, not of n-grams: an n-gram that is as common in either class has ratio 0 whatever their lengths.
    ratio = np.log(counts[1] / (y.sum() + settings.smoothing)) - np.log(counts[0] / (len(y) - y.sum() + settings.smoothing))
    ratio[~enough | (abs(ratio) < settings.least_ratio)] = 0
    chosen = np.flatnonzero(ratio)
    place = np.full(size, -1, dtype=np.int32)
    place[chosen] = np.arange(len(chosen))
    rows = [p[p >= 0] for p in (place[present(t)] for t in texts)]
    cols = np.concatenate(rows) if rows else np.empty(0, np.int32)
    owner = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    scale = ratio[chosen]
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (len(y) - y.sum()))  # both classes weigh alike
    w, b = np.zeros(len(chosen)), 0.0
    at_w, at_b, momentum = w.copy(), b, 1.0
    norms = np.bincount(owner, weights=scale[cols] ** 2, minlength=len(rows)) + 1
    rate = 1 / (0.25 * float((each * norms).sum()) + settings.ridge / len(y))
    for _ in range(settings.steps):  # accelerated gradient descent
        z = np.bincount(owner, weights=(at_w * scale)[cols], minlength=len(rows)) + at_b
        gap = each * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y)
        next_w = at_w - rate * (np.bincount(cols, weights=gap[owner], minlength=len(chosen)) * scale + settings.ridge / len(y) * at_w)
        next_b = at_b - rate * float(gap.sum())
        after = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        at_w, at_b = next_w + (momentum - 1) / after * (next_w - w), next_b + (momentum - 1) / after * (next_b - b)
        w, b, momentum = next_w, next_b, after
    weights[chosen] = w * scale
    return Model(weights, b, settings)


def train(docs: DataFrame, labels: DataFrame, learn: Column, settings: Settings = Settings()) -> Model:
    """Learn from the labelled rows (labels.toxic 0 or 1) of ``docs`` for which ``learn`` (of doc_id) holds.

    Of each class the ``rows_per_class`` rows with the smallest hash of doc_id are taken, and of these, in the order
    of the hash, each that the class's ``chars_per_class`` leaves room for (its first one anyhow). Rows with a null id,
    text or label take no part.
    """
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("doc_id is not null and toxic in (0, 1)").filter(learn)
    taken = known.filter("toxic = 1").orderBy(*order).limit(settings.rows_per_class).unionByName(known.filter("toxic = 0").orderBy(*order).limit(settings.rows_per_class))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    rows = texts.join(F.broadcast(taken), "doc_id").select("text", "toxic", order[0].alias("place"), "doc_id").orderBy("place", "doc_id", "text")
    sample, chars = [], {}
    for r in rows.toLocalIterator():
        used = chars.get(r["toxic"])
        if used is None or used + len(r["text"]) <= settings.chars_per_class:
            chars[r["toxic"]] = (used or 0) + len(r["text"])
            sample.append((r["text"], r["toxic"]))
    return fit([t for t, _ in sample], [x for _, x in sample], settings)


def score_of(docs: DataFrame, model: Model, text: str) -> Column:
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sent.value.score(t or "")).astype("float64")

    return score(docs[text])


def toxicity(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns ``keep`` (none of them named as these two) with score (0 to 1) and predicted (1 if score >= 0.5);
    one row per input row.

    A null text counts as empty and gets the score of a text without known n-grams. Very long texts are scored whole.
    Order, repeats and other columns don't matter; an empty table gives an empty result.
    """
    scored = docs.select(*keep, score_of(docs, model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows with a score under 0.5, with all their columns, whatever their names; null and empty texts are scored
    as empty ones."""
    wide = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), score_of(docs, model, text).alias("score"))
    return wide.filter("score < 0.5").select("row.*")


def toxicity_folds(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Score every row; learn only where crc32(doc_id as text) mod 5 is not 0: doc_id, held_out, score, predicted."""
    model = train(docs, labels, id_fold("doc_id", 5) != 0, settings)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = toxicity(rows, model)
    return scored.select("doc_id", (id_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
