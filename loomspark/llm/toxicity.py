"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NGrams, Rows, bounded_sample, descend, sigmoid, spread, table


@dataclass(frozen=True)
class ToxicityParams:
    low: int = 3
    high: int = 5
    bits: int = 20
    #: Bound of the labelled sample, for each class.
    sample_per_class: int = 1500
    #: The threshold comes from scores of models that haven't seen the row: each of so many parts is scored by a model of the rest.
    folds: int = 5
    alpha: float = 1.0
    l2: float = 1e-3
    steps: int = 120
    rate: float = 0.05
    #: A feature must occur in this share of the rows of a class (in 3 rows at least, fewer below 75 rows) and have a ratio beyond the floor.
    min_share: float = 0.0125
    ratio_floor: float = 0.5
    #: Few labels say little about where to cut: the threshold found is shrunk towards 0, the boundary of the balanced
    #: loss, as if so many more toxic rows had spoken for that.
    prior_rows: float = 50.0
    #: What a clean text taken for toxic costs in choosing the threshold, against a toxic one missed: clean texts are
    #: the many, and labels of toxic ones the noisier.
    false_positive_cost: float = 8.0
    seed: int = 11


@dataclass
class ToxicityModel:
    weights: np.ndarray
    bias: float
    threshold: float
    grams: NGrams
    held_out_recall: float
    held_out_false_positives: float


def fit(texts: list[str], toxic: np.ndarray, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Ratios r = log of the smoothed n-gram rates of toxic against clean texts; logistic loss over the presence
    features times r. The threshold has the fewest weighted errors over the scores of all rows, each by a model that was
    fitted without it (cross-validation), shrunk by prior_rows; the model that is returned is fitted on all rows. With fewer than four rows or
    only one class present nothing is toxic: weights 0, threshold infinite."""
    grams = NGrams(params.low, params.high, params.bits)
    y = np.asarray(toxic, float)
    if len(y) < 4 or y.min() == y.max():
        return ToxicityModel(np.zeros(1 << params.bits, np.float32), 0.0, float("inf"), grams, 0.0, 0.0)
    features = [grams.distinct(t).astype(np.int32) for t in texts]
    rng = np.random.default_rng(params.seed)
    fold = np.zeros(len(y), np.int64)
    for value in (0.0, 1.0):  # each part has its share of each class
        own = rng.permutation(np.flatnonzero(y == value))
        fold[own] = np.arange(len(own)) % params.folds
    z = np.zeros(len(y))
    for k in range(params.folds):
        held = fold == k
        weights, bias = _weights(features, y, ~held, params)
        for i in np.flatnonzero(held):
            z[i] = weights[features[i]].sum(dtype=np.float64) + bias
    threshold, recall, wrong = _threshold(z, y, params.false_positive_cost)
    threshold *= y.sum() / (y.sum() + params.prior_rows)
    weights, bias = _weights(features, y, np.ones(len(y), bool), params)
    return ToxicityModel(weights, bias, threshold, grams, recall, wrong)


def _weights(features: list[np.ndarray], y: np.ndarray, use: np.ndarray, params: ToxicityParams) -> tuple[np.ndarray, float]:
    """Weights (ratio times coefficient) and bias from the rows in use; zeros where they have one class only."""
    yt = y[use]
    if not len(yt) or yt.min() == yt.max():
        return np.zeros(1 << params.bits, np.float32), 0.0
    least = max(min(3, max(1, len(yt) // 25)), int(params.min_share * min(yt.sum(), len(yt) - yt.sum())))
    rows = Rows([features[i] for i in np.flatnonzero(use)], 1 << params.bits, least)
    p, q = rows.back(yt) + params.alpha, rows.back(1 - yt) + params.alpha
    r = np.log(p / p.sum()) - np.log(q / q.sum())
    rows.keep(np.abs(r) >= params.ratio_floor)
    r = r[np.abs(r) >= params.ratio_floor]
    share = np.where(yt > 0, 0.5 / max(yt.sum(), 1), 0.5 / max((1 - yt).sum(), 1))

    def gradient(w: np.ndarray) -> np.ndarray:
        g = (sigmoid(rows.dot(r * w[:-1]) + w[-1]) - yt) * share
        return np.append(r * rows.back(g) + params.l2 * w[:-1], g.sum())

    w = descend(gradient, len(rows.used) + 1, params.steps, params.rate)
    return rows.full(r * w[:-1]), float(w[-1])


def _threshold(z: np.ndarray, y: np.ndarray, cost: float) -> tuple[float, float, float]:
    """(cut of least weighted error, recall and false positives there); the middle of the range of equal cuts."""
    order = np.argsort(z)
    cuts = np.concatenate([[z[order[0]] - 1], (z[order][1:] + z[order][:-1]) / 2, [z[order[-1]] + 1]])
    # rows below the k-th cut are clean
    missed = np.concatenate([[0], np.cumsum(y[order])]) / max(y.sum(), 1)
    wrong = 1 - np.concatenate([[0], np.cumsum(1 - y[order])]) / max((1 - y).sum(), 1)
    total = missed + cost * wrong
    best = np.flatnonzero(total <= total.min() + 1e-12)
    at = best[len(best) // 2]
    return float(cuts[at]), float(1 - missed[at]), float(wrong[at])


def train(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Fit on a bounded sample of labelled rows: sample_per_class of each class, by keyed hash of doc_id.
    Rows with a null id, label or text are left out; a doc_id that repeats counts once, as toxic if any label says so."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    # candidates from the labels alone, so that the corpus is scanned once, for these ids
    picked = [bounded_sample(known.where(c), ["_id"], 2 * params.sample_per_class, params.seed) for c in (F.col("_y") > 0, F.col("_y") <= 0)]
    ids = F.broadcast(picked[0].unionByName(picked[1]))  # at most 4 * sample_per_class ids
    texts = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("_t IS NOT NULL").join(ids, "_id")
    found = texts.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y"))
    both = [bounded_sample(found.where(c), ["_id"], params.sample_per_class, params.seed) for c in (F.col("_y") > 0, F.col("_y") <= 0)]
    rows = sorted(both[0].unionByName(both[1]).collect(), key=lambda x: x["_id"])
    return fit([x["_t"] for x in rows], np.array([x["_y"] > 0 for x in rows]), params)


def score_column(spark: SparkSession, model: ToxicityModel, text):
    """Decision value minus threshold; above 0 is toxic. Null for a null text."""
    held = spark.sparkContext.broadcast((model.weights, model.bias - model.threshold, model.grams))  # 2**bits floats, whatever the corpus

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        weights, bias, grams = held.value
        return pd.Series([None if t is None else float(weights[grams.distinct(t)].sum(dtype=np.float64) + bias) for t in texts], dtype="float64")

    return score(text) if np.isfinite(model.threshold) else F.when(text.isNotNull(), F.lit(-1.0))


def classify(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """(doc_id, score, toxic) for every row of docs, repeated rows and null ids included.

    A null text has score null and toxic false; an empty one is scored by the bias alone. Ties at the threshold are
    clean. Other columns of docs are ignored. Empty tables give an empty result."""
    model = train(docs, labels, params)
    scored = spread(docs.select("doc_id", "text")).select("doc_id", score_column(docs.sparkSession, model, F.col("text")).alias("score"))
    return scored.select("doc_id", "score", F.coalesce(F.col("score") > 0, F.lit(False)).alias("toxic"))


def keep_clean(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams()) -> DataFrame:
    """The rows of docs, all columns as they are, whose text isn't toxic; null texts stay."""
    model = train(docs, labels, params)
    docs = spread(docs)
    score = score_column(docs.sparkSession, model, docs["text"])
    return docs.where(~F.coalesce(score > 0, F.lit(False)))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLE: dict[str, str] = {}
