"""Quality by positive-unlabelled learning: an additive model of binned statistics of the text that minimises the
non-negative unbiased risk, from trusted positives, all texts of the corpus as the unlabelled ones, and an estimated
share of positives among them.

One pass reads the texts: each becomes one cell, the combination of its bins. There are (len(CUTS) + 1) ** len(STATISTICS)
cells at most, whatever the corpus, so the risk over all of it, and the class prior, come exactly from one count a cell.
The first statistic is how usual the text's character trigrams are among the trusted positives."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample, codepoints, descend, materialize, sigmoid, spread, table, word_hashes

STATISTICS = ("trigrams", "capitals", "signs", "digits", "breaks", "distinct", "letters")
#: Shares of the positives by which a statistic is cut into bins: what hardly any positive shows has a bin of its own.
CUTS = (0.002, 0.02, 0.1, 0.5, 0.9, 0.98, 0.998)
BINS = len(CUTS) + 1
PLACE = BINS ** np.arange(len(STATISTICS))


@dataclass(frozen=True)
class QualityParams:
    #: Bound of the sample of labelled rows, by keyed hash of doc_id.
    positives: int = 2000
    bits: int = 18
    l2: float = 1e-4
    steps: int = 400
    rate: float = 0.05
    delta: float = 0.1
    #: Parts of the positives for the class prior: a part is ranked by what the others say.
    folds: int = 5
    seed: int = 29


@dataclass
class Statistics:
    """What the positives say: log shares of them that have a trigram, and the edges of the bins."""

    usual: np.ndarray
    edges: np.ndarray

    def cell(self, text: str | None) -> int | None:
        if text is None:
            return None
        return int((PLACE * (statistics(text, self.usual)[:, None] > self.edges).sum(1)).sum())


@dataclass
class QualityModel:
    """A text scores the sum of its bins' weights and the bias; at 0, where the risk puts the boundary, it is kept."""

    of: Statistics | None
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, text: str | None) -> float | None:
        if text is None:
            return None
        return 1.0 if self.of is None else float(self.weights[_columns(np.array([self.of.cell(text)]))].sum() + self.bias)


def trigrams(low: np.ndarray, bits: int) -> np.ndarray:
    """A slot for each trigram of the code points of a lower-cased text."""
    h = (low[:-2] * np.uint32(0x9E3779B1) + low[1:-1]) * np.uint32(0x85EBCA6B) + low[2:]
    return ((h ^ (h >> np.uint32(15))) * np.uint32(2654435769) >> np.uint32(32 - bits)).astype(np.int64)


def statistics(text: str, usual: np.ndarray) -> np.ndarray:
    """The mean of the log shares of the text's trigrams; capitals among letters; shares of signs, of digits and of line
    breaks; distinct words against the square root of all, which hardly depends on length; letters a word."""
    c, low, words = codepoints(text), codepoints(text.lower()), word_hashes(text)
    n, many = max(len(c), 1), max(len(words), 1)
    space = ((c == 32) | (c == 10) | (c == 9) | (c == 13)).sum()
    letters = ((c > 64) & ((c < 91) | (c > 96)) & ((c < 123) | (c > 191))).sum()
    digits = ((c > 47) & (c < 58)).sum()
    capitals = (c != low).sum() if len(c) == len(low) else 0
    mean = usual[trigrams(low, len(usual).bit_length() - 1)].mean(dtype=np.float64) if len(low) > 2 else 0.0
    return np.array([mean, capitals / max(letters, 1), (n - space - letters - digits) / n, digits / n, (c == 10).sum() / n, len(np.unique(words)) / np.sqrt(many), letters / many])


def learn_statistics(positive: list[str], bits: int) -> tuple[Statistics, np.ndarray]:
    """(Statistics, cell of each positive). A positive's own trigrams don't count for itself."""
    count = np.zeros(1 << bits)
    for text in positive:
        low = codepoints(text.lower())
        if len(low) > 2:
            count[np.unique(trigrams(low, bits))] += 1
    without = np.log((np.maximum(count - 1, 0) + 0.5) / max(len(positive), 1)).astype(np.float32)
    stats = np.array([statistics(t, without) for t in positive])
    edges = np.quantile(stats, CUTS, axis=0).T
    return Statistics(np.log((count + 0.5) / (len(positive) + 1)).astype(np.float32), edges), ((stats[:, :, None] > edges).sum(2) * PLACE).sum(1)


def _columns(cells: np.ndarray) -> np.ndarray:
    """The weight that each statistic of a cell has."""
    return cells[:, None] // PLACE % BINS + np.arange(len(STATISTICS)) * BINS


def _best_bin(q_p: np.ndarray, q_u: np.ndarray, n_p: float, n_u: float, delta: float) -> float:
    """The least ratio of the shares of unlabelled and of positive scores above a cut, the cut chosen by an upper bound of
    that ratio that holds with probability 1 - delta."""
    slack = np.sqrt(np.log(4 / delta) / (2 * n_u)) + np.sqrt(np.log(4 / delta) / (2 * n_p))
    at = int(np.argmin((q_u + slack) / np.maximum(q_p, 1e-9)))
    return float(np.clip(q_u[at] / max(q_p[at], 1e-9), 0.01, 0.99))


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float) -> float:
    """The best-bin estimate of the share of positives, from scores of held-out positives and of unlabelled texts."""
    if not len(positive) or not len(unlabelled):
        return 0.5
    cuts = np.unique(positive)
    above = lambda x: 1 - np.searchsorted(np.sort(x), cuts, side="left") / len(x)
    return _best_bin(above(positive), above(unlabelled), len(positive), len(unlabelled), delta)


def _prior_of_cells(columns: np.ndarray, positive: np.ndarray, n_u: np.ndarray, params: QualityParams) -> float:
    """The same over the cells of a corpus: cells are ranked by the naive Bayes ratio of their bins, learnt from the other
    folds of the positives, and a positive counts by the share of the corpus that ranks as high."""
    u = n_u / n_u.sum()
    share = lambda x: np.bincount(columns.ravel(), weights=np.repeat(x, columns.shape[1]), minlength=len(STATISTICS) * BINS)
    of_u, fold, placed = share(u), np.arange(len(positive)) % params.folds, np.zeros(len(positive))
    for f in range(params.folds):
        p = np.bincount(positive[fold != f], minlength=len(u)) / max((fold != f).sum(), 1)
        ranks = np.log((share(p) + 1e-3) / (of_u + 1e-3))[columns].sum(1)
        order = np.argsort(ranks, kind="stable")
        below = np.r_[0, np.cumsum(u[order])][np.searchsorted(ranks[order], ranks[positive[fold == f]], side="left")]
        placed[fold == f] = 1 - below
    q_u = np.sort(placed)
    return _best_bin(np.searchsorted(q_u, q_u, side="right") / len(q_u), q_u, len(q_u), n_u.sum(), params.delta)


def nn_pu(columns: np.ndarray, p: np.ndarray, u: np.ndarray, prior: float, params: QualityParams) -> np.ndarray:
    """Weights and bias, from zero, for cells with shares p of the positives and u of the unlabelled. Sigmoid loss
    l(z) = 1 / (1 + e**z): prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]); where the second part is negative
    its gradient is ascended instead."""
    many = len(STATISTICS) * BINS

    def back(g: np.ndarray) -> np.ndarray:
        return np.append(np.bincount(columns.ravel(), weights=np.repeat(g, columns.shape[1]), minlength=many), g.sum())

    def gradient(w: np.ndarray) -> np.ndarray:
        s = sigmoid(w[columns].sum(1) + w[-1])
        slope = s * (1 - s)
        second, decay = back((u - prior * p) * slope), params.l2 * np.append(w[:-1], 0)
        return (-second if (u * s).sum() < prior * (p * s).sum() else second - prior * back(p * slope)) + decay

    return descend(gradient, many + 1, params.steps, params.rate)


def fit_cells(of: Statistics, positive: np.ndarray, cells: np.ndarray, counts: np.ndarray, params: QualityParams) -> QualityModel:
    """From the cells of the positives and the count of each cell of the corpus."""
    cells, inverse = np.unique(np.r_[cells, positive], return_inverse=True)
    n_u = np.bincount(inverse[: len(counts)], weights=counts, minlength=len(cells))
    own = inverse[len(counts) :]
    columns = _columns(cells)
    prior = _prior_of_cells(columns, own, n_u, params)
    w = nn_pu(columns, np.bincount(own, minlength=len(cells)) / len(own), n_u / n_u.sum(), prior, params)
    return QualityModel(of, w[:-1], float(w[-1]), prior)


def _keep_all() -> QualityModel:
    return QualityModel(None, np.zeros(len(STATISTICS) * BINS), 1.0, 0.5)


def fit(positive: list[str], unlabelled: list[str], params: QualityParams = QualityParams()) -> QualityModel:
    """The same on lists of texts. With fewer than four texts on a side everything is kept."""
    if len(positive) < 4 or len(unlabelled) < 4:
        return _keep_all()
    of, own = learn_statistics(positive, params.bits)
    cells, counts = np.unique([of.cell(t) for t in unlabelled], return_counts=True)
    return fit_cells(of, own, cells, counts, params)


def _positives(docs: DataFrame, labels: DataFrame, params: QualityParams) -> list[str]:
    """Texts of rows labelled quality 1 (if all labels of a doc_id agree), at most params.positives."""
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_y")).where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.min("_y").alias("_y")).where("_y > 0").select("_id")
    ids = F.broadcast(bounded_sample(known, ["_id"], params.positives, params.seed))  # at most so many ids
    slim = docs.select(F.col("doc_id").alias("_id"), F.col("text").alias("_t")).where("_t IS NOT NULL")
    found = slim.join(ids, "_id").groupBy("_id").agg(F.min("_t").alias("_t"))
    return [r["_t"] for r in sorted(found.collect(), key=lambda r: r["_id"])]


def _cells(docs: DataFrame, of: Statistics) -> DataFrame:
    """(doc_id, cell) of every row of docs, written to the shared folder; null for a null text."""
    held = docs.sparkSession.sparkContext.broadcast(of)  # 2**bits floats, whatever the corpus

    @F.pandas_udf("bigint")
    def cell(texts: pd.Series) -> pd.Series:
        return pd.Series([held.value.cell(t) for t in texts], dtype="Int64")

    return materialize(spread(docs.select("doc_id", "text")).select("doc_id", cell("text").alias("cell")), "quality-cells")


def _fitted(docs: DataFrame, labels: DataFrame, params: QualityParams) -> tuple[QualityModel, DataFrame | None]:
    positive = _positives(docs, labels, params)
    if len(positive) < 4:
        return _keep_all(), None
    of, own = learn_statistics(positive, params.bits)
    rows = _cells(docs, of)
    counted = rows.where("cell IS NOT NULL").groupBy("cell").count().toPandas()  # at most BINS ** len(STATISTICS) rows
    if counted["count"].sum() < 4:
        return _keep_all(), rows
    counted = counted.sort_values("cell")
    return fit_cells(of, own, counted["cell"].to_numpy(np.int64), counted["count"].to_numpy(np.float64), params), rows


def train(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> QualityModel:
    """Trusted positives are a bounded sample of labelled rows; the unlabelled side is every row of docs with a text, and
    so are the statistics, the prior and the risk. Null ids, labels and texts are left out."""
    return _fitted(docs, labels, params)[0]


def score_column(model: QualityModel, cell: Column) -> Column:
    """The score of a cell: one weight a statistic, looked up in the JVM."""
    total = F.lit(float(model.bias))
    for k in range(len(STATISTICS)):
        bins = F.array(*[F.lit(float(w)) for w in model.weights[k * BINS : (k + 1) * BINS]])
        total = total + F.get(bins, (F.floor(cell / F.lit(int(PLACE[k]))) % BINS).cast("int"))
    return total


def classify(docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams()) -> DataFrame:
    """(doc_id, score, keep) for every row of docs, repeated rows and null ids included.

    A null text has score null and isn't kept; an empty one is scored by its (zero) statistics; whole texts count,
    however long. A tie at 0 is kept. With fewer than four positives or texts everything but null texts is kept. Other
    columns are ignored; empty tables give an empty result."""
    model, rows = _fitted(docs, labels, params)
    if model.of is None or rows is None:
        scored = docs.select("doc_id", F.when(F.col("text").isNotNull(), F.lit(1.0)).alias("score"))
    else:
        scored = rows.select("doc_id", score_column(model, F.col("cell")).alias("score"))
    return scored.select("doc_id", "score", F.coalesce(F.col("score") >= 0, F.lit(False)).alias("keep"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op7_quality": op7_quality}
ORACLE: dict[str, str] = {}
