"""Quality scores by regularised quadratic discriminant analysis.

Document statistics (character classes, word repetition, word and line lengths) are smoothed towards
typical values for short texts and log-transformed. Each class has a mean and a covariance
shrunk towards the pooled covariance and then towards a multiple of the identity; its Cholesky
factor is cached. The score is the logistic of the difference of the classes' Gaussian
log-densities (from Mahalanobis distances and log-determinants) plus the log prior odds.

Training takes a bounded sample of labelled rows, about TRAIN_ROWS of each class, by a hash of the id. Prior odds
and pooling weights are those of all labels, whatever the sample's size.

Defined results: null text counts as empty and is scored; labels that are null or repeated with both
values for an id are not learned from; with a class missing, every score is the share of class 1 (0.5
without labels); repeated rows are each scored, and of rows that repeat a labelled id the one of the smallest
statistics is learned from; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import frugal, held_out

TRAIN_ROWS = 6_000
ACCEPT = 0.7
POOLED = 0.1
RIDGE = 0.02
#: (name, share that is typical of prose): shares are smoothed with PRIOR units of it.
SHARES = (("symbol", 0.002), ("pipe", 0.001), ("bang", 0.001), ("upper", 0.03), ("digit", 0.005), ("repeat", 0.005), ("distinct", 0.9), ("stop", 0.1), ("comma", 0.05), ("line", 0.05))
PRIOR = 20.0
_CLASS = np.zeros(256, np.uint8)
for _chars, _n in ((b"#$%&*+<=>@\\^_`~{}[]", 1), (b"|", 2), (b"!", 3), (bytes(range(65, 91)), 4), (b"0123456789", 5), (b".?", 6), (b",;:", 7), (b"\n", 8), (b" \t\r\x0b\x0c", 9)):
    _CLASS[list(_chars)] = _n


def statistics(text: str | None) -> list[float]:
    """The transformed statistics of one whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = np.bincount(_CLASS[raw], minlength=10)
    letters = max(1, len(raw) - int(n[8]) - int(n[9]))
    words = text.split()
    w = len(words)
    repeats = sum(a == b for a, b in zip(words, words[1:]))
    windows = [words[i : i + 100] for i in range(0, w, 100)]
    distinct = sum(len(set(x)) for x in windows)
    counts = {"symbol": (n[1], letters), "pipe": (n[2], letters), "bang": (n[3], letters), "upper": (n[4], letters), "digit": (n[5], letters), "repeat": (repeats, w), "distinct": (distinct, w), "stop": (n[6], w), "comma": (n[7], w), "line": (n[8], w)}
    out = []
    for name, typical in SHARES:
        c, of = counts[name]
        p = (float(c) + PRIOR * typical) / (of + PRIOR)
        out.append(float(np.log(p / max(1e-6, 1 - p)) if name == "distinct" else np.log(p)))
    out.append(float(np.log((letters + 5 * PRIOR) / (w + PRIOR))))
    return out


class QuadraticDiscriminant:
    def __init__(self, x: np.ndarray, y: np.ndarray, counts: dict[int, int] | None = None):
        """counts: how many labels each class has in all, where x and y are a sample of them."""
        counts = counts or {k: int((y == k).sum()) for k in (0, 1)}
        total = sum(counts.values())
        weight = np.array([counts.get(k, 0) / max(1, total) for k in (0, 1)])
        self.constant = float(weight[1]) if total else 0.5
        self.fitted = len(y) > 0 and 0 < y.sum() < len(y) and weight.min() > 0
        if not self.fitted:
            return
        own = [x[y == k] for k in (0, 1)]
        self.shift = sum(w * g.mean(axis=0) for w, g in zip(weight, own))
        spread = sum(w * ((g - self.shift) ** 2).mean(axis=0) for w, g in zip(weight, own)) ** 0.5
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        groups = [(g - self.shift) / self.scale for g in own]
        mean = [g.mean(axis=0) for g in groups]
        covariance = [(g - m).T @ (g - m) / len(g) for g, m in zip(groups, mean)]
        pooled = sum(w * c for w, c in zip(weight, covariance))
        eye = np.eye(x.shape[1])
        self.mean, self.factor, self.logdet = mean, [], []
        for c in covariance:
            c = (1 - POOLED) * c + POOLED * pooled
            c = (1 - RIDGE) * c + RIDGE * max(1e-3, np.trace(c) / len(eye)) * eye
            low = np.linalg.cholesky(c)
            self.factor.append(np.linalg.inv(low))
            self.logdet.append(2 * np.log(np.diag(low)).sum())
        self.prior = float(np.log(weight[1] / weight[0]))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1 for each row of statistics."""
        if not self.fitted or not len(x):
            return np.full(len(x), self.constant)
        z = (x - self.shift) / self.scale
        d = [((z - m) @ f.T) ** 2 for m, f in zip(self.mean, self.factor)]
        log = [-0.5 * (q.sum(axis=1) + ld) for q, ld in zip(d, self.logdet)]
        return 1 / (1 + np.exp(-np.clip(log[1] - log[0] + self.prior, -60, 60)))


def _statistics(text: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in text], float).reshape(len(text), len(SHARES) + 1)


def train(docs: DataFrame, labels: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> QuadraticDiscriminant:
    """Learn from labelled rows where `learn`, of the column doc_id, holds; only the sample's statistics reach the driver."""
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(learn & F.col("y").isin(0, 1)).groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return QuadraticDiscriminant(np.empty((0, 0)), np.empty(0))
    share = {y: min(1.0, TRAIN_ROWS / n) for y, n in counts.items()}
    u = F.pmod(F.xxhash64("doc_id", F.lit("qda")), F.lit(1 << 40)) / float(1 << 40)
    drawn = known.where(u < F.when(F.col("y") == 1, F.lit(share.get(1, 0.0))).otherwise(F.lit(share.get(0, 0.0))))

    @F.pandas_udf("array<double>")
    def stats(text: pd.Series) -> pd.Series:
        return pd.Series(list(_statistics(text)))

    # The sample has about 2 * TRAIN_ROWS rows at most, whatever the input; rows that repeat an id are one before they leave their task.
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(drawn), "doc_id")
    rows = texts.select("doc_id", "y", stats("text").alias("x")).groupBy("doc_id").agg(F.max("y").alias("y"), F.min("x").alias("x")).select("y", "x").collect()
    rows.sort(key=lambda r: (r["y"], r["x"]))
    if not rows:
        return QuadraticDiscriminant(np.empty((0, 0)), np.empty(0), counts)
    return QuadraticDiscriminant(np.array([r["x"] for r in rows]), np.array([r["y"] for r in rows]), counts)


def quality_score(model: QuadraticDiscriminant, text_col: str) -> Column:
    @F.pandas_udf("double")
    @frugal
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series(model.score(_statistics(b)))

    return score(text_col)


def score_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """One row for each row of docs: doc_id, held_out, score, predicted."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), id_col, text_col, label_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), quality_score(model, text_col).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= ACCEPT).cast("int"))


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """The rows of docs that the classifier accepts."""
    model = train(docs, labels, ~held_out(F.col("doc_id")), id_col, text_col, label_col)
    return docs.where(quality_score(model, text_col) >= ACCEPT)
