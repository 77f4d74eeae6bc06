"""Sparse linear models over a bounded vocabulary of text features.

The sample a model is fitted on is bounded by a parameter of the caller, chosen by a
hash of the id, so it is the same on every run. Choosing features is Spark work:
counts by feature and label. Fitting runs on rows of feature numbers, whose size
is bounded by the sample, and scoring on all documents is a vectorised function.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, columns: list[str], rows: int, where: Column | None = None
) -> DataFrame:
    """(columns, y, weight) of at most ``rows`` labelled documents, half from each class.

    ``weight`` undoes the classes' rates. Several labels of one id count as the
    largest, null labels and ids as none. The sample of ids, 24 bytes a row and
    ``rows`` rows at most, is the broadcast side; texts are not shuffled.
    """
    known = labels.filter(f"doc_id is not null and {label} is not null")
    if where is not None:
        known = known.filter(where)
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    totals = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    chosen = None
    for y in (0, 1):
        part = known.filter(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows // 2)
        part = part.withColumn("weight", F.lit(max(1.0, totals.get(y, 0) / max(1, rows // 2))))
        chosen = part if chosen is None else chosen.unionByName(part)
    inputs = documents.select(*dict.fromkeys(["doc_id", *columns]))
    return inputs.join(F.broadcast(chosen), "doc_id").select(*columns, "y", "weight")


def choose_features(rows: DataFrame, size: int, least: int = 4) -> list[str]:
    """The ``size`` features that tell the labels apart best.

    ``rows`` has ``features`` (distinct per row) and ``y``. Ranked by the smoothed log
    odds over its standard error; features in fewer than ``least`` rows are left out.
    """
    totals = rows.agg(F.sum("y").alias("p"), F.count("*").alias("n")).first()
    p, n = (totals["p"] or 0) + 1.0, (totals["n"] or 0) - (totals["p"] or 0) + 1.0
    by_feature = (
        rows.select("y", F.explode("features").alias("feature"))
        .groupBy("feature")
        .agg(F.sum("y").alias("a"), F.count("*").alias("all"))
        .filter(F.col("all") >= least)
        .withColumn("b", F.col("all") - F.col("a"))
    )
    odds = F.log((F.col("a") + 0.5) / (p - F.col("a"))) - F.log((F.col("b") + 0.5) / (n - F.col("b")))
    rank = F.abs(odds) / F.sqrt(1 / (F.col("a") + 0.5) + 1 / (F.col("b") + 0.5))
    top = by_feature.orderBy(rank.desc(), "feature").limit(size).select("feature").collect()
    return sorted(r["feature"] for r in top)


class Sparse:
    """Rows of feature numbers; a product with weights sums each row's."""

    def __init__(self, rows: Iterable[Iterable[int]], width: int):
        rows = [np.asarray(list(r), np.int64) for r in rows]
        self.n, self.width = len(rows), width
        self.row = np.repeat(np.arange(self.n), [len(r) for r in rows])
        self.col = np.concatenate([np.empty(0, np.int64), *rows])

    def dot(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, w[self.col], self.n) if self.n else np.zeros(0)

    def back(self, g: np.ndarray) -> np.ndarray:
        return np.bincount(self.col, g[self.row], self.width)


def sigmoid(z):
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def fit_logistic(
    x: Sparse,
    y: np.ndarray,
    weight: np.ndarray,
    penalty: float = 1e-3,
    steps: int = 250,
    pairs: tuple[Sparse, Sparse] | None = None,
    pair_penalty: float = 0.0,
) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic regression, by full-batch Adam.

    ``pairs``: rows whose scores should agree; ``pair_penalty`` weighs the mean squared
    difference of their scores before the sigmoid.
    """
    w, b = np.zeros(x.width), 0.0
    if not x.n:
        return w, b
    share = weight / weight.sum()
    m, v = np.zeros(x.width + 1), np.zeros(x.width + 1)
    for t in range(1, steps + 1):
        err = (sigmoid(x.dot(w) + b) - y) * share
        g = np.append(x.back(err) + penalty * w, err.sum())
        if pairs is not None and pairs[0].n:
            gap = (pairs[0].dot(w) - pairs[1].dot(w)) * (2 * pair_penalty / pairs[0].n)
            g[:-1] += pairs[0].back(gap) - pairs[1].back(gap)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.1 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def numbered(features: Callable[[str], set], vocabulary: dict[str, int], text: str) -> list[int]:
    return sorted(vocabulary[f] for f in features(text) if f in vocabulary)
