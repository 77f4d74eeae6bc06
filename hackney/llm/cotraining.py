"""Quality scores by co-training of a text view and a metadata view.

The text view sees what the words look like: their shapes, repetition, lengths,
short words. The metadata view sees language, source, length and layout of the page, and
no word. Both start from the same labelled rows. In each round each view labels the
rows of an unlabelled pool that it is surest of, and hands them to the other. Then
each view is calibrated on labelled rows that no round has trained on, and the
calibrated views are combined by a small logistic model on the same rows.

What is fitted on is bounded: ``LABELLED`` labelled rows and ``POOL`` unlabelled rows,
chosen by a hash of the id. Features read whole texts, and all documents are scored.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import Sparse, choose_features, fit_logistic, labelled_sample, sigmoid
from .scratch import small_batches, stage
from .word_tokens import pieces
from .worker import release

LABELLED = 12_000
POOL = 8_000
ROUNDS = 3
VOCABULARY = 2048
#: Share of the pool that a view hands over in a round, and how sure it must be.
HANDED = 0.05
SURE = 0.95
THRESHOLD = 0.3
#: Words without repetition that a text is taken to have besides its own, so that
#: short texts show no share of repetition by chance.
SMOOTH = 50
COLUMNS = ("text", "lang", "source", "n_chars")

_SHAPE = np.arange(256, dtype=np.uint8)
_SHAPE[ord("A") : ord("Z") + 1] = ord("A")
_SHAPE[ord("a") : ord("z") + 1] = ord("a")
_SHAPE[128:] = ord("a")
_SHAPE[ord("0") : ord("9") + 1] = ord("9")


def level(x: float) -> int:
    """A share or size in steps of two; -99 for none."""
    return -99 if x <= 0 else round(math.log2(x))


def text_features(text: str | None) -> set[str]:
    """Content only; an empty text has its own feature. Repetition is counted in
    pieces of a megabyte, so a long text is never held as one list of words."""
    shapes, short = Counter(), set()
    n = distinct = windows = different = sentences = letters = 0
    for part in pieces((text or "").encode()):
        words = part.split()
        n += len(words)
        letters += sum(map(len, words))
        distinct += len(set(words))
        windows += max(0, len(words) - 2)
        different += len(set(zip(words, words[1:], words[2:], strict=False)))
        sentences += part.count(b".") + part.count(b"!") + part.count(b"?")
        short.update(w for w in set(words) if len(w) < 4)
        a = _SHAPE[np.frombuffer(part, np.uint8)]
        new = np.ones(len(a), bool)
        new[1:] = a[1:] != a[:-1]
        shapes.update(a[new].tobytes().split())
    if not n:
        return {"empty"}
    found = {f"s:{s.decode(errors='replace')[:12]}:{level(c / n)}" for s, c in shapes.items() if c * 64 >= n}
    found |= {f"w:{w.decode(errors='replace')}" for w in short}
    repeated = (windows - different) / (windows + SMOOTH)
    found |= {
        f"distinct:{round(10 * (distinct + SMOOTH) / (n + SMOOTH))}",
        f"repeated:{round(10 * repeated)}",
        f"sentence:{level(n / max(1, sentences))}",
        f"letters:{round(letters / n)}",
        f"words:{level(n)}",
    }
    return found


def meta_features(text: str | None, lang, source, n_chars) -> set[str]:
    """Language, source, length and layout; nulls are values of their own."""
    text = text or ""
    lines = text.count("\n") + 1
    size = -1 if n_chars is None or n_chars != n_chars else level(float(n_chars))
    return {
        f"lang:{lang}",
        f"source:{source}",
        f"size:{size}",
        f"lines:{level(lines)}",
        f"line:{level(len(text) / lines)}",
    }


@dataclass
class View:
    """A classifier of one view: weights by feature, intercept, calibration."""

    numbers: dict[str, int]
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    intercept: float = 0.0
    scale: float = 1.0
    shift: float = 0.0

    def encode(self, rows: list) -> Sparse:
        return Sparse([[self.numbers[f] for f in r if f in self.numbers] for r in rows], len(self.numbers))

    def raw(self, x: Sparse) -> np.ndarray:
        return x.dot(self.weights) + self.intercept

    def fit(self, x: Sparse, y: np.ndarray, weight: np.ndarray) -> None:
        self.weights, self.intercept = fit_logistic(x, y, weight)

    def calibrate(self, z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        """Platt's scaling: a logistic model of the raw score alone."""
        self.scale, self.shift = _dense(z[:, None], y, weight)
        self.scale = float(self.scale[0])

    def calibrated(self, z: np.ndarray) -> np.ndarray:
        return self.scale * z + self.shift


def _dense(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Logistic regression of few columns by Newton's steps, lightly damped."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    share = weight / weight.sum()
    for _ in range(steps):
        p = sigmoid(a @ w)
        g = a.T @ ((p - y) * share) + 1e-4 * w
        h = (a * (p * (1 - p) * share)[:, None]).T @ a + 1e-4 * np.eye(len(w))
        w = w - np.linalg.solve(h, g)
    return w[:-1], float(w[-1])


@dataclass
class Model:
    text: View
    meta: View
    mix: np.ndarray
    shift: float

    def scores(self, texts: list, metas: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(combined, text, metadata) scores of rows of features."""
        t = self.text.calibrated(self.text.raw(self.text.encode(texts)))
        m = self.meta.calibrated(self.meta.raw(self.meta.encode(metas)))
        return sigmoid(self.mix[0] * t + self.mix[1] * m + self.shift), sigmoid(t), sigmoid(m)


def _surest(p: np.ndarray, free: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Free pool rows that a view is surest of, for either label, and the labels.

    Each label gets its share of the view's own sure answers.
    """
    sure = free & ((p >= SURE) | (p <= 1 - SURE))
    rate = np.clip((p[sure] >= SURE).mean(), 0.1, 0.9) if sure.any() else 0.5
    order = np.lexsort((np.arange(len(p)), -p))
    good = [k for k in order if sure[k] and p[k] >= SURE][: max(1, round(n * rate))]
    bad = [k for k in order[::-1] if sure[k] and p[k] <= 1 - SURE][: max(1, round(n * (1 - rate)))]
    return np.array(good + bad, np.int64), np.array([1.0] * len(good) + [0.0] * len(bad))


def cotrain(labelled: pd.DataFrame, pool: pd.DataFrame, vocabulary: list[list[str]], rounds: int = ROUNDS) -> Model:
    """The model of bounded samples with columns text, meta (features), y, weight."""
    views = [View({f: k for k, f in enumerate(v)}) for v in vocabulary]
    held = np.arange(len(labelled)) % 4 == 0  # for calibration
    train, rest = labelled[~held], labelled[held]
    names = ("text", "meta")
    own = [list(train[c]) for c in names]
    y = [train["y"].to_numpy(float)] * 2
    weight = [train["weight"].to_numpy(float)] * 2
    pool_x = [v.encode(list(pool[c])) for v, c in zip(views, names, strict=True)]
    free = [np.ones(len(pool), bool) for _ in views]
    for turn in range(rounds + 1):
        for k, view in enumerate(views):
            view.fit(view.encode(own[k]), y[k], weight[k])
        if turn == rounds or not len(pool):
            break
        found = [_surest(sigmoid(v.raw(x)), f, max(1, round(HANDED * len(pool)))) for v, x, f in zip(views, pool_x, free, strict=True)]
        for k in (0, 1):  # what one view is sure of, the other learns
            rows, label = found[1 - k]
            free[1 - k][rows] = False
            own[k] = own[k] + [pool[names[k]].iloc[i] for i in rows]
            y[k] = np.concatenate([y[k], label])
            weight[k] = np.concatenate([weight[k], np.ones(len(rows))])
    z = [v.raw(v.encode(list(rest[c]))) for v, c in zip(views, names, strict=True)]
    ry, rw = rest["y"].to_numpy(float), rest["weight"].to_numpy(float)
    if not len(rest):
        return Model(*views, np.ones(2), 0.0)
    for view, raw in zip(views, z, strict=True):
        view.calibrate(raw, ry, rw)
    both = np.column_stack([v.calibrated(raw) for v, raw in zip(views, z, strict=True)])
    mix, shift = _dense(both, ry, rw)
    return Model(*views, mix, shift)


def learn(
    spark: SparkSession, documents: DataFrame, labels: DataFrame, rows: int = LABELLED, pool_rows: int = POOL
) -> Model | None:
    """The model, or None where labels of both classes are missing."""
    small_batches(spark)

    @F.pandas_udf("text array<string>, meta array<string>")
    def spelled(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        metas = zip(text, lang, source, n_chars, strict=True)
        return pd.DataFrame(
            {"text": [sorted(text_features(t)) for t in text], "meta": [sorted(meta_features(*m)) for m in metas]}
        )

    views = spelled(*_columns(documents))
    known = labelled_sample(documents, labels, "quality", ["doc_id", *documents_columns(documents)], rows)
    known = known.select("doc_id", "y", "weight", views.alias("v"))
    known = stage(spark, known.select("doc_id", "y", "weight", "v.text", "v.meta"), "labelled")
    picked = (
        documents.select(F.col("doc_id").alias("of"))
        .filter("of is not null")
        .join(labels.select(F.col("doc_id").alias("of")), "of", "left_anti")
        .orderBy(F.xxhash64(F.lit(1), "of"), "of")
        .limit(pool_rows)
        .distinct()
    )
    inputs = documents.select("doc_id", *documents_columns(documents))
    pool = inputs.join(F.broadcast(picked), F.col("doc_id") == F.col("of")).select(views.alias("v"))
    vocabulary = [choose_features(known.select("y", F.col(c).alias("features")), VOCABULARY) for c in ("text", "meta")]
    labelled = known.orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    if labelled["y"].nunique() < 2:
        return None
    return cotrain(labelled, pool.select("v.text", "v.meta").toPandas(), vocabulary)


def documents_columns(documents: DataFrame) -> list[str]:
    return [c for c in COLUMNS if c in documents.columns]


def _columns(documents: DataFrame) -> list:
    """The four inputs; a column that is not there is null."""
    kinds = ("string", "string", "string", "double")
    return [
        (F.col(c) if c in documents.columns else F.lit(None)).cast(kind)
        for c, kind in zip(COLUMNS, kinds, strict=True)
    ]


def scorer(spark: SparkSession, model: Model | None):
    """A column function of the four inputs: struct of score, text_score, meta_score."""
    held = spark.sparkContext.broadcast(model)

    @F.pandas_udf("score double, text_score double, meta_score double")
    def score(text: pd.Series, lang: pd.Series, source: pd.Series, n_chars: pd.Series) -> pd.DataFrame:
        release()
        if held.value is None:
            return pd.DataFrame({c: [1.0] * len(text) for c in ("score", "text_score", "meta_score")})
        metas = [meta_features(*m) for m in zip(text, lang, source, n_chars, strict=True)]
        got = held.value.scores([text_features(t) for t in text], metas)
        return pd.DataFrame(dict(zip(("score", "text_score", "meta_score"), got, strict=True)))

    return score


def op4(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score, text_score, meta_score and kept of every document.

    Nulls and empty texts are values of their own to both views. Without labels of both
    classes every document scores 1 and is kept. Repeated rows score alike; ties
    in a hash fall to the lesser id. An empty table gives no rows. Columns other than
    the four inputs are not read.
    """
    score = scorer(spark, learn(spark, documents, labels))(*_columns(documents))
    scored = documents.select("doc_id", score.alias("s")).select("doc_id", "s.*")
    return scored.withColumn("kept", F.col("score") >= THRESHOLD)


def keep_good(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents``, all columns, that the classifier does not reject.

    Null texts count as empty, and null sources and languages as a value of their own; such
    rows are judged like others. Repeated rows are judged alike, so all stay or all
    go. Without labels nothing is sure enough to go. An empty table stays empty.
    """
    score = scorer(spark, learn(spark, documents, labels))(*_columns(documents))
    return documents.filter(score["score"] >= THRESHOLD)
