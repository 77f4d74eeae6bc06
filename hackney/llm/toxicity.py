"""Toxicity scores from a classifier regularised by counterfactuals.

A text's features are the words in it and the beginnings of words. In the labelled
texts, each sentence that names a group gets a twin that names another group of
the same kind. The loss adds the squared difference between the scores of a
sentence and its twin, so a name of a group by itself cannot move a score, while
words that are toxic beside any name still do.

Fitting takes at most ``LABELLED`` labelled rows; all words of their texts are counted.
All documents are scored, whole.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .linear import Sparse, choose_features, fit_logistic, labelled_sample, sigmoid
from .scratch import small_batches, stage
from .word_tokens import pieces

LABELLED = 16_000
VOCABULARY = 4096
PENALTY = 1e-4
PAIR_PENALTY = 10.0
THRESHOLD = 0.3
#: Sentences with a twin, at most, that the penalty is taken over.
TWINS = 20_000

#: Terms that name groups, by kind (fixed values); a term is swapped within its kind.
IDENTITY_TERMS = (
    ("christian", "muslim", "jewish", "hindu", "buddhist", "sikh", "atheist", "catholic"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "sikhs", "atheists", "catholics"),
    ("women", "men"),
    ("woman", "man"),
    ("female", "male", "nonbinary"),
    ("gay", "straight", "lesbian", "bisexual", "heterosexual", "homosexual", "queer"),
    ("transgender", "cisgender"),
    ("black", "white", "asian", "latino", "african", "european", "arab", "hispanic"),
    ("immigrants", "natives", "refugees", "foreigners"),
    ("blind", "deaf", "disabled", "paralyzed"),
    ("old", "young", "elderly"),
)

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[^.!?\n]+")


def swaps(terms=IDENTITY_TERMS) -> dict[str, str]:
    """Each term's next of its kind."""
    return {a: kind[(k + 1) % len(kind)] for kind in terms for k, a in enumerate(kind)}


def features(text: str | None) -> set[str]:
    """Different words, and beginnings of four and five letters with a mark."""
    found: set[str] = set()
    for part in pieces((text or "").encode()):
        words = set(_WORD.findall(part.decode().lower()))
        found |= words
        for w in words:
            if len(w) > 4:
                found.add(w[:4] + "-")
                if len(w) > 5:
                    found.add(w[:5] + "-")
    return found


def twins(text: str | None, swap: dict[str, str]) -> list[tuple[str, str]]:
    """Sentences that name a group, each with its counterfactual."""
    out = []
    for sentence in _SENTENCE.findall((text or "").lower()):
        if not swap.keys().isdisjoint(_WORD.findall(sentence)):
            out.append((sentence, _WORD.sub(lambda m: swap.get(m[0], m[0]), sentence)))
    return out


def learn(
    spark: SparkSession,
    documents: DataFrame,
    labels: DataFrame,
    where: Column | None = None,
    rows: int = LABELLED,
    vocabulary: int = VOCABULARY,
    terms=IDENTITY_TERMS,
    pair_penalty: float = PAIR_PENALTY,
) -> tuple[dict[str, float], float]:
    """Weights by feature and the intercept, from labelled rows that ``where`` admits.

    To the driver go counts of ``vocabulary`` features and, of ``rows`` texts at most,
    the numbers of those features: bounded, whatever the corpus.
    """
    small_batches(spark)
    swap = swaps(terms)

    @F.pandas_udf("array<string>")
    def spelled(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: sorted(features(t)))

    @F.pandas_udf("array<struct<a:string,b:string>>")
    def pairs_of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [{"a": a, "b": b} for a, b in twins(t, swap)])

    sample = labelled_sample(documents, labels, "toxic", ["text"], rows, where)
    sample = stage(spark, sample.select("y", "weight", "text", spelled("text").alias("features")), "sample")
    chosen = choose_features(sample.select("y", "features"), vocabulary)
    if not chosen:
        return {}, -5.0
    numbers = {f: k for k, f in enumerate(chosen)}
    wide = spark.sparkContext.broadcast(numbers)

    @F.pandas_udf("array<int>")
    def encoded(found: pd.Series) -> pd.Series:
        v = wide.value
        return found.map(lambda fs: [v[f] for f in fs if f in v])

    got = sample.select("y", "weight", encoded("features").alias("x")).collect()
    sentences = (
        sample.select(F.explode(pairs_of("text")).alias("pair"))
        .select("pair.a", "pair.b")
        .distinct()
        .orderBy(F.xxhash64("a"), "a", "b")
        .limit(TWINS)
        .collect()
    )
    number = lambda text: [numbers[f] for f in features(text) if f in numbers]
    twin = tuple(Sparse([number(r[k]) for r in sentences], len(chosen)) for k in ("a", "b"))
    x = Sparse([r["x"] for r in got], len(chosen))
    y, weight = (np.array([r[k] for r in got], float) for k in ("y", "weight"))
    w, b = fit_logistic(x, y, weight, PENALTY, pairs=twin, pair_penalty=pair_penalty)
    return {f: float(w[k]) for f, k in numbers.items()}, b


def scorer(spark: SparkSession, weights: dict[str, float], intercept: float):
    """A column function: text to score. The broadcast has ``VOCABULARY`` entries."""
    held = spark.sparkContext.broadcast(weights)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        w = held.value
        z = [intercept + sum(w[f] for f in features(t) & w.keys()) for t in texts]
        return pd.Series(sigmoid(np.array(z, float)))

    return score


def op10(spark: SparkSession, documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Null and empty texts score the intercept alone. A null id is not held out. Without
    labelled rows of both classes every score is low. Repeated rows score alike. Other
    columns are not read.
    """
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    weights, intercept = learn(spark, documents, labels, where=~held_out)
    score = scorer(spark, weights, intercept)
    scored = documents.select("doc_id", held_out.alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
