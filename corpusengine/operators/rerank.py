"""A small model that ranks what retrieval has found, trained here: logistic regression over how a text takes up a query's words.

Scoring is an iterator pandas UDF: a worker reads the weights once, and takes pairs in batches of like length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Pairs that the model is trained on at most, by a hash; characters of texts that are taken together; rounds of training.
SAMPLE, CHARACTERS, ROUNDS = 20_000, 2_000_000, 200
FEATURES = 6
_WORD = r"[\p{L}\p{N}_]+"


def features(query: str | None, text: str | None) -> list[float]:
    """Shares of the query's words, pairs and triples of words that the text has, of its words by their letters, the text's length, and a constant."""
    import regex

    q, t = (regex.findall(_WORD, (x or "").lower()) for x in (query, text))
    shares = []
    for n in (1, 2, 3):
        wanted, there = (set(zip(*(w[i:] for i in range(n)), strict=False)) for w in (q, t))
        shares.append(len(wanted & there) / len(wanted) if wanted else 0.0)
    known = set(t)
    letters = sum(map(len, q))
    return [*shares, sum(len(w) for w in q if w in known) / letters if letters else 0.0, math.log1p(len(t)) / 10, 1.0]


def batches(texts: pd.Series) -> Iterator[np.ndarray]:
    """Positions in the order of the texts' lengths, of about CHARACTERS together; one at least."""
    sizes = texts.fillna("").str.len().to_numpy(np.int64)
    order = np.argsort(sizes, kind="stable")
    part = np.cumsum(sizes[order]) // CHARACTERS
    yield from np.split(order, np.flatnonzero(np.diff(part)) + 1)


def fitted(pairs: DataFrame, sample: int = SAMPLE) -> np.ndarray:
    """Weights from ``pairs(query_text, text, relevant)``: Newton's rounds on the log loss, both labels of equal weight. Null labels teach nothing."""

    @F.pandas_udf("array<double>")
    def found(queries: pd.Series, texts: pd.Series) -> pd.Series:  # where the texts are: only features leave the executors
        return pd.Series([features(q, t) for q, t in zip(queries, texts, strict=True)], dtype=object)

    rows = pairs.where("relevant is not null").orderBy(F.xxhash64("query_text", "text")).limit(sample)
    rows = rows.select(found("query_text", "text").alias("x"), F.col("relevant").cast("int").alias("y")).toPandas()
    if rows["y"].nunique() < 2:
        return np.zeros(FEATURES)
    x, y = np.array(rows["x"].tolist()), rows["y"].to_numpy(np.float64)
    mass = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    w = np.zeros(FEATURES)
    for _ in range(ROUNDS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (mass * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(FEATURES), x.T @ (mass * (y - p)) - 1e-4 * w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def scorer(spark: SparkSession, weights: np.ndarray) -> Callable[[Column, Column], Column]:
    """A function of the query's and the text's columns that gives the chance that the text is relevant."""
    sent = spark.sparkContext.broadcast(np.asarray(weights, np.float64))

    @F.pandas_udf("double")
    def score(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        w = sent.value  # once a worker
        for queries, texts in parts:
            out = np.zeros(len(texts))
            for at in batches(texts) if len(texts) else ():
                x = np.array([features(q, t) for q, t in zip(queries.iloc[at], texts.iloc[at], strict=True)])
                out[at] = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            yield pd.Series(out)

    return score
