"""Bounded samples of labelled documents, and a small logistic fit."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Longest text, in characters, of a training document. It bounds the sample;
#: texts to be scored have no bound.
LONGEST = 200_000


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the decimal doc_id, modulo n; null for a null doc_id."""
    return F.crc32(doc_id.cast("long").cast("string").cast("binary")) % n


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[Column], Column], per_class: int) -> pd.DataFrame:
    """(text, label) of at most ``per_class`` documents of each label, in a fixed order.

    ``train`` tells from a doc_id whether its label may be learnt from. A document
    counts once; one with contrary labels is left out. The choice is by hash of
    the doc_id, over all labels.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("doc_id IS NOT NULL AND label IN (0, 1)")
    known = known.where(train(F.col("doc_id"))).groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("other")).where("label = other")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = []
    for value in (0, 1):
        chosen = known.where(F.col("label") == value).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).select("doc_id")
        # At most per_class rows.
        found = texts.join(F.broadcast(chosen), "doc_id").where(F.length("text") <= LONGEST)
        found = found.groupBy("doc_id").agg(F.min("text").alias("text"))
        rows.append(found.orderBy("doc_id").toPandas().assign(label=value))
    return pd.concat(rows)[["text", "label"]]


def fit_logistic(x: np.ndarray, y: np.ndarray, l2: float = 1e-2, rounds: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights of a logistic regression by Newton's method; the last is the constant."""
    x = np.column_stack([x, np.ones(len(x))])
    w, penalty = np.zeros(x.shape[1]), l2 * np.ones(x.shape[1])
    penalty[-1] = 1e-6
    weight = np.ones(len(x)) if weight is None else weight
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (y - p)) - penalty * w
        h = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step = np.linalg.solve(h, g)
        w = w + step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
