"""Bounded, reproducible samples of labelled documents to fit models on."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import cut, held_out


def training_sample(
    docs: DataFrame, labels: DataFrame, label: str, modulus: int, remainder: int, limit: int
) -> DataFrame:
    """(doc_id, label, text, half) of at most `limit` labelled documents.

    Rows whose crc32(doc_id as text) leaves the remainder are held out.  The
    others are taken in order of a hash of doc_id, so the sample does not
    depend on partitions.  It is small enough to broadcast by its limit.
    """
    known = (
        labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
        .where(~held_out(modulus, remainder))
        .groupBy("doc_id")
        .agg(F.max(label).cast("int").alias("label"))
    )
    picked = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    texts = (
        docs.select("doc_id", "text")
        .where(F.col("text").isNotNull())
        .join(F.broadcast(picked), "doc_id")
        .groupBy("doc_id")
        .agg(F.first("label").alias("label"), F.min("text").alias("text"))
    )
    return cut(texts.withColumn("half", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2))))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 40) -> np.ndarray:
    """Weights (the constant last) of a ridge logistic regression, by Newton's steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    damp = np.eye(len(w)) * ridge * max(1, len(x)) ** 0.5
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve(
            (x * (p * (1 - p))[:, None]).T @ x + damp, x.T @ (y - p) - damp @ w
        )
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return w
