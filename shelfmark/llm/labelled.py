"""Training rows for the classifiers: a bounded sample of labelled documents, and logistic fits on their features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def remainder(column: str, of: int):
    """crc32 of the id's text, modulo `of`."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % of


def sample(docs: DataFrame, labels: DataFrame, label: str, modulo: int, held: int, limit: int) -> DataFrame:
    """doc_id, text, label (0 or 1), part of at most `limit` labelled documents outside the held-out remainder.

    The rows with the smallest hashes of their ids are taken. part is 0 for two thirds of them and 1 for the rest. An id
    counts once: of several labels the smallest, of several documents the one with the first text, nulls last.
    """
    order = F.xxhash64(F.col("doc_id"), F.lit(7))
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).where(remainder("doc_id", modulo) != held)
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    rows = rows.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(order).limit(limit)
    rows = rows.withColumn("part", (F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(3)) == 2).cast("int"))
    # At most `limit` rows of three integers are broadcast, and as many with a text come back.
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(rows), "doc_id")
    return found.groupBy("doc_id", "label", "part").agg(F.min("text").alias("text")).select("doc_id", "text", "label", "part")


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights of a logistic model without intercept (give a column of ones), by Newton's steps on the penalised loss."""
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (p - y) + penalty * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w
