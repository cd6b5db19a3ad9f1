"""Labelled rows for the classifiers: a bounded sample with texts, and small numpy fits."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(doc_id: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string")) % modulus


def training_rows(docs: DataFrame, labels: DataFrame, target: str, modulus: int, held_out: int, most: int) -> list[tuple[str, int]]:
    """At most ``most`` labelled (text, label) rows outside the held-out remainder, chosen by a hash of the id.

    Of repeated labels of a document the largest counts, and the smallest of its
    texts; rows with a null id, text or label are left out.
    """
    known = labels.where(remainder("doc_id", modulus) != held_out).where(F.col(target).isNotNull() & F.col("doc_id").isNotNull())
    place = F.xxhash64("label_of")
    # hashes beyond a bound that leaves twice as many rows can't be among the first, so no task gets many
    size = known.select("doc_id").distinct().count()
    bound = int(-(2**63) + 2**64 * min(1.0, (2 * most + 1000) / max(1, size))) if size > 2 * most + 1000 else 2**63 - 1
    each = known.withColumn("label_of", F.col("doc_id")).where(place <= bound).groupBy("label_of").agg(F.max(target).cast("int").alias("label"))
    chosen = each.orderBy(place, "label_of").limit(most)
    found = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(chosen), F.col("doc_id") == F.col("label_of"))  # at most ``most`` rows
    rows = found.groupBy("label_of").agg(F.min("text").alias("text"), F.first("label").alias("label")).collect()
    return [(r.text, r.label) for r in sorted(rows, key=lambda r: r.label_of)]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> np.ndarray:
    """Ridge logistic weights, the last one the intercept, by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = sigmoid(x @ w)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))
