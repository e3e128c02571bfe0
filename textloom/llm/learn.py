"""What the classifiers share: the split, bounded samples of labelled rows, logistic functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text is a multiple of 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(FOLDS)) == 0, F.lit(False))


def labelled(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, label) of the rows to learn from: ids not held out, one row each; of different labels for an id the larger counts."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1) & ~held_out(F.col("doc_id")))
    return rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))


def sample_ids(ids: DataFrame, most: int, seed: int = 1) -> DataFrame:
    """At most ``most`` rows, those with the least hash of their id: the same whatever the partitions."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(most)


def texts_of(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row of ``docs`` (doc_id, text) for each row of ``ids``, a bounded sample that is sent to all executors; of several texts of an id the least."""
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id").groupBy(*ids.columns).agg(F.min("text").alias("text"))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    """Area under the ROC curve, ties counted half."""
    values, place, count = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(count) - (count - 1) / 2)[place]
    p = int((label == 1).sum())
    n = len(label) - p
    return float((rank[label == 1].sum() - p * (p + 1) / 2) / (p * n)) if p and n else float("nan")
