"""What the two classifiers share: training rows and calibration."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def remainder(id_col: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo folds; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(folds).cast("long"))


def held_out(id_col: Column, folds: int, fold: int) -> Column:
    return F.coalesce(remainder(id_col, folds) == fold, F.lit(False))


def training_labels(labels: DataFrame, label_col: str, folds: int, fold: int, most: int, id_col: str = "doc_id") -> DataFrame:
    """At most about `most` labelled ids outside the fold: doc_id, label (0 or 1), part (0 to 99, by hash).

    The sample is by hash of the id, so it is the same in each run. Ids with several labels get the highest; null ids or
    labels are left out.
    """
    rows = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1))
    rows = rows.where(~held_out(F.col("doc_id"), folds, fold)).groupBy("doc_id").agg(F.max("label").alias("label"))
    share = min(1.0, most / max(1, rows.count()))
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000))
    part = F.pmod(F.xxhash64("doc_id", F.lit("part")), F.lit(100)).cast("int")
    return rows.where(draw < int(share * 1_000_000)).withColumn("part", part)


def pool_adjacent_violators(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The nondecreasing fit to value with the least weighted squared error."""
    blocks: list[list[float]] = []
    for v, w in zip(value, weight):
        blocks.append([v * w, w, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, mass, n = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + mass, blocks[-1][2] + n]
    return np.concatenate([np.full(n, total / mass) for total, mass, n in blocks]) if blocks else np.zeros(0)


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knots (score, chance) of an isotonic fit, one in the middle of each level; np.interp goes between them."""
    order = np.argsort(score, kind="stable")
    s, y = score[order], label[order].astype(float)
    fit = pool_adjacent_violators(y, np.ones(len(y)))
    cuts = np.flatnonzero(np.diff(fit)) + 1
    starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(s)]])
    knots = np.array([s[a:b].mean() for a, b in zip(starts, ends)])
    return knots, fit[starts]


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 50) -> np.ndarray:
    """Weights, the last for the constant, by Newton's method."""
    a = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(a.shape[1])
    penalty = ridge * np.eye(len(w))
    penalty[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + penalty, a.T @ (y - p) - penalty @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w
