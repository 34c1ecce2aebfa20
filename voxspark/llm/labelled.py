"""Bounded samples of labelled documents for models that are fitted on the driver."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxspark.session import discard, settle


def labelled_sample(
    documents: DataFrame, labels: DataFrame, label: str, usable: Column, per_class: int, max_bytes: int, doc_id: str = "doc_id", text: str = "text"
) -> tuple[list[tuple[str, int]], tuple[int, int]]:
    """(text, label) of at most ``per_class`` labelled documents of each class 0 and 1, in a fixed order, and the numbers
    of labelled documents of each class in the whole table.

    Documents are the ids that have a row; those with the smallest hashes are taken among the ``usable`` ones (equal
    hashes by id). A text over ``max_bytes`` is left out whole; null texts, null labels and null ids are never taken. An id
    labelled twice counts once, by its highest label; an id with several texts counts once, by the smallest of them that
    is short enough. So at most 2 * per_class rows are broadcast, and as many come to the driver.
    """
    marked = labels.where(F.col(label).isin(0, 1) & F.col(doc_id).isNotNull() & usable).groupBy(doc_id).agg(F.max(label).cast("int").alias("label"))
    texts = documents.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull())
    short = F.octet_length("text") <= max_bytes
    present = texts.groupBy("id").agg(F.coalesce(F.max(short), F.lit(False)).alias("short"))
    known = settle(marked.join(present, marked[doc_id] == present["id"]).select("id", "label", "short"))
    sizes = {row["label"]: row["n"] for row in known.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    first = [known.where(F.col("short") & (F.col("label") == value)).orderBy(F.xxhash64("id"), "id").limit(per_class) for value in (0, 1)]
    chosen = first[0].unionByName(first[1]).select("id", "label")
    found = texts.where(short).join(F.broadcast(chosen), "id").groupBy("id", "label").agg(F.min("text").alias("text")).collect()
    discard(known)
    rows = [(row["text"], row["label"], row["id"]) for row in found]
    rows.sort(key=lambda row: (str(row[2])[::-1], row[0]))  # mixes the classes, the same way in every run
    return [(content, value) for content, value, _ in rows], (sizes.get(0, 0), sizes.get(1, 0))


def logistic(x, y, sizes: tuple[int, int], rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float]:
    """(slope, intercept) of a one-feature logistic regression, by Newton steps; the feature is standardised.

    ``sizes`` are the classes' numbers of rows in the population, for which the intercept is corrected.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    if not len(x) or y.min() == y.max():
        rate = sizes[1] / sum(sizes) if sum(sizes) else 0.5
        rate = min(max(rate, 1e-3), 1 - 1e-3)
        return 0.0, float(np.log(rate / (1 - rate)))
    center, spread = x.mean(), x.std() or 1.0
    design = np.stack([(x - center) / spread, np.ones_like(x)], axis=1)
    weights = np.zeros(2)
    for _ in range(rounds):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (chance - y) + ridge * weights
        curve = (design * (chance * (1 - chance))[:, None]).T @ design + ridge * np.eye(2)
        step = np.linalg.solve(curve, slope)
        weights -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    shift = np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum())) if min(sizes) else 0.0
    return float(weights[0] / spread), float(weights[1] - weights[0] * center / spread + shift)


def logistic_of(features, y, sizes: tuple[int, int], rounds: int = 50, ridge: float = 1e-2) -> tuple[np.ndarray, float]:
    """(slopes, intercept) of a logistic regression of several features, by Newton steps, as ``logistic`` is for one;
    ``features`` is a matrix with a row each."""
    x, y = np.asarray(features, float), np.asarray(y, float)
    if not len(y) or y.min() == y.max():
        return np.zeros(x.shape[1]), logistic([], [], sizes)[1]
    center, spread = x.mean(axis=0), x.std(axis=0)
    spread[spread == 0] = 1.0
    design = np.column_stack([(x - center) / spread, np.ones(len(x))])
    weights = np.zeros(design.shape[1])
    for _ in range(rounds):
        odds = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        slope = design.T @ (odds - y) + ridge * weights
        curve = (design * (odds * (1 - odds))[:, None]).T @ design + ridge * np.eye(len(weights))
        weights -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    shift = np.log(sizes[1] / sizes[0]) - np.log(y.sum() / (len(y) - y.sum())) if min(sizes) else 0.0
    return weights[:-1] / spread, float(weights[-1] - (weights[:-1] * center / spread).sum() + shift)


def chance(logits: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(logits, -40, 40)))
