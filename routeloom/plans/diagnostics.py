"""Whether a frontier falls into clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

CLUSTERS = "run string, k int, silhouette double, largest_share double, mean_similarity double, mean_nearest double"
METRICS = ("euclidean", "tanimoto")


def linkage(distance: np.ndarray, k: int) -> np.ndarray:
    """Labels of k clusters by average linkage."""
    d, sizes, label = distance.astype(float).copy(), np.ones(len(distance)), np.arange(len(distance))
    np.fill_diagonal(d, np.inf)
    for _ in range(len(distance) - k):
        a, b = sorted(np.unravel_index(np.argmin(d), d.shape))
        merged = (sizes[a] * d[a] + sizes[b] * d[b]) / (sizes[a] + sizes[b])
        d[a], d[:, a] = merged, merged
        d[a, a], d[b], d[:, b] = np.inf, np.inf, np.inf
        sizes[a] += sizes[b]
        label[label == b] = a
    return np.unique(label, return_inverse=True)[1]


def silhouette(distance: np.ndarray, label: np.ndarray) -> float:
    """The mean over points; 0 for a point alone in its cluster."""
    means = np.array([[distance[i, label == c].mean() for c in range(label.max() + 1)] for i in range(len(label))])
    sizes, out = np.bincount(label), []
    for i, c in enumerate(label):
        if sizes[c] == 1:
            out.append(0.0)
            continue
        own = means[i, c] * sizes[c] / (sizes[c] - 1)
        other = np.min(np.delete(means[i], c))
        out.append((other - own) / max(own, other) if max(own, other) > 0 else 0.0)
    return float(np.mean(out))


def distances(x: np.ndarray, metric: str) -> np.ndarray:
    """Euclidean distances, or one minus the counted Tanimoto similarity (two empty vectors are alike by 1)."""
    square, both = (x * x).sum(axis=1), x @ x.T
    if metric == "euclidean":
        return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * both, 0))
    union = square[:, None] + square[None] - both
    return 1 - np.divide(both, union, out=np.ones_like(both), where=union != 0)


def clusterability(views: DataFrame, ks: tuple[int, ...] = (2, 3, 5), metric: str = "euclidean") -> DataFrame:
    """(run, k, silhouette, largest_share, mean_similarity, mean_nearest) for rows (run, id, features), by average linkage.

    ``mean_similarity`` is over all pairs, ``mean_nearest`` over each row's best partner, both as one
    minus the distance.  The rows of a run are a view of a frontier, so their pairs fit a task.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, got {metric!r}")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(rows.sort_values("id")["features"].to_numpy()).astype(float)
        distance, out = distances(x, metric), []
        apart = distance + np.diag(np.full(len(x), np.inf))
        pairs = distance[np.triu_indices(len(x), 1)]
        for k in ks:
            if 1 < k < len(x):
                label = linkage(distance, k)
                out.append((key[0], k, silhouette(distance, label), float(np.bincount(label).max() / len(x)), float(1 - pairs.mean()), float(1 - apart.min(axis=1).mean())))
        return pd.DataFrame(out, columns=[c.split()[0] for c in CLUSTERS.split(", ")])

    return views.groupBy("run").applyInPandas(run, CLUSTERS)
