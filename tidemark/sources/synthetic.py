"""Synthetic series for checks: a clean history and an online segment with a known change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

KINDS = ("no_break", "mean_up", "mean_down", "variance_up", "variance_down", "heavy_tail", "ar_up", "ar_reverse", "single_outlier")


def pair(kind: str, seed: int, history: int = 1024, online: int = 320, tau: int = 120) -> tuple[np.ndarray, np.ndarray, int | None]:
    """History, online points and the break's step. The stream up to a point doesn't depend on what follows."""
    rng = np.random.default_rng([seed, KINDS.index(kind)])
    noise = rng.normal(size=history + online)
    x, after = noise.copy(), history + tau
    if kind in ("ar_up", "ar_reverse"):
        for i in range(1, len(x)):
            k = 0.2 if i < after else 0.8 if kind == "ar_up" else -0.6
            x[i] = k * x[i - 1] + noise[i]
    elif kind in ("mean_up", "mean_down"):
        x[after:] += 1.0 if kind == "mean_up" else -1.0
    elif kind in ("variance_up", "variance_down"):
        x[after:] *= 2.0 if kind == "variance_up" else 0.5
    elif kind == "heavy_tail":
        x[after:] = rng.standard_t(3, online - tau) / np.sqrt(3)
    elif kind == "single_outlier":
        x[after] += 8.0
    return x[:history].astype(np.float32), x[history:].astype(np.float32), None if kind in ("no_break", "single_outlier") else tau


def cohort(spark: SparkSession, kinds: tuple[str, ...] = KINDS, each: int = 3, **how) -> tuple[DataFrame, DataFrame]:
    """Frames of points (id, time, period, value, kind) and of labels (id, tau)."""
    points, labels = [], []
    for k, kind in enumerate(kinds):
        for j in range(each):
            h, o, tau = pair(kind, j, **how)
            i = k * each + j
            points += [(i, t, 1 if t < len(h) else 2, float(v), kind) for t, v in enumerate(np.concatenate([h, o]))]
            labels.append((i, -1 if tau is None else tau))
    return spark.createDataFrame(points, "id long, time long, period int, value double, kind string"), spark.createDataFrame(labels, "id long, tau long")
