"""Whole-series resamples of many series, counted where the rows are.

The draws are those of statistics.draws(), as arrays of how often a replicate draws each series. They follow from the number of series alone, so a task makes
them itself, and no row of a series is copied for a replicate.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.plans.relation import Relation

#: Replicates that are summed at once, and numbers of a task's arrays, about.
TOGETHER, NUMBERS = 8, 4_000_000
#: Replicates of a task that sums tables of series.
TASK = 128
PRIME = 2147483647


def drawn(n: int, replicate: int) -> np.ndarray:
    """How often a replicate draws each of n series; replicate 0 is the sample itself."""
    if not replicate:
        return np.ones(n, dtype=np.int64)
    picks = (replicate * 48271 + np.arange(n, dtype=np.int64) * 69621 + 12345) % PRIME * 16807 % PRIME * 16807 % PRIME % n
    return np.bincount(picks, minlength=n)


@lru_cache(maxsize=1)
def counts(n: int, replicates: int) -> np.ndarray:
    """drawn() of all replicates, a column each."""
    found = np.empty((n, replicates + 1), dtype=np.uint16)
    for r in range(replicates + 1):
        found[:, r] = drawn(n, r)
    return found


def placed(rows: Relation, ids: Relation) -> Relation:
    """rows of known series, with k, the place of the series among all ids from 0, and n_all, their number."""
    numbered = ids.add(k="LONG(row_number() OVER (ORDER BY id)) - 1", n_all="count(*) OVER ()")
    return rows.then("SELECT $1.*, $2.k, $2.n_all FROM $1 JOIN $2 ON $1.id = $2.id", numbered)


def wins(p: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Twice the wins, and the pairs, of the rows of a time under each column of weights."""
    order = np.argsort(p, kind="stable")
    p, up = p[order], y[order] == 1
    first = np.concatenate([[True], (p[1:] != p[:-1]) & ~(np.isnan(p[1:]) & np.isnan(p[:-1]))])
    starts, won, pairs = np.flatnonzero(first), [], []
    step = max(1, min(TOGETHER, NUMBERS // max(len(p), 1)))
    for at in range(0, weights.shape[1], step):
        w = weights[order, at : at + step].astype(np.int64)
        pos = np.where(up[:, None], w, 0)
        neg = w - pos
        if len(starts) < len(p):
            pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
        won.append((pos * (2 * np.cumsum(neg, axis=0) - neg)).sum(axis=0))
        pairs.append(pos.sum(axis=0) * neg.sum(axis=0))
    return np.concatenate(won), np.concatenate(pairs)


def ts_auc(scores: Relation, ids: Relation, columns: list[str], replicates: int, spark, sf_dir: str = "") -> DataFrame:
    """metrics.weighted_ts_auc() of each column of scores (id, t, y, columns) under statistics.draws(ids, replicates): replicate, name, pairs and ts_auc.

    A row is dealt once by its time, whatever the number of replicates and columns. Sums are of integers, so they are exact.
    """
    rows = placed(scores.keep("id", "t", "y", *columns), ids).keep("t", "k", "n_all", y="cast(y AS int)", **{f"p_{c}": c for c in columns}).frame(spark, sf_dir)

    def of_time(part: pd.DataFrame) -> pd.DataFrame:
        weights = counts(int(part["n_all"].iloc[0]), replicates)[part["k"].to_numpy()]
        seen, y, found = weights.sum(axis=0, dtype=np.int64), part["y"].to_numpy(), []
        for c in columns:
            won, pairs = wins(part[f"p_{c}"].to_numpy(dtype=float), y, weights)
            found.append(pd.DataFrame({"replicate": np.arange(replicates + 1), "name": c, "seen": seen, "won": won, "pairs": pairs}))
        return pd.concat(found)

    times = rows.groupBy("t").applyInPandas(of_time, "replicate long, name string, seen long, won long, pairs long")
    sums = times.groupBy("replicate", "name").agg(F.sum("seen").alias("seen"), F.sum("won").alias("won"), F.sum("pairs").alias("pairs")).filter("seen > 0")
    return sums.selectExpr("replicate", "name", "pairs", "CASE WHEN pairs > 0 THEN won / 2e0 / pairs ELSE 0.5e0 END AS ts_auc")


def sums(shares: Relation, replicates: int, spark, states: int = 3) -> DataFrame:
    """The sum of the shares (id, a, b, share) of the series that a replicate of statistics.draws() has, by replicate, a and b: replicate, a, b and w.

    A series is one row of states squared numbers, which goes to each task of TASK replicates.
    """
    cells = [(a, b) for a in range(states) for b in range(states)]
    wide = shares.group("id", **{f"c{a}_{b}": f"coalesce(max(CASE WHEN a = {a} AND b = {b} THEN share END), 0e0)" for a, b in cells})
    names = [f"c{a}_{b}" for a, b in cells]
    rows = placed(wide, wide.keep("id")).then(f"SELECT k, n_all, {', '.join(names)}, EXPAND(0, {replicates // TASK}) AS part FROM $1").frame(spark)

    def of_part(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        n, table, found = int(part["n_all"].iloc[0]), part[names].to_numpy(dtype=float), []
        k, low = part["k"].to_numpy(), int(key[0]) * TASK
        for r in range(low, min(low + TASK, replicates + 1)):
            found += [(r, a, b, w) for (a, b), w in zip(cells, drawn(n, r)[k].astype(float) @ table, strict=True)]
        return pd.DataFrame(found, columns=["replicate", "a", "b", "w"])

    return rows.groupBy("part").applyInPandas(of_part, "replicate long, a long, b long, w double")
