"""One series at a time: a scorer that answers every point before it sees the next, with the numbers of the batch engine."""

from __future__ import annotations

import copy
import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np

from tidemark.streaming.scores import CLIP, advance


@dataclass
class OnlineScorer:
    """The running statistics of one series. Its state has a fixed size; snapshot() and restore() move it between processes."""

    mean: float
    sd: float
    state: tuple = field(default=(0, 0.0, 0.0, 0.0, 0.0))

    @classmethod
    def of(cls, history: Iterable[float]) -> OnlineScorer:
        """From a clean history: non-finite values count as its median; an empty one as a single 0."""
        h = np.asarray(list(history), dtype=float)
        ok = np.isfinite(h) & (np.abs(h) < 1e300)
        median = float(np.median(np.clip(h[ok], -1e100, 1e100))) if ok.any() else 0.0
        h = np.clip(np.where(ok, h, median), -1e100, 1e100) if len(h) else np.zeros(1)
        return cls(float(h.mean()), max(float(h.std(ddof=1)) if len(h) > 1 else 1.0, 1e-8))

    def update(self, point: float) -> dict[str, float]:
        """The statistics after a point; a non-finite one counts as the mean and is marked."""
        finite = math.isfinite(point) and abs(point) < 1e300
        z = min(max((point - self.mean) / self.sd, -CLIP), CLIP) if finite else 0.0
        self.state = advance(self.state, z)
        t, up, down, mean, ewma = self.state
        score = max(math.log1p(up), math.log1p(down)) / 4
        return {"t": t, "z": z, "missing": float(not finite), "cusum_positive": math.log1p(up), "cusum_negative": math.log1p(down), "running_mean": mean, "ewma": ewma, "p": score / (1 + score)}

    def snapshot(self) -> OnlineScorer:
        return copy.deepcopy(self)

    def restore(self, snapshot: OnlineScorer) -> None:
        if not isinstance(snapshot, OnlineScorer):
            raise TypeError("not a snapshot of this scorer")
        self.mean, self.sd, self.state = snapshot.mean, snapshot.sd, snapshot.state


def infer(datasets: Iterable[tuple[Iterable[float], Iterable[float]]]) -> Iterator[float | None]:
    """A bare None as the ready signal, then one score for each point of each (history, points) pair, before the next point is read."""
    yield None
    for history, points in datasets:
        scorer = OnlineScorer.of(history)
        for point in points:
            yield scorer.update(float(point))["p"]
