"""What scores owe to times, series and pairs, and tables of states, against loops."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import panels, states, statistics
from tidemark.plans.relation import Relation


@pytest.fixture(scope="module")
def scores():
    rng = np.random.default_rng(7)
    rows = [(i, t, int(i < 4 and t > 3 + i), round(float(rng.normal()), 1), round(float(rng.normal()), 1)) for i in range(9) for t in range(1, 8 + 5 * i)]
    return pd.DataFrame(rows, columns=["id", "t", "y", "p", "q"])


def relation(spark, frame):
    return Relation.of(spark.createDataFrame(frame))


def won(frame, column="p"):
    """Wins and pairs of each time, over all pairs."""
    found = {}
    for t, rows in frame.groupby("t"):
        up, down = rows[rows.y == 1][column].to_numpy(), rows[rows.y == 0][column].to_numpy()
        gap = up[:, None] - down[None, :]
        found[t] = (float((gap > 0).sum() + 0.5 * (gap == 0).sum()), gap.size)
    return found


def test_time_credits(spark, scores):
    got = statistics.time_credits(relation(spark, scores), "q").frame(spark).toPandas().set_index("low")
    new, old = won(scores), won(scores, "q")
    total = sum(n for _, n in new.values())
    assert sorted(got.index) == list(statistics.TIME_BINS)
    for low, high in zip(statistics.TIME_BINS, [*statistics.TIME_BINS[1:], math.inf], strict=True):
        times = [t for t in new if low <= t - 1 < high]
        pairs, delta = sum(new[t][1] for t in times), sum(new[t][0] - old[t][0] for t in times)
        assert got.pairs[low] == pairs and got.share[low] == pytest.approx(pairs / total) and got.credit[low] == pytest.approx(delta / total)
        assert got.gain[low] == pytest.approx(delta / pairs) if pairs else math.isnan(got.gain[low])
    assert got.credit.sum() == pytest.approx(sum(w for w, _ in new.values()) / total - sum(w for w, _ in old.values()) / total)


def test_delete_one(spark, scores):
    got = statistics.delete_one(relation(spark, scores)).frame(spark).toPandas().set_index("id")
    for i in scores.id.unique():
        left = won(scores[scores.id != i])
        pairs = sum(n for _, n in left.values())
        assert got.pairs[i] == pairs and got.ts_auc[i] == pytest.approx(sum(w for w, _ in left.values()) / pairs)
    lone = scores[scores.id.isin([0, 8])]
    assert statistics.delete_one(relation(spark, lone)).frame(spark).toPandas().ts_auc.tolist() == [0.5, 0.5]


@pytest.mark.parametrize("bins", [3, 64, 100_000])
def test_histogram_gradients(spark, scores, bins):
    got = panels.histogram_gradients(relation(spark, scores), bins).frame(spark).toPandas().set_index(["id", "t"])
    scale = len(scores) / (2 * sum(n for _, n in won(scores).values()))
    assert len(got) == len(scores)
    for _, rows in scores.groupby("t"):
        low, width = rows.p.min(), max(rows.p.max() - rows.p.min(), 1e-10)
        cell = np.minimum(((rows.p - low) / width * bins).astype(int), bins - 1)
        mean = rows.p.groupby([rows.y, cell]).transform("mean")
        for k, row in rows.iterrows():
            margin = mean[k] - mean[rows.y != row.y]
            q = 1 / (1 + np.exp(margin if row.y == 1 else -margin))
            assert got.gradient[row.id, row.t] == pytest.approx((-1 if row.y == 1 else 1) * q.sum() * scale, abs=1e-12)
            assert got.curvature[row.id, row.t] == pytest.approx(max((q * (1 - q)).sum() * scale, 1e-12))


def moves(series, points, seed=3):
    rng = np.random.default_rng(seed)
    return pd.DataFrame([(i, t, *(int(rng.integers(0, 4)) for _ in range(5))) for i in range(series) for t in range(1, points(i) + 1)], columns=["id", "t", "s1", "s2", "s3", "s4", "following"])


def test_law_interval(spark):
    frame = moves(70, lambda i: 3 + i % 5)
    got = states.law_interval(relation(spark, frame), "s1", "following", 40).frame(spark).toPandas().set_index(["a", "b"])
    known = frame[(frame.s1 < 3) & (frame.following < 3)]
    ids = sorted(known.id.unique())
    tables = np.zeros((len(ids), 3, 3))
    for k, i in enumerate(ids):
        own = known[known.id == i]
        for a, b in zip(own.s1, own.following, strict=True):
            tables[k, a, b] += 1 / len(own)
    weights = statistics.draws(relation(spark, pd.DataFrame({"id": ids})), 40).frame(spark).toPandas().pivot(index="replicate", columns="id", values="weight").fillna(0).to_numpy()
    assert len(ids) >= 64 and weights.shape == (41, len(ids)) and (weights.sum(axis=1) == len(ids)).all()
    laws = np.einsum("rk,kab->rab", weights, tables) + 0.5
    laws /= laws.sum(axis=2, keepdims=True)
    for a in range(3):
        for b in range(3):
            low, high = np.quantile(laws[1:, a, b], [0.025, 0.975])
            assert got.loc[(a, b), ["point", "low", "high", "series"]].tolist() == pytest.approx([laws[0, a, b], low, high, len(ids)])
    assert states.law_interval(relation(spark, frame), "s1", "following", 4, least=1000).frame(spark).count() == 0


def test_phase_support(spark):
    frame = moves(6, lambda i: 7 + 14 * i)
    got = states.phase_support(relation(spark, frame)).frame(spark).toPandas().set_index(["domain", "phase", "family", "code"])
    ends = [9, 24, 49, 99, 199, 399, math.inf]
    frame["domain"] = [next(k for k, end in enumerate(ends, 1) if t - 1 <= end) for t in frame.t]
    frame["phase"] = (frame.t - 1) % 8
    seen = 0
    for d in range(8):
        part = frame if d == 0 else frame[frame.domain == d]
        able = [i for i, own in part.groupby("id") if own.phase.nunique() == 8]
        for phase in range(9) if able else []:
            for family in range(1, 5):
                for code in range(4):
                    shares = []
                    for i in able:
                        own = part[(part.id == i) & ((part.phase == phase) | (phase == 8))]
                        shares.append((own[f"s{family}"] == code).mean())
                    if sum(shares):
                        seen += 1
                        assert got.frequency[d, phase, family, code] == pytest.approx(np.mean(shares)) and got.series[d, phase, family, code] == len(able)
    assert seen == len(got) > 100
