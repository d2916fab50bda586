"""Descriptors of histories, signatures of breaks and joint bounds, against numpy."""

import numpy as np
import pandas as pd
import pytest

from tidemark.operators import regimes, statistics
from tidemark.plans.relation import Relation


def series(name, values, n_h, tau=None):
    n = len(values)
    return pd.DataFrame({"id": name, "t": np.arange(n) - n_h + 1, "cnt": n, "n_h": n_h, "tau": tau, "value": values, "y": 0}).astype({"tau": "Int64"})


def relation(spark, frame):
    rows = [(r.id, int(r.t), int(r.cnt), int(r.n_h), None if pd.isna(r.tau) else int(r.tau), float(r.value)) for r in frame.itertuples()]
    return Relation.of(spark.createDataFrame(rows, "id string, t long, cnt long, n_h long, tau long, value double"))


def correlation(z, lag):
    if len(z) <= lag + 2:
        return 0.0
    left, right = z[:-lag] - z[:-lag].mean(), z[lag:] - z[lag:].mean()
    return float(left @ right / max(np.sqrt((left @ left) * (right @ right)), 1e-12))


def test_descriptors(spark):
    rng = np.random.default_rng(11)
    parts = {"walk": rng.normal(size=300).cumsum(), "heavy": rng.standard_t(2, 200), "flat": np.full(50, 3.0), "short": np.array([1.0, 4.0, 2.0])}
    frame = pd.concat([series(k, np.append(v, [1e6] * 4), len(v)) for k, v in parts.items()])  # online values don't count
    got = regimes.descriptors(relation(spark, frame)).frame(spark).toPandas().set_index("id")
    for k, h in parts.items():
        median, sd = np.median(h), max(h.std(), 1e-8)
        mad = max(1.4826 * np.median(np.abs(h - median)), 1e-8)
        z, r = (h - h.mean()) / sd, (h - median) / mad
        want = {"location_mean": h.mean(), "location_median": median, "log_sd": np.log(sd), "log_mad": np.log(mad), "skewness": (z**3).mean(), "log_kurtosis": np.log(max((z**4).mean(), 1e-8)), "log_length": np.log(len(h))}
        want |= {"tail2_rate": (abs(r) > 2).mean(), "tail3_rate": (abs(r) > 3).mean()} | {f"acf_{n}": correlation(np.clip(r, -12, 12), n) for n in regimes.LAGS}
        assert sorted(want) == sorted(regimes.DESCRIPTORS)
        for c, x in want.items():
            assert got.loc[k, c] == pytest.approx(x, abs=1e-7), (k, c)


def effects(values, n_h, tau, window, lags, cutoff):
    pre, post = values[: n_h + tau][-window:], values[n_h + tau :][:window]
    sd, median = max(pre.std(), 1e-8), np.median(pre)
    mad = max(1.4826 * np.median(np.abs(pre - median)), sd * 0.01, 1e-8)
    far = lambda x: (np.abs(x - median) / mad > cutoff).mean()
    return len(pre), len(post), [abs(post.mean() - pre.mean()) / sd, abs(np.log(max(post.std(), 1e-8) / sd)), max(abs(correlation(post, k) - correlation(pre, k)) for k in lags), abs(far(post) - far(pre))]


def test_mechanisms(spark):
    rng = np.random.default_rng(12)
    h = rng.normal(size=400)
    alternate = np.zeros(150)
    for i in range(1, 150):
        alternate[i] = -0.9 * alternate[i - 1] + rng.normal() * 0.43
    parts = {
        "mean": (np.r_[h, rng.normal(size=30), rng.normal(size=150) + 0.9], 30, "MEAN_DOMINANT"),
        "scale": (np.r_[h, rng.normal(size=30), rng.normal(size=150) * 0.3], 30, "SCALE_DOMINANT"),
        "dependence": (np.r_[h, rng.normal(size=30), alternate], 30, "DEPENDENCE_DOMINANT"),
        "same": (np.r_[h, np.tile(h[-128:], 2)], 0, "WEAK_OR_AMBIGUOUS"),
        "late": (np.r_[h, rng.normal(size=50)], 40, "WEAK_OR_AMBIGUOUS"),
        "beyond": (np.r_[h, rng.normal(size=20)], 99, "WEAK_OR_AMBIGUOUS"),
        "none": (np.r_[h, rng.normal(size=80)], None, "NO_BREAK_CONTROL"),
    }
    frame = pd.concat([series(k, v, 400, tau) for k, (v, tau, _) in parts.items()])
    got = regimes.mechanisms(relation(spark, frame)).frame(spark).toPandas().set_index("id")
    for k, (v, tau, name) in parts.items():
        assert got.signature[k] == name, k
        if k in ("mean", "scale", "dependence", "same"):
            n, m, want = effects(v, 400, tau, 128, (1, 2, 4), 3.0)
            assert (got.pre_count[k], got.post_count[k]) == (n, m)
            assert np.allclose(got.loc[k, regimes.EFFECTS].astype(float), want, atol=1e-9), k
        else:
            assert not got.loc[k, regimes.EFFECTS].astype(float).any()


def test_joint_envelope(spark):
    rng = np.random.default_rng(13)
    values = rng.normal([0.5, 0.0, -0.2], [0.1, 0.2, 0.05], size=(61, 3))
    rows = [(i, f"c{j}", float(values[i, j])) for i in range(61) for j in range(3)] + [(i, "fixed", 0.25) for i in range(61)]
    got = statistics.joint_envelope(Relation.of(spark.createDataFrame(rows, "replicate long, name string, value double"))).frame(spark).toPandas().set_index("name")
    se = values[1:].std(axis=0, ddof=1)
    critical = np.quantile((np.abs(values[1:] - values[0]) / se).max(axis=1), 0.95)
    for j in range(3):
        row = got.loc[f"c{j}"]
        assert np.allclose([row.own, row.se, row.critical], [values[0, j], se[j], critical])
        assert np.allclose([row.low, row.high], np.quantile(values[1:, j], [0.025, 0.975])) and row.positive == pytest.approx((values[1:, j] > 0).mean())
        assert row.joint_low == pytest.approx(values[0, j] - critical * se[j]) and row.above == int(row.joint_low > 0)
    assert np.isnan(got.loc["fixed", "joint_low"]) and got.loc["fixed", "above"] == 0
