"""Operators against loops: the closed forms, metrics and states are held against step-by-step versions."""

import math

import numpy as np
import pandas as pd
import pytest

from tidemark.functions import kit, linear
from tidemark.functions.numeric import normal_distribution, normal_quantile
from tidemark.operators import alarms, base_bank, blocks, evidence, inputs, metrics, splits, states, statistics
from tidemark.operators import whitening as white
from tidemark.operators.components import components
from tidemark.plans.relation import Relation, num
from tidemark.sources import panel as panels
from tidemark.sources import synthetic


def series(n=3, h=120, o=90, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        x = rng.normal(5 + i, 1 + i, h + o)
        x[h + 40 :] += 1.0
        rows += [(i, k, 1 if k < h else 2, float(v)) for k, v in enumerate(x)]
    return pd.DataFrame(rows, columns=["id", "time", "period", "value"])


@pytest.fixture(scope="module")
def frame():
    return series()


@pytest.fixture(scope="module")
def rows(spark, frame):
    labels = spark.createDataFrame([(0, 40), (1, -1), (2, None)], "id long, tau long")
    return panels.of_frame(spark.createDataFrame(frame), labels=labels)


def table(spark, relation, *columns):
    return relation.keep("id", "t", *columns).frame(spark).orderBy("id", "t").toPandas()


def test_panel_of_a_frame(spark, rows):
    got = rows.frame(spark).toPandas()
    assert (got.groupby("id").t.max() == 90).all() and (got.groupby("id").t.min() == -119).all()
    assert got[(got.id == 0) & (got.y == 1)].t.min() == 41 and got[got.id > 0].y.sum() == 0


def test_disorder_is_found(spark, frame):
    good = spark.createDataFrame(frame)
    assert panels.disorder(good).frame(spark).count() == 0
    bad = frame.copy()
    bad.loc[5, "time"] = 4
    bad.loc[130, "period"] = 1
    bad.loc[300, "period"] = 3
    assert panels.disorder(spark.createDataFrame(bad)).frame(spark).count() >= 4


def test_recurrences(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    rel = Relation.of(spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(x)], "id long, t long, x double"))
    rel = rel.add(c=kit.running("x - 0.1e0"), l=kit.running(kit.scaled_up("x - 0.2e0", 0.97)))
    got = table(spark, rel.add(cusum=kit.reflected("c"), leak=kit.leaky("l", 0.97), ew=kit.ewma("x", 0.2, "0.5e0"), dm=kit.decayed_max("x", 0.9)), "cusum", "leak", "ew", "dm")
    s, k, e, m, want = 0.0, 0.0, 0.5, 0.0, []
    for v in x:
        s, k, e, m = max(0, s + v - 0.1), max(0, 0.97 * k + v - 0.2), e + 0.2 * (v - e), max(0.9 * m, v)
        want.append((s, k, e, m))
    assert np.allclose(got[["cusum", "leak", "ew", "dm"]], want, atol=1e-9)


def test_numeric_functions(spark):
    p = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    got = spark.createDataFrame([(v,) for v in p], "p double").selectExpr(f"{normal_quantile('p')} AS q").selectExpr("q", f"{normal_distribution('q')} AS p").toPandas()
    assert np.allclose(got.q, [-3.090232306, -2.053748911, -0.524400513, 0, 1.281551566, 3.090232306], atol=1e-6)
    assert np.allclose(got.p, p, atol=1e-6)


def bank_loop(h, o, s=base_bank.Settings()):
    mean, sd, med = h.mean(), max(h.std(ddof=1), 1e-8), np.median(h)
    mad = max(np.median(abs(h - med)) * 1.4826, sd * 0.01, 1e-8)
    z = np.clip((h - mean) / sd, -20, 20)
    cuts = np.quantile(z, s.cuts)

    def stats(v, past, phi):
        err = v - phi * past[1]
        b = int((v > cuts).sum())
        return np.array([v, v * v, abs(v), abs(v) > 2, abs(v) > 3, v > 0, *(v * past[k] for k in s.lags), err, err * err, *(b == j for j in range(5))], float)

    base = np.zeros(17)
    base[:6] = [z.mean(), (z * z).mean(), abs(z).mean(), (abs(z) > 2).mean(), (abs(z) > 3).mean(), (z > 0).mean()]
    base[6:10] = [(z[k:] * z[:-k]).mean() for k in s.lags]
    phi = np.clip(base[6] / max(base[1], 1e-8), -0.99, 0.99)
    err = z[1:] - phi * z[:-1]
    base[10:12] = [err.mean(), (err * err).mean()]
    base[12:] = [np.mean([(v > cuts).sum() == j for v in z]) for j in range(5)]
    ew, past, out = [base.copy() for _ in s.scales], list(z), []
    up = down = run = worst = fade = 0.0
    for t, x in enumerate(o, 1):
        v = np.clip((x - mean) / sd, -20, 20)
        up, down, run = max(0, up + v - 0.25), max(0, down - v - 0.25), run + (v - run) / t
        st = stats(v, {k: past[-k] for k in s.lags}, phi)
        row, parts = {"z": v, "robust_z": np.clip((x - med) / mad, -20, 20), "cusum_positive": math.log1p(up), "cusum_negative": math.log1p(down), "running_mean": run}, []
        for i, k in enumerate(s.scales):
            ew[i] = ew[i] + (st - ew[i]) / k
            root = math.sqrt(sum((1 - 1 / k) ** j for j in range(t)))
            row |= {f"mean_z_{k}": (ew[i][0] - base[0]) * root, f"log_variance_ratio_{k}": math.log(max(ew[i][1] - ew[i][0] ** 2, 1e-8) / max(base[1] - base[0] ** 2, 1e-8)), f"tail2_delta_{k}": (ew[i][3] - base[3]) * root / math.sqrt(max(base[3] * (1 - base[3]), 0.01)), f"quantile_l1_{k}": abs(ew[i][12:] - base[12:]).sum() * root, f"lag4_delta_{k}": (ew[i][8] - base[8]) * root, f"ar_log_second_ratio_{k}": math.log(max(ew[i][11], 1e-8) / max(base[11], 1e-8))}
            parts += [abs(row[f"mean_z_{k}"]) / 3, abs(row[f"log_variance_ratio_{k}"]), abs((ew[i][6] - base[6]) * root) / 3]
        worst, fade = max(worst, *parts), max(fade * 0.99, *parts)
        past.append(v)
        out.append(row | {"evidence_max": worst, "evidence_decayed_max": fade})
    return pd.DataFrame(out)


def test_base_bank_is_the_loop(spark, rows, frame):
    got = base_bank.features(rows).frame(spark).toPandas().sort_values(["id", "t"])
    for i, own in frame.groupby("id"):
        want = bank_loop(own[own.period == 1].value.to_numpy(), own[own.period == 2].value.to_numpy())
        assert np.allclose(got[got.id == i][want.columns], want, atol=1e-8)


def test_suffix_does_not_change_the_prefix(spark, frame):
    cut = frame[~((frame.period == 2) & (frame.time > 150))]
    both = [table(spark, evidence.likelihood_ratios(white.innovations(panels.of_frame(spark.createDataFrame(f)))), *evidence.LIKELIHOOD) for f in (frame, cut)]
    joined = both[1].merge(both[0], on=["id", "t"])
    assert len(joined) == len(both[1])
    for c in evidence.LIKELIHOOD:
        assert np.allclose(joined[f"{c}_x"], joined[f"{c}_y"])


@pytest.mark.parametrize("values", [[1.0] * 40, [float("nan"), float("inf")] * 20, [1e308, -1e308] * 20, [0.0]])
def test_degenerate_histories(spark, values):
    n = max(1, len(values) // 2)
    f = pd.DataFrame([(0, i, 1 if i < n else 2, v) for i, v in enumerate([*values, 1.0, float("nan"), float("-inf")])], columns=["id", "time", "period", "value"])
    got = base_bank.features(panels.of_frame(spark.createDataFrame(f))).keep("z", "missing", "evidence_max").frame(spark).toPandas()
    assert np.isfinite(got.z).all() and np.isfinite(got.evidence_max).all() and got.missing.sum() >= 2


def whiten_loop(x, n):
    h = x[:n]
    med = np.median(h)
    unit = max(1.4826 * np.median(abs(h - med)), h.std() * 0.01, 1e-8)
    v = np.clip((x - med) / unit, -12, 12)
    v -= v[:n].mean()
    gram, right = (v[: n - 1] ** 2).sum(), (v[: n - 1] * v[1:n]).sum()
    k = np.clip(right / (gram + max(gram * 0.001, 1e-8)), -0.995, 0.995)
    return v[1:] - k * v[:-1]


def test_innovations_and_grids(spark, rows, frame):
    inn = white.innovations(rows)
    got = table(spark, evidence.mixtures(inn), *evidence.MIXTURES)
    glr = table(spark, evidence.likelihood_ratios(inn), *evidence.LIKELIHOOD)
    for i, own in frame.groupby("id"):
        r = whiten_loop(own.value.to_numpy(), 120)
        z = np.clip((r - r[:119].mean()) / r[:119].std(), -12, 12)
        w = ((z - z[:119].mean()) / z[:119].std())[119:]
        for t in (1, 3, 40, 90):
            s = {a: w[t - a : t].sum() for a in evidence.AGES if a <= t}
            q = {a: (w[t - a : t] ** 2).sum() for a in s}
            g = glr[(glr.id == i) & (glr.t == t)].iloc[0]
            assert g.glr_mean == pytest.approx(max(s[a] ** 2 / (2 * a) for a in s))
            assert g.glr_variance == pytest.approx(max(0.5 * a * (q[a] / a - 1 - math.log(q[a] / a)) for a in s))
            assert g.glr_mean_mix == pytest.approx(math.log(np.mean([math.exp(s[a] ** 2 / (2 * a)) for a in s])))
            width = dict(zip(evidence.AGES, evidence.widths(evidence.AGES), strict=True))
            b = sum(width[a] * math.exp(-0.5 * math.log1p(a) + 0.5 * s[a] ** 2 / (1 + a)) for a in s) / sum(width[a] for a in s)
            row = got[(got.id == i) & (got.t == t)].iloc[0]
            assert row.bayes_prior1 == pytest.approx(math.log(b))
            v = sum(width[a] / 4 * math.exp(-0.5 * a * math.log(x) + 0.5 * q[a] * (1 - 1 / x)) for a in s for x in evidence.RATIOS) / sum(width[a] for a in s)
            assert row.bayes_variance_mix == pytest.approx(math.log(v))


def test_hazard_is_the_filter(spark, rows, frame):
    inn = white.innovations(rows, "arch1")
    z = white.standard(inn).frame(spark).toPandas()
    got = table(spark, evidence.hazard(inn), "any_64", "mean_up_256", "scale_up_1024")
    for i in frame.id.unique():
        w = np.clip(z[(z.id == i) & (z.t > 0)].sort_values("t").w, -6, 6)
        for h, col, part in ((1 / 64, "any_64", slice(0, 10)), (1 / 256, "mean_up_256", slice(3, 6)), (1 / 1024, "scale_up_1024", slice(8, 10))):
            state = np.full(11, -np.inf)
            state[0] = 0
            for v in w:
                ll = np.array([m * v - 0.5 * m * m for m in evidence.MEANS] + [-0.5 * math.log(s) + 0.5 * (1 - 1 / s) * v * v for s in evidence.VARIANCES])
                state[1:] = np.logaddexp(state[1:], state[0] + math.log(h / 10)) + ll
                state[0] += math.log1p(-h)
            want = np.logaddexp.reduce(state[1:][part]) - state[0]
            assert got[(got.id == i)].iloc[-1][col] == pytest.approx(np.clip(want, -80, 80), abs=1e-6)


def test_serial_variance(spark):
    for rho in (-0.9, 0.0, 0.6):
        for n in (1, 2, 8, 64):
            sql = f"{num(n)} + 2e0 * {num(rho)} * ({num(n)} * (1e0 - {num(rho)}) - (1e0 - pow({num(rho)}, {num(n)}))) / ((1e0 - {num(rho)}) * (1e0 - {num(rho)}))"
            want = n + 2 * sum((n - k) * rho**k for k in range(1, n))
            assert spark.sql(f"SELECT {sql}").first()[0] == pytest.approx(want)


def test_two_pole_is_an_average_of_an_average(spark, rows):
    inn = white.innovations(rows)
    x = white.standard(inn).keep("id", "t", "w").frame(spark).toPandas()
    got = table(spark, evidence.two_pole(inn), "one_8", "two_32")
    for i in x.id.unique():
        w = np.clip(x[(x.id == i) & (x.t > 0)].sort_values("t").w.to_numpy(), -8, 8)
        for half, col, second in ((8, "one_8", False), (32, "two_32", True)):
            a = evidence.alpha(half)
            u = v = vu = vv = cov = 0.0
            for e in w:
                b = 1 - a
                vv, cov, vu = b * b * vv + a * a * b * b * vu + 2 * a * b * b * cov + a**4, b * b * cov + a * b * b * vu + a**3, b * b * vu + a * a
                u = b * u + a * e
                v = b * v + a * u
            want = math.tanh(v / math.sqrt(vv)) if second else math.tanh(u / math.sqrt(vu))
            assert got[got.id == i].iloc[-1][col] == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(("y", "p", "t", "want"), [([0, 1, 0], [0.5] * 3, [0] * 3, 0.5), ([0, 1], [0, 1], [0, 0], 1), ([0, 1], [1, 0], [0, 0], 0), ([0, 0], [1, 0], [0, 0], 0.5), ([0, 1, 0, 0, 1], [0, 1, 1, 1, 0], [0, 0, 1, 1, 1], 1 / 3), ([0, 1, 1], [0.1, 0.1, 0.2], [0, 0, 0], 0.75)])
def test_ts_auc_identities(spark, y, p, t, want):
    df = spark.createDataFrame([(i, int(b), float(a), int(c)) for i, (a, b, c) in enumerate(zip(p, y, t, strict=True))], "id long, y long, p double, t long")
    assert metrics.ts_auc(Relation.of(df)).frame(spark).first().ts_auc == pytest.approx(want)


def pairs(df):
    pos, neg = df[df.y == 1], df[df.y == 0]
    both = pos.merge(neg, on="t", suffixes=("", "_n"))
    return both.assign(win=(both.p > both.p_n) + 0.5 * (both.p == both.p_n))


def test_metrics_equal_all_pairs(spark):
    rng = np.random.default_rng(3)
    df = pd.DataFrame({"id": np.repeat(np.arange(30), 20), "t": np.tile(np.arange(20), 30), "p": rng.integers(0, 6, 600) / 6})
    df["y"] = ((df.id % 2 == 0) & (df.t > 8)).astype(int)
    rel, both = Relation.of(spark.createDataFrame(df)), pairs(df)
    auc = both.win.mean()
    assert metrics.ts_auc(rel).frame(spark).first().ts_auc == pytest.approx(auc)
    credit = metrics.pair_credit(rel).frame(spark).toPandas()
    assert credit.credit.sum() == pytest.approx(both.win.sum())
    weights = statistics.draws(rel.then("SELECT DISTINCT id FROM $1"), 5)
    w = weights.frame(spark).toPandas()
    assert (w.groupby("replicate").weight.sum() == 30).all() and (w[w.replicate == 0].weight == 1).all()
    got = metrics.weighted_ts_auc(rel, weights).frame(spark).toPandas().set_index("replicate").ts_auc
    for r, own in w.groupby("replicate"):
        m = own.set_index("id").weight
        k = both.id.map(m).fillna(0) * both.id_n.map(m).fillna(0)
        assert got[r] == pytest.approx((k * both.win).sum() / k.sum())
    influence = statistics.influence(rel).frame(spark).toPandas()
    assert abs(influence.influence.sum()) < 1e-12
    assert metrics.auc_by_time(rel).frame(spark).toPandas().pairs.sum() == len(both)


def test_alarms(spark):
    rows = [(i, t, 0.1 * i + (0.5 if i == 7 and t > 12 else 0), 10 if i == 7 else None) for i in range(8) for t in range(1, 21)]
    rel = Relation.of(spark.createDataFrame(rows, "id long, t long, p double, tau long"))
    cut = alarms.threshold(rel, 0.3)
    assert cut.frame(spark).first().threshold == pytest.approx(0.5)
    got = alarms.first_alarms(rel, cut).frame(spark).toPandas().set_index("id")
    assert got.loc[6].false_alarm == 1 and got.loc[5].false_alarm == 0 and got.loc[7].premature == 1
    total = alarms.summary(alarms.first_alarms(rel, cut)).frame(spark).first()
    assert total.nulls == 7 and total.false_alarms == 1 and total.rate_low < total.rate < total.rate_high
    assert alarms.threshold(rel, 0.01).frame(spark).count() == 0


def test_holm(spark):
    df = spark.createDataFrame([("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005)], "name string, p_value double")
    got = {r.name: r.adjusted for r in statistics.holm(Relation.of(df)).frame(spark).collect()}
    assert got == pytest.approx({"d": 0.02, "a": 0.03, "c": 0.06, "b": 0.06})


def test_splits(spark):
    import hashlib

    ids = Relation.of(spark.range(300))
    got = splits.assigned(ids).frame(spark).toPandas()
    for r in got.itertuples():
        role = int(hashlib.sha256(f"{splits.SEED}:role:{r.id}".encode()).hexdigest(), 16)
        fold = int(hashlib.sha256(f"{splits.SEED}:fold:{r.id}".encode()).hexdigest(), 16) % 5
        assert (r.role == "LOCAL_FINAL_SEAL") == (role < 2**256 // 5) and r.fold == (-1 if role < 2**256 // 5 else fold)


@pytest.mark.parametrize("n", [1, 9, 32, 33, 256, 257, 1000])
def test_samples(spark, n):
    rows = Relation.of(spark.range(1, n + 1).selectExpr("0 AS id", "id AS t", "0 AS y"))
    got = splits.sampled(rows).frame(spark).toPandas().sort_values("t")
    assert got[got.s1 == 1].i.tolist() == np.unique(np.linspace(0, n - 1, min(256, n)).astype(int)).tolist()
    want = []
    for a, b in zip(splits.STRATA, [*splits.STRATA[1:], n], strict=True):
        b = min(b, n)
        if b > a:
            want += np.unique(np.linspace(a, b - 1, min(32, b - a)).astype(int)).tolist()
    assert got[got.s2 == 1].i.tolist() == want


def test_movement_states(spark, rows):
    base = states.thresholds(white.innovations(rows))
    x = base.frame(spark).toPandas().sort_values(["id", "t"])
    got = states.movement(base).frame(spark).toPandas().sort_values(["id", "t"])
    for i, own in x.groupby("id"):
        v, eps = own.x.to_numpy(), own.epsilon.iloc[0]
        first = int((own.t <= 0).sum())
        for k in (0, 1, 17, 60):
            h = v[first + k - 16 : first + k]
            d = np.where(np.diff(h) > eps, 2, np.where(np.diff(h) < -eps, 0, 1))
            run = next((j for j in range(1, 15) if d[-1 - j] != d[-1]), 15)
            prior, age, to = None, 15, None
            for j, m in enumerate(d):
                if m != 1:
                    if prior is not None and m != prior:
                        age, to = 14 - j, m
                    prior = m
            r = got[(got.id == i) & (got.t == k + 1)].iloc[0]
            assert (r.s1, r.run, r.age) == (d[-1], run, age)
            assert r.changes == (d[1:] != d[:-1]).sum() and r.slope == pytest.approx((h[-8:] * np.arange(-3.5, 4)).sum() / 42)
            recent = age <= 3 and to == d[-1]
            assert r.s4 == {2: 3 if recent else 0, 0: 2 if recent else 1, 1: 4}[d[-1]]


def test_blocks(spark):
    f = series(2, 700, 200, 5)
    got = blocks.block_evidence(panels.of_frame(spark.createDataFrame(f))).frame(spark).toPandas().sort_values(["id", "block"])
    for i, own in f.groupby("id"):
        h, o = own[own.period == 1].value.to_numpy(), own[own.period == 2].value.to_numpy()
        level = lambda x: np.array([math.log(np.median(abs(b - np.median(b)))) for b in x[: len(x) // 16 * 16].reshape(-1, 16)])
        fit, cal, new = level(h[:420]), level(h[420:]), level(o)
        n, spread = len(cal), lambda x: max((np.quantile(x, 0.75) - np.quantile(x, 0.25)) / 1.349, 0.15)
        centre, sd = (n * np.median(cal) + 32 * np.median(fit)) / (n + 32), math.sqrt((n * spread(cal) ** 2 + 32 * spread(fit) ** 2) / (n + 32))
        assert np.allclose(got[got.id == i].z, np.clip((new - centre) / sd, -4, 4))
        prior = np.array([((fit < v).sum() + (fit == v).sum() / 2 + 0.5) / (len(fit) + 1) for v in new])
        u = np.array([((cal < v).sum() + (cal == v).sum() / 2 + 32 * p + 0.5) / (n + 33) for v, p in zip(new, prior, strict=True)])
        assert np.allclose(got[got.id == i].pit, np.clip(np.log(u / (1 - u)) / (math.pi / math.sqrt(3)), -4, 4))


def test_linear_solvers(spark):
    rng = np.random.default_rng(0)
    assert np.allclose(linear.stable(np.array([1.2])), [0.995])
    a = rng.normal(size=(50, 4))
    c = a.T @ a
    root = linear.inverse_root(c)
    assert np.allclose(root @ c @ root, np.eye(4), atol=1e-8)
    counts = rng.integers(1, 20, (2, 3, 3)).astype(float)
    table_ = linear.fitted_table(counts)
    assert all(np.allclose(table_.sum(axis=k), counts.sum(axis=k), rtol=1e-6) for k in range(3))
    low, high = linear.band_power(np.sin(2 * np.pi * 0.05 * np.arange(400)))
    assert low > 100 * high
    v = rng.normal(size=300)
    df = spark.createDataFrame([(0, k - 299, float(x)) for k, x in enumerate(v)], "id long, t long, v double")
    got = linear.autoregressions(df, 4).first()
    design = np.column_stack([v[3 - k : len(v) - 1 - k] for k in range(4)])
    gram = design.T @ design
    want = linear.stable(np.linalg.solve(gram + np.trace(gram) / 4 * 0.001 * np.eye(4), design.T @ v[4:]))
    assert np.allclose([got[f"k{k}"] for k in range(1, 5)], want)


def test_components(spark):
    got = components(spark.createDataFrame([(5, 3), (3, 9), (1, 2), (7, 7)], "a long, b long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1), (2, 1), (3, 3), (5, 3), (9, 3)]


def test_long_average(spark):
    x = np.random.default_rng(6).normal(size=9000)
    rel = Relation.of(spark.createDataFrame([(0, i + 1, float(v)) for i, v in enumerate(x)], "id long, t long, x double"))
    got = evidence.long_average(rel, "x", "m", 0.2, "3e0").keep("t", "m").frame(spark).orderBy("t").toPandas().m
    m, want = 3.0, []
    for v in x:
        m += 0.2 * (v - m)
        want.append(m)
    assert np.allclose(got, want, atol=1e-12)


def test_spread_auc_equals_auc(spark):
    rng = np.random.default_rng(7)
    df = pd.DataFrame({"id": np.repeat(np.arange(40), 10), "t": np.tile(np.arange(10), 40), "p": rng.integers(0, 9, 400) / 9, "y": rng.integers(0, 2, 400)})
    rows = spark.createDataFrame(df)
    a = metrics.auc_by_time(Relation.of(rows)).frame(spark).orderBy("t").toPandas()
    b = metrics.auc_by_time_spread(rows).orderBy("t").toPandas()
    assert np.allclose(a[["t", "pos", "neg", "pairs", "wins", "auc"]], b[["t", "pos", "neg", "pairs", "wins", "auc"]])


def test_quantile_map(spark, rows, frame):
    got = table(spark, inputs.quantile_mapped(base_bank.referenced(rows), knots=17), "v", "pm")
    for i, own in frame.groupby("id"):
        h = own[own.period == 1].value.to_numpy()
        p = np.linspace(0.001, 0.999, 17)
        part = got[got.id == i]
        assert np.allclose(part.pm, np.interp(part.v, np.quantile(h, p), p))


def test_drift_identity_holds(spark, rows):
    got = inputs.drift_identity(white.innovations(rows)).frame(spark).toPandas()
    for k in range(4):
        assert np.allclose(got[f"sum_{k}"], got[f"form_{k}"])


def test_second_order_is_stable(spark):
    walk = np.cumsum(np.cumsum(np.random.default_rng(8).normal(size=300)))
    f = pd.DataFrame([(0, i, 1 if i < 200 else 2, float(v)) for i, v in enumerate(walk)], columns=["id", "time", "period", "value"])
    r = inputs.second_order(panels.of_frame(spark.createDataFrame(f))).keep("a1", "a2", "shrink").frame(spark).first()
    a1, a2 = r.a1 * r.shrink, r.a2 * r.shrink
    assert np.abs(np.roots([1, -a1, -a2])).max() < 1


def test_evidence_reacts_to_its_break(spark):
    points, labels = synthetic.cohort(spark, ("no_break", "mean_up", "variance_up", "ar_up"), 3)
    kinds = points.select("id", "kind").distinct().toPandas().set_index("id").kind
    inn = white.innovations(panels.of_frame(points, labels=labels))
    last = evidence.likelihood_ratios(inn).where("t = 240").keep("id", "glr_mean", "glr_variance").frame(spark).toPandas().set_index("id").join(kinds).groupby("kind").mean()
    assert last.glr_mean["mean_up"] > 5 * last.glr_mean["no_break"]
    assert last.glr_variance["variance_up"] > 5 * last.glr_variance["no_break"]
    lag = evidence.dependence(inn).where("t = 240").keep("id", "signed_lag1_32").frame(spark).toPandas().set_index("id").join(kinds).groupby("kind").mean()
    assert lag.signed_lag1_32["ar_up"] > lag.signed_lag1_32["no_break"] + 2


def test_one_shuffle_for_a_bank(spark):
    from tidemark.plans import catalog

    plan = catalog.queries()["evidence_scale"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "l_comment" not in plan


def test_online_scorer_is_the_batch(spark, rows, frame):
    from tidemark.streaming.online import OnlineScorer, infer

    bank = base_bank.features(rows)
    got = table(spark, bank, "z", "cusum_positive", "cusum_negative", "running_mean")
    for i, own in frame.groupby("id"):
        h, o = own[own.period == 1].value.tolist(), own[own.period == 2].value.tolist()
        scorer = OnlineScorer.of(h)
        want = pd.DataFrame([scorer.update(v) for v in o])
        assert np.allclose(got[got.id == i][["z", "cusum_positive", "cusum_negative", "running_mean"]], want[["z", "cusum_positive", "cusum_negative", "running_mean"]])
    half, scorer = len(o) // 2, OnlineScorer.of(h)
    first = [scorer.update(v)["p"] for v in o[:half]]
    kept = scorer.snapshot()
    [scorer.update(1e9) for _ in range(5)]
    scorer.restore(kept)
    assert first + [scorer.update(v)["p"] for v in o[half:]] == want.p.tolist()
    assert list(infer([(h, iter(o))])) == [None, *want.p]
    seen = []

    def points():
        for v in o[:5]:
            seen.append(v)
            yield v

    for n, p in enumerate(infer([(h, points())])):
        assert len(seen) == n


def test_score_whitening(spark, rows):
    got = evidence.score_evidence(inputs.second_order(rows).add(r="r2")).frame(spark)
    m = got.select("maa", "mbb", "mab", "raa", "rbb", "rab").distinct().toPandas()
    for r in m.itertuples():
        root = np.array([[r.raa, r.rab], [r.rab, r.rbb]])
        assert np.allclose(root @ root, [[r.maa, r.mab], [r.mab, r.mbb]], rtol=1e-6)
