"""Sequential evidence: statistics of the online innovations against the history, one column each.

Every function takes rows with id, t, y and z (history included where it is needed) and gives online rows with its outputs. Windows share one partitioning
by id. Sums over the last n points are differences of one running sum, so a grid of ages costs lags and no frames of its own.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tidemark.functions import kit
from tidemark.operators.whitening import history, median, standard, uniform
from tidemark.plans.relation import Relation, num

# Half-lives, drifts, lags, ages with the widths that they stand for, and the alternatives of mixtures.
HALVES, DRIFTS, LAGS = (8, 32, 128), (0.1, 0.25, 0.5), (1, 2, 4, 8)
AGES = (1, 2, 4, 8, 16, 32, 64, 128)
AMPLITUDES, RATIOS = (-0.25, 0.25, -0.5, 0.5, -1.0, 1.0), (0.5, 0.75, 1.5, 2.0)
MEANS, VARIANCES = (-1.0, -0.5, -0.25, 0.25, 0.5, 1.0), (0.5, 0.75, 1.5, 2.0)
HAZARDS = (1 / 64, 1 / 256, 1 / 1024)


def alpha(half: float) -> float:
    return 1 - math.exp(-math.log(2) / half)


def widths(ages: tuple[int, ...]) -> list[int]:
    return [a - b for a, b in zip(ages, (0, *ages[:-1]), strict=True)]


def noise(half: float, floor: float = 1e-10) -> str:
    return kit.ewma_noise(alpha(half), floor)


def long_average(rows: Relation, x: str, name: str, weight: float, start: str = "0e0") -> Relation:
    """Adds kit.ewma() for series of any length: chunks of as many points as keep the powers in range, each with what the chunk before left.

    A chunk spans 300 time constants, so that what lies two chunks back is below the smallest double.
    """
    rate = -math.log1p(-weight)
    span = max(1, int(300 / rate))
    rows = rows.add(**{f"{name}_chunk": f"cast(floor((t - 1) / {num(span)}) AS bigint)", f"{name}_place": f"(t - 1) % {span} + 1"})
    rows = rows.add(**{f"{name}_own": f"sum({x} * exp({num(rate)} * {name}_place)) OVER (PARTITION BY id, {name}_chunk ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"})
    rows = rows.add(**{f"{name}_left": f"coalesce(KNOWN(CASE WHEN {name}_place = {span} THEN {name}_own END) {kit.BEFORE}, 0e0)"})
    return rows.add(**{name: f"{start} * exp(-{num(rate)} * t) + {num(weight)} * exp(-{num(rate)} * {name}_place) * ({name}_own + {num(math.exp(-rate * span))} * {name}_left)"})


def scores(rows: Relation, x: str, name: str, halves: tuple[int, ...] = HALVES, floor: float = 1e-10) -> Relation:
    """Adds moving averages of x from 0 in units of their noise, one for each half-life."""
    return rows.add(**{f"{name}_{h}": f"{kit.ewma(x, alpha(h))} / {noise(h, floor)}" for h in halves})


def cusums(rows: Relation, x: str, name: str, drifts: tuple[float, ...] = DRIFTS) -> Relation:
    """Adds log(1 + s) of reflected sums in both directions, one for each drift."""
    keys = [(f"{name}_{way}_{round(d * 100):03d}", f"{sign}({x}) - {num(d)}") for d in drifts for way, sign in (("up", ""), ("down", "-"))]
    rows = rows.add(**{f"{k}_sum": kit.running(step) for k, step in keys})
    return rows.add(**{k: f"ln(1e0 + {kit.reflected(f'{k}_sum')})" for k, _ in keys})


def suffixes(rows: Relation, total: str, name: str, ages: tuple[int, ...] = AGES, whole: bool = False) -> Relation:
    """Adds the sum over the last n points from a running sum; null before there are n, or all points with whole."""
    form = "{c} - coalesce(lag({c}, {n}) OVER (PARTITION BY id ORDER BY t), 0e0)"
    return rows.add(**{f"{name}{n}": form.format(c=total, n=n) if whole else f"CASE WHEN t >= {n} THEN {form.format(c=total, n=n)} END" for n in ages})


def log_mix(terms: list[str], count: str) -> str:
    return f"{kit.log_sum(terms)} - ln({count})"


def _known(columns: list[str], weights: list[int] | None = None) -> str:
    return " + ".join(f"CASE WHEN {c} IS NOT NULL THEN {num(w)} ELSE 0e0 END" for c, w in zip(columns, weights or [1] * len(columns), strict=True))


def location(rows: Relation) -> Relation:
    """Moving averages, reflected sums and the Page-Hinkley statistic of the mean."""
    rows = cusums(scores(standard(rows).where("t > 0"), "w", "mean"), "w", "cusum")
    rows = rows.add(mean_w=f"{kit.running('w')} / t").add(ph_up=kit.running("w - mean_w - 0.1e0"), ph_down=kit.running("mean_w - w - 0.1e0"))
    return rows.add(page_up=f"ln(1e0 + {kit.reflected('ph_up')})", page_down=f"ln(1e0 + {kit.reflected('ph_down')})")


LOCATION = [*(f"mean_{h}" for h in HALVES), *(f"cusum_{w}_{round(d * 100):03d}" for d in DRIFTS for w in ("up", "down")), "page_up", "page_down"]


def energies(rows: Relation) -> Relation:
    rows = standard(rows).add(square="w * w", size="abs(w)", log_energy="ln(w * w + 1e-4)")
    return rows.add(**{f"{c}_mu": history("avg", c) for c in ("size", "log_energy")}, **{f"{c}_sd": f"greatest(coalesce({history('stddev_pop', c)}, 0e0), 1e-4)" for c in ("square", "size", "log_energy")})


def scale(rows: Relation) -> Relation:
    """Ratios and differences of second moments, absolute moments and log energies, and reflected sums of the scaled square."""
    rows = energies(rows).where("t > 0")
    rows = rows.add(**{f"m{h}": kit.ewma("w", alpha(h)) for h in HALVES}, **{f"q{h}": kit.ewma("square", alpha(h), "1e0") for h in HALVES}, **{f"a{h}": kit.ewma("size", alpha(h), "size_mu") for h in HALVES}, **{f"l{h}": kit.ewma("log_energy", alpha(h), "log_energy_mu") for h in HALVES})
    columns = {}
    for h in HALVES:
        columns |= {f"log_second_{h}": f"ln(greatest(q{h}, 1e-8))", f"log_variance_{h}": f"ln(greatest(q{h} - m{h} * m{h}, 1e-8))", f"size_delta_{h}": f"(a{h} - size_mu) / (size_sd * {noise(h)})", f"energy_delta_{h}": f"(l{h} - log_energy_mu) / (log_energy_sd * {noise(h)})"}
    return cusums(rows.add(**columns, scaled="(square - 1e0) / square_sd"), "scaled", "scale")


SCALE = [*(f"{c}_{h}" for h in HALVES for c in ("log_second", "log_variance", "size_delta", "energy_delta")), *(f"scale_{w}_{round(d * 100):03d}" for d in DRIFTS for w in ("up", "down"))]


def dependence(rows: Relation) -> Relation:
    """Lagged products of the signed, absolute and squared innovation, averaged and standardised."""
    rows = energies(rows).add(p0="w", p1="size - size_mu", p2="square - 1e0")
    keys = [(k, j) for k in range(3) for j in LAGS]
    rows = rows.add(**{f"p{k}_{j}": f"p{k} * {kit.lag(f'p{k}', j)}" for k, j in keys})
    rows = rows.add(**{f"p{k}_{j}_mu": history("avg", f"p{k}_{j}") for k, j in keys}, **{f"p{k}_{j}_sd": f"greatest(coalesce({history('stddev_pop', f'p{k}_{j}')}, 0e0), 1e-4)" for k, j in keys}).where("t > 0")
    return rows.add(**{f"{n}_lag{j}_{h}": f"({kit.ewma(f'p{k}_{j}', alpha(h), f'p{k}_{j}_mu')} - p{k}_{j}_mu) / (p{k}_{j}_sd * {noise(h)})" for h in HALVES for k, n in enumerate(("signed", "absolute", "squared")) for j in LAGS})


DEPENDENCE = [f"{n}_lag{j}_{h}" for h in HALVES for n in ("signed", "absolute", "squared") for j in LAGS]


def distribution(rows: Relation, bins: int = 16) -> Relation:
    """Distances of the averaged histogram of u from the history's, and its tail and central masses."""
    rows = rows.add(cell=f"cast(least(floor(u * {num(bins)}), {num(bins - 1)}) AS int)", low=kit.flag("u < 0.05e0"), high=kit.flag("u > 0.95e0"), middle=kit.flag("u >= 0.25e0 AND u <= 0.75e0"))
    rows = rows.add(**{f"in{k}": kit.flag(f"cell <= {k}") for k in range(bins - 1)})
    names = ["low", "high", "middle", *(f"in{k}" for k in range(bins - 1))]
    rows = rows.add(**{f"{c}_mu": history("avg", c) for c in names}).where("t > 0")
    columns = {}
    for h in HALVES:
        null = f"greatest({num(alpha(h) / (2 - alpha(h)))} * (1e0 - exp({num(2 * math.log1p(-alpha(h)))} * t)), 1e-10)"
        columns |= {f"{c}_{h}": f"{kit.ewma(c, alpha(h), f'{c}_mu')} - {c}_mu" for c in names} | {f"null_{h}": null}
    rows = rows.add(**columns)
    columns = {}
    for h in HALVES:
        square = [f"in{k}_{h} * in{k}_{h}" for k in range(bins - 1)]
        columns |= {f"cvm_{h}": f"({' + '.join(square)}) / ({num(bins)} * null_{h})"}
        columns |= {f"ad_{h}": f"({' + '.join(f'{s} / greatest(in{k}_mu * (1e0 - in{k}_mu), 0.01e0)' for k, s in enumerate(square))}) / ({num(bins)} * null_{h})"}
        columns |= {f"{c}_delta_{h}": f"{c}_{h} / sqrt(greatest({c}_mu * (1e0 - {c}_mu) * null_{h}, 1e-8))" for c in ("low", "high", "middle")}
    return rows.add(**columns)


DISTRIBUTION = [f"{c}_{h}" for h in HALVES for c in ("cvm", "ad", "low_delta", "high_delta", "middle_delta")]


def _age_sums(rows: Relation, ages: tuple[int, ...] = AGES) -> Relation:
    rows = energies(rows).where("t > 0").add(c1=kit.running("w"), c2=kit.running("square"))
    return suffixes(suffixes(rows, "c1", "s", ages), "c2", "q", ages)


def likelihood_ratios(rows: Relation) -> Relation:
    """Generalised likelihood ratios of the mean, the variance and both, over ages."""
    rows = _age_sums(rows)
    rows = rows.add(**{f"second{n}": f"greatest(q{n} / {num(n)}, 1e-8)" for n in AGES})
    rows = rows.add(
        **{f"g_mean{n}": f"CASE WHEN t >= {n} THEN s{n} * s{n} / {num(2 * n)} END" for n in AGES},
        **{f"g_var{n}": f"CASE WHEN t >= {n} THEN {num(n / 2)} * (second{n} - 1e0 - ln(second{n})) END" for n in AGES},
        **{f"g_joint{n}": f"CASE WHEN t >= {n} THEN {num(n / 2)} * (second{n} - 1e0 - ln(greatest(second{n} - s{n} * s{n} / {num(n * n)}, 1e-8))) END" for n in AGES if n >= 4},
    )
    mean, var, joint = [f"g_mean{n}" for n in AGES], [f"g_var{n}" for n in AGES], [f"g_joint{n}" for n in AGES if n >= 4]
    rows = rows.add(glr_mean=f"greatest({', '.join(mean)}, 0e0)", glr_variance=f"greatest({', '.join(var)}, 0e0)", glr_joint=f"greatest({', '.join(joint)}, 0e0)", count=_known(mean))
    rows = rows.add(glr_mean_mix=log_mix(mean, "count"), glr_variance_mix=log_mix(var, "count"))
    return rows.add(glr_both="greatest(glr_mean, glr_variance) - ln(2e0 * count)", age_mean=f"cast({kit.best_of(mean, [str(n) for n in AGES])} AS int)", age_variance=f"cast({kit.best_of(var, [str(n) for n in AGES])} AS int)")


LIKELIHOOD = ["glr_mean", "glr_variance", "glr_joint", "glr_mean_mix", "glr_variance_mix", "glr_both"]


def mixtures(rows: Relation) -> Relation:
    """Log Bayes factors over ages: normal priors on the mean, and grids of amplitudes and variance ratios."""
    rows = _age_sums(rows)
    columns = {}
    for n, w in zip(AGES, widths(AGES), strict=True):
        log_w, known = num(math.log(w)), f"CASE WHEN t >= {n} THEN {{}} END"
        columns |= {f"b025_{n}": known.format(f"{num(math.log(w) - 0.5 * math.log1p(0.25 * n))} + {num(0.125 / (1 + 0.25 * n))} * s{n} * s{n}"), f"b1_{n}": known.format(f"{num(math.log(w) - 0.5 * math.log1p(n))} + {num(0.5 / (1 + n))} * s{n} * s{n}")}
        columns |= {f"amp{i}_{n}": known.format(f"{log_w} + {num(a)} * s{n} - {num(0.5 * n * a * a + math.log(6))}") for i, a in enumerate(AMPLITUDES)}
        columns |= {f"rat{i}_{n}": known.format(f"{num(math.log(w) - 0.5 * n * math.log(v) - math.log(4))} + {num(0.5 * (1 - 1 / v))} * q{n}") for i, v in enumerate(RATIOS)}
    rows = rows.add(**columns, width=_known([f"s{n}" for n in AGES], widths(AGES)))
    parts = {"prior025": [f"b025_{n}" for n in AGES], "prior1": [f"b1_{n}" for n in AGES], "amplitude": [f"amp{i}_{n}" for n in AGES for i in range(6)], "variance_mix": [f"rat{i}_{n}" for n in AGES for i in range(4)]}
    rows = rows.add(**{f"bayes_{k}": log_mix(v, "width") for k, v in parts.items()})
    rows = rows.add(bayes_joint=f"{kit.log_add('bayes_amplitude', 'bayes_variance_mix')} - ln(2e0)")
    return rows.add(bayes_score=f"1e0 / (1e0 + exp(-{kit.clip('bayes_joint', 30)}))")


MIXTURES = ["bayes_prior025", "bayes_prior1", "bayes_amplitude", "bayes_variance_mix", "bayes_joint", "bayes_score"]


def memory(rows: Relation) -> Relation:
    """What remains of the evidence: its maximum, a decayed maximum, a leaky sum and a latch that opens at 3 and closes under 1."""
    rows = scale(rows)
    rows = rows.add(evidence=kit.biggest(*(f"abs(m{h}) / {noise(h)}" for h in HALVES), *(f"abs({c}_delta_{h})" for h in HALVES for c in ("size", "energy"))))
    decay = math.exp(-math.log(2) / 32)
    rows = rows.add(leak_sum=kit.running(kit.scaled_up("evidence - 1e0", decay)), mark="CASE WHEN evidence >= 3e0 THEN 1 WHEN evidence < 1e0 THEN 0 END")
    return rows.add(memory_max=kit.running("evidence", "max"), memory_decayed=kit.decayed_max("evidence", decay), memory_leaky=kit.leaky("leak_sum", decay), latch=f"coalesce(KNOWN(mark) {kit.UPTO}, 0)")


MEMORY = ["evidence", "memory_max", "memory_decayed", "memory_leaky", "latch"]


def channel(rows: Relation, x: str, ages: tuple[int, ...] = AGES, serial: bool = False) -> Relation:
    """The thirteen statistics of one calibrated channel. With serial, sums are judged against their variance under the history's lag-1 correlation."""
    rows = rows.add(now=kit.clip(x, 12))
    if serial:
        rows = rows.add(now1=kit.lag("now"))
        pair = "CASE WHEN t <= 0 AND now1 IS NOT NULL THEN {} END"
        rows = rows.add(left_mu=f"avg({pair.format('now1')}) OVER (PARTITION BY id)", right_mu=f"avg({pair.format('now')}) OVER (PARTITION BY id)")
        rows = rows.add(**{k: f"sum({pair.format(e)}) OVER (PARTITION BY id)" for k, e in (("cxx", "(now1 - left_mu) * (now1 - left_mu)"), ("cyy", "(now - right_mu) * (now - right_mu)"), ("cxy", "(now1 - left_mu) * (now - right_mu)"))})
        rows = rows.add(rho="CASE WHEN sqrt(cxx * cyy) > 1e-12 THEN greatest(-0.95e0, least(0.95e0, cxy / sqrt(cxx * cyy))) ELSE 0e0 END").where("t > 0")
        rows = rows.add(**{f"var{n}": f"{num(n)} + 2e0 * rho * ({num(n)} * (1e0 - rho) - (1e0 - pow(rho, {num(n)}))) / ((1e0 - rho) * (1e0 - rho))" for n in ages})
    else:
        rows = rows.where("t > 0").add(**{f"var{n}": num(n) for n in ages})
    rows = cusums(scores(rows, "now", "ewma", floor=1e-12), "now", "cusum", (0.25,)).add(total=kit.running("now"))
    rows = suffixes(rows, "total", "s", ages)
    w = widths(ages)
    rows = rows.add(
        **{f"g{n}": f"0.5e0 * s{n} * s{n} / var{n}" for n in ages},
        **{f"{name}_{n}": f"CASE WHEN t >= {n} THEN {num(math.log(k))} - 0.5e0 * ln(1e0 + {num(p * n * n)} / var{n}) + {num(0.5 * p)} * {num(n * n)} / var{n} / var{n} * s{n} * s{n} / (1e0 + {num(p * n * n)} / var{n}) END" for name, p in (("b025", 0.25), ("b1", 1.0)) for n, k in zip(ages, w, strict=True)},
    )
    glr = [f"g{n}" for n in ages]
    rows = rows.add(count=_known(glr), width=_known(glr, w), glr_max=f"greatest({', '.join(glr)}, 0e0)", glr_age=f"log2({num(1)} * ({kit.best_of(glr, [num(n) for n in ages])}))")
    rows = rows.add(glr_logmean=log_mix(glr, "count"), bayes025=log_mix([f"b025_{n}" for n in ages], "width"), bayes1=log_mix([f"b1_{n}" for n in ages], "width"))
    return rows.add(memory_max=kit.running("glr_max", "max"), memory_decay=kit.decayed_max("glr_max", math.exp(-math.log(2) / 32)))


CHANNEL = ["now", *(f"ewma_{h}" for h in HALVES), "cusum_up_025", "cusum_down_025", "glr_max", "glr_logmean", "glr_age", "bayes025", "bayes1", "memory_max", "memory_decay"]


def transitions(rows: Relation, lag: int = 1, ages: tuple[int, ...] = (8, 32, 128)) -> Relation:
    """Quartile states of the value and their transitions: surprise, likelihood ratio of the counts of each window against the history's law, and stay evidence."""
    rows = rows.add(**{f"edge{i}": median("value", q) for i, q in enumerate((0.25, 0.5, 0.75))})
    rows = rows.add(state=" + ".join(f"CASE WHEN value >= edge{i} THEN 1 ELSE 0 END" for i in range(3)))
    rows = rows.add(prior=kit.lag("state", lag)).where("prior IS NOT NULL")
    cells = [(a, b) for a in range(4) for b in range(4)]
    rows = rows.add(**{f"h{a}{b}": f"{history('sum', f'CASE WHEN prior = {a} AND state = {b} THEN 1e0 ELSE 0e0 END')} + 0.5e0" for a, b in cells}).where("t > 0")
    rows = rows.add(**{f"lp{a}{b}": f"ln(h{a}{b} / (h{a}0 + h{a}1 + h{a}2 + h{a}3))" for a, b in cells}, **{f"c{a}{b}": kit.running(kit.flag(f"prior = {a} AND state = {b}")) for a, b in cells})
    for n in ages:
        rows = rows.add(**{f"n{a}{b}_{n}": f"c{a}{b} - coalesce(lag(c{a}{b}, {n}) OVER (PARTITION BY id ORDER BY t), 0e0)" for a, b in cells})
        xlogx = lambda x: f"CASE WHEN {x} > 0e0 THEN ({x}) * ln({x}) ELSE 0e0 END"
        own = " + ".join(f"{xlogx(f'n{a}{b}_{n}')} - n{a}{b}_{n} * lp{a}{b}" for a, b in cells)
        total = " - ".join(xlogx(f"(n{a}0_{n} + n{a}1_{n} + n{a}2_{n} + n{a}3_{n})") for a in range(4))
        rows = rows.add(**{f"glr_{n}": f"CASE WHEN t >= {n} THEN greatest(0e0, {own} - {total}) END"})
    law = lambda same: "CASE " + " ".join(f"WHEN prior = {a}" + ("" if same else f" AND state = {b}") + f" THEN lp{a}{b}" for a, b in cells if not same or a == b) + " END"
    rows = rows.add(surprise=f"-({law(False)})", stay=f"exp({law(True)})")
    rows = rows.add(stay_z="(CASE WHEN prior = state THEN 1e0 ELSE 0e0 END - stay) / sqrt(stay * (1e0 - stay) + 0.01e0)")
    return rows.add(stay_ewma=kit.ewma("stay_z", alpha(32)), glr_best=f"greatest({', '.join(f'glr_{n}' for n in ages)}, 0e0)")


TRANSITIONS = ["surprise", "glr_8", "glr_32", "glr_128", "glr_best", "stay_ewma"]


def rank_sign(rows: Relation) -> Relation:
    """A channel of the mid-rank of z, from -1 to 1, against its history."""
    rows = uniform(rows, "z", "rz").add(centred="2e0 * rz - 1e0")
    return channel(standard(rows, "centred", "cz"), "cz")


def lag_product(rows: Relation, kind: str = "signed", lag: int = 1) -> Relation:
    """A channel of lagged products of z (signed, squared, absolute, sign or rank), against its history."""
    forms = {"signed": "z", "squared": "z * z", "absolute": "abs(z)", "sign": "CASE WHEN z > z_med THEN 1e0 WHEN z < z_med THEN -1e0 ELSE 0e0 END", "rank": "2e0 * rz - 1e0"}
    rows = uniform(rows, "z", "rz").add(z_med=median("z"))
    rows = rows.add(f0=forms[kind])
    rows = rows.add(f_mu=history("avg", "f0"))
    rows = rows.add(product=f"(f0 - f_mu) * {kit.lag('(f0 - f_mu)', lag)}").where("product IS NOT NULL")
    return channel(standard(rows, "product", "pz"), "pz", serial=True)


def scale_likelihood(rows: Relation, x: str = "raw_energy", ages: tuple[int, ...] = (*AGES, 256, 512)) -> Relation:
    """Directional likelihood ratios and inverse-gamma Bayes factors of an energy channel, over ages up to 512, and short and long means."""
    rows = rows.where("t > 0").add(e=f"least(1e6, greatest(1e-12, {x}))").add(total=kit.running("e"))
    rows = suffixes(suffixes(rows, "total", "s", ages), "total", "m", (32, 512), whole=True)
    columns, w = {}, widths(ages)
    for n, k in zip(ages, w, strict=True):
        s = f"greatest(s{n}, 1e-12)"
        ratio = f"greatest({s} / {num(n)}, 1e-8)"
        columns[f"d{n}"] = f"CASE WHEN t >= {n} THEN greatest(0e0, 0.5e0 * ({s} - {num(n)} - {num(n)} * ln({ratio}))) * CASE WHEN {ratio} < 1e0 THEN -1e0 ELSE 1e0 END END"
        for a in (2.0, 8.0):
            constant = a * math.log(a - 1) - math.lgamma(a) + math.lgamma(a + 0.5 * n) + math.log(k)
            columns[f"v{int(a)}_{n}"] = f"CASE WHEN t >= {n} THEN {num(constant)} - {num(a + 0.5 * n)} * ln({num(a - 1)} + 0.5e0 * {s}) + 0.5e0 * {s} END"
    rows = rows.add(**columns)
    d = [f"d{n}" for n in ages]
    rows = rows.add(lower=f"ln(1e0 + greatest(0e0, -least({', '.join(d)})))", upper=f"ln(1e0 + greatest(0e0, {', '.join(d)}))", width=_known(d, w), short="greatest(m32 / least(t, 32), 1e-8)", long="greatest(m512 / least(t, 512), 1e-8)")
    rows = rows.add(b2=log_mix([f"v2_{n}" for n in ages], "width"), b8=log_mix([f"v8_{n}" for n in ages], "width"))
    return rows.add(bayes2="sign(b2) * ln(1e0 + abs(b2))", bayes8="sign(b8) * ln(1e0 + abs(b8))", log_short="ln(short)", log_short_long="ln(short / long)")


SCALE_LIKELIHOOD = ["lower", "upper", "bayes2", "bayes8", "log_short", "log_short_long"]


def correlation_departure(rows: Relation, halves: tuple[int, ...] = (8, 32)) -> Relation:
    """Moving lag correlations against the history's, in units of their noise."""
    rows = standard(rows).add(x0=kit.clip("w", 8))
    rows = rows.add(**{f"l{j}": kit.lag("x0", j) for j in LAGS})
    moments = lambda j: {f"a{j}": "x0", f"b{j}": f"l{j}", f"aa{j}": "x0 * x0", f"bb{j}": f"l{j} * l{j}", f"ab{j}": f"x0 * l{j}"}
    every = {k: e for j in LAGS for k, e in moments(j).items()}
    pair = lambda j, e: f"avg(CASE WHEN t <= 0 AND l{j} IS NOT NULL THEN {e} END) OVER (PARTITION BY id)"
    rows = rows.add(**{f"{k}_h": pair(k.lstrip("ab"), e) for k, e in every.items()})
    corr = lambda j, s: kit.clip(f"(ab{j}{s} - a{j}{s} * b{j}{s}) / sqrt(greatest(aa{j}{s} - a{j}{s} * a{j}{s}, 1e-8) * greatest(bb{j}{s} - b{j}{s} * b{j}{s}, 1e-8))", 1)
    rows = rows.add(**{f"rho{j}": corr(j, "_h") for j in LAGS}, **{f"x{j}": f"CASE WHEN t <= 0 AND l{j} IS NOT NULL THEN (x0 - a{j}_h) * (l{j} - b{j}_h) END" for j in LAGS})
    rows = rows.add(**{f"noise{j}": f"greatest(coalesce(stddev_pop(x{j}) OVER (PARTITION BY id), 0e0) / greatest(sqrt(greatest(aa{j}_h - a{j}_h * a{j}_h, 0e0) * greatest(bb{j}_h - b{j}_h * b{j}_h, 0e0)), 1e-8), 0.1e0)" for j in LAGS}).where("t > 0")
    rows = rows.add(**{f"{k}_{h}": kit.ewma(e, alpha(h), f"{k}_h") for h in halves for k, e in every.items()})
    rows = rows.add(**{f"r{j}_{h}": corr(j, f"_{h}") for h in halves for j in LAGS})
    rows = rows.add(**{f"d{j}_{h}": kit.clip(f"(r{j}_{h} - rho{j}) / (noise{j} * {noise(h, 1e-8)})", 128) for h in halves for j in LAGS})
    columns = {}
    for h in halves:
        square = [f"d{j}_{h} * d{j}_{h}" for j in LAGS]
        columns |= {f"energy_{h}": f"ln(1e0 + {' + '.join(square)})", f"signed_{h}": f"({' + '.join(f'd{j}_{h}' for j in LAGS)}) / 2e0", f"near_{h}": f"ln(1e0 + {' + '.join(square[:2])})", f"far_{h}": f"ln(1e0 + {' + '.join(square[2:])})", f"top_{h}": f"ln(1e0 + greatest({', '.join(square)}))", f"absolute_{h}": f"({' + '.join(f'abs(d{j}_{h})' for j in LAGS)}) / 4e0", f"change_{h}": " + ".join(f"(r{j}_{h} * r{j}_{h} - rho{j} * rho{j})" for j in LAGS)}
    rows = rows.add(**columns)
    return rows.add(energy_gap=f"energy_{halves[0]} - energy_{halves[1]}", signed_gap=f"signed_{halves[0]} - signed_{halves[1]}")


CORRELATION = [f"{c}_{h}" for h in (8, 32) for c in ("energy", "signed", "near", "far", "top", "absolute", "change")] + ["energy_gap", "signed_gap"]
# The cells' borders on z.
EDGES = (-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0)


def cell_divergence(rows: Relation, halves: tuple[int, ...] = HALVES) -> Relation:
    """Hellinger and Jensen-Shannon divergences of averaged cell masses from the history's, and shape ratios."""
    cells = range(len(EDGES) + 1)
    rows = rows.add(cell=" + ".join(f"CASE WHEN z >= {num(e)} THEN 1 ELSE 0 END" for e in EDGES))
    rows = rows.add(n_cells=history("sum", "1e0"), **{f"in{k}": kit.flag(f"cell = {k}") for k in cells})
    rows = rows.add(**{f"ref{k}": f"({history('sum', f'in{k}')} + 0.5e0) / (n_cells + {num(len(cells) / 2)})" for k in cells}).where("t > 0")
    rows = rows.add(**{f"m{k}_{h}": f"greatest({kit.ewma(f'in{k}', alpha(h), f'ref{k}')}, 1e-12)" for h in halves for k in cells})
    columns = {}
    for h in halves:
        columns |= {
            f"hellinger_{h}": " + ".join(f"0.5e0 * pow(sqrt(m{k}_{h}) - sqrt(ref{k}), 2e0)" for k in cells),
            f"jensen_{h}": " + ".join(f"0.5e0 * (m{k}_{h} * ln(2e0 * m{k}_{h} / (m{k}_{h} + ref{k})) + ref{k} * ln(2e0 * ref{k} / (m{k}_{h} + ref{k})))" for k in cells),
            f"tilt_{h}": f"(m7_{h} - m0_{h}) - (ref7 - ref0)",
            f"centre_{h}": f"m3_{h} + m4_{h} - ref3 - ref4",
            f"peak_ratio_{h}": f"ln((m3_{h} + m4_{h} + 1e-6) / (m1_{h} + m2_{h} + m5_{h} + m6_{h} + 1e-6)) - ln((ref3 + ref4 + 1e-6) / (ref1 + ref2 + ref5 + ref6 + 1e-6))",
            f"shift_{h}": " + ".join(f"{num(k - 3.5)} * (m{k}_{h} - ref{k})" for k in cells),
            f"variation_{h}": " + ".join(f"0.5e0 * abs(m{k}_{h} - ref{k})" for k in cells),
        }
    return rows.add(**columns, cell_surprise="-ln(CASE " + " ".join(f"WHEN cell = {k} THEN ref{k}" for k in cells) + " END)")


CELLS = [f"{c}_{h}" for h in HALVES for c in ("hellinger", "jensen", "tilt", "centre", "peak_ratio", "shift", "variation")] + ["cell_surprise"]
WINDOWS = (4, 8, 16, 32, 64, 128, 256, 512)


def window_mixture(rows: Relation, kind: str = "mean", windows: tuple[int, ...] = WINDOWS) -> Relation:
    """Mixtures of mean or variance alternatives over windows that are full or reach back to the start."""
    rows = standard(rows).add(w6=kit.clip("w", 6)).where("t > 0").add(c1=kit.running("w6"), c2=kit.running("w6 * w6"))
    rows = suffixes(suffixes(rows, "c1", "s", windows, True), "c2", "q", windows, True)
    grid = MEANS if kind == "mean" else VARIANCES
    half = len(grid) // 2
    rows = rows.add(**{f"a{i}_{n}": f"{num(g)} * s{n} - {num(0.5 * g * g)} * least(t, {n})" if kind == "mean" else f"{num(0.5 * (1 - 1 / g))} * q{n} - {num(0.5 * math.log(g))} * least(t, {n})" for n in windows for i, g in enumerate(grid)})
    every = lambda n: [f"a{i}_{n}" for i in range(len(grid))]
    rows = rows.add(**{f"{name}_{n}": log_mix(part, num(len(part))) for n in windows for name, part in (("all", every(n)), ("lower", every(n)[:half]), ("upper", every(n)[half:]))})
    alls = [f"all_{n}" for n in windows]
    cut = len(windows) // 2
    return rows.add(all_ages=log_mix(alls, num(len(alls))), top_age=f"greatest({', '.join(alls)})", short_ages=log_mix(alls[:cut], num(cut)), long_ages=log_mix(alls[cut:], num(len(alls) - cut)), **{f"gap_{n}": f"upper_{n} - lower_{n}" for n in windows})


WINDOW_MIXTURE = [f"{c}_{n}" for n in (8, 64, 512) for c in ("all", "lower", "upper", "gap")] + ["all_ages", "top_age", "short_ages", "long_ages"]


def hazard(rows: Relation, hazards: tuple[float, ...] = HAZARDS) -> Relation:
    """Log odds of a change at any earlier point, by a constant hazard, to any of ten alternatives.

    An absorbing filter has the closed form sum over starts s of h (1 - h) ** (s - 1) exp(L(t) - L(s - 1)), L the running log likelihood ratio. The series'
    least L keeps the exponents bounded in short series, of up to some hundred points; hazard_frame has the same numbers for series of any length.
    """
    rows = standard(rows).add(w6=kit.clip("w", 6)).where("t > 0")
    steps = [f"{num(m)} * w6 - {num(0.5 * m * m)}" for m in MEANS] + [f"{num(-0.5 * math.log(v))} + {num(0.5 * (1 - 1 / v))} * w6 * w6" for v in VARIANCES]
    rows = rows.add(**{f"L{k}": kit.running(e) for k, e in enumerate(steps)})
    rows = rows.add(**{f"P{k}": f"coalesce({kit.lag(f'L{k}')}, 0e0)" for k in range(len(steps))})
    rows = rows.add(**{f"F{k}": f"min(P{k}) OVER (PARTITION BY id)" for k in range(len(steps))})
    columns = {}
    for i, h in enumerate(hazards):
        stay = math.log1p(-h)
        for k in range(len(steps)):
            columns[f"o{i}_{k}"] = f"L{k} - F{k} + {num(math.log(h / 10) - stay)} - {num(stay)} * t + ln(sum(exp({num(stay)} * t - (P{k} - F{k}))) {kit.UPTO})"
    rows = rows.add(**columns)
    out = {}
    for i, h in enumerate(hazards):
        every = [f"o{i}_{k}" for k in range(len(steps))]
        for name, part in (("any", every), ("mean_up", every[3:6]), ("mean_down", every[:3]), ("scale_down", every[6:8]), ("scale_up", every[8:])):
            out[f"{name}_{round(1 / h)}"] = kit.clip(kit.log_sum(part), 80)
    rows = rows.add(**out)
    return rows.add(short_long=f"any_{round(1 / hazards[0])} - any_{round(1 / hazards[-1])}")


def hazard_frame(rows: DataFrame, hazards: tuple[float, ...] = HAZARDS) -> DataFrame:
    """hazard() for series of any length: the logarithm of the sum over starts grows point by point, so no output depends on later points. rows are innovations."""
    rows = standard(Relation.of(rows)).add(w6=kit.clip("w", 6)).where("t > 0").keep("id", "t", "w6").frame(rows.sparkSession)
    schema = f"id {dict(rows.dtypes)['id']}, t {dict(rows.dtypes)['t']}, " + ", ".join(f"{c} double" for c in HAZARD)
    means, variances, stay, start = np.array(MEANS), np.array(VARIANCES), np.log1p(-np.array(hazards)), np.log(np.array(hazards) / 10)
    parts = {"any": slice(None), "mean_up": slice(3, 6), "mean_down": slice(0, 3), "scale_down": slice(6, 8), "scale_up": slice(8, None)}

    def filtered(series: pd.DataFrame) -> pd.DataFrame:
        series = series.sort_values("t")
        w, t = series["w6"].to_numpy()[:, None], series["t"].to_numpy()[:, None, None]
        steps = np.concatenate([means * w - 0.5 * means**2, -0.5 * np.log(variances) + 0.5 * (1 - 1 / variances) * w * w], 1)
        upto = np.cumsum(steps, 0)
        # odds of each hazard (second axis) and alternative (third)
        grown = np.logaddexp.accumulate(stay[:, None] * t - (upto - steps)[:, None, :], axis=0)
        odds = upto[:, None, :] + (start - stay)[:, None] - stay[:, None] * t + grown
        out = {"id": series["id"], "t": series["t"]}
        for name, part in parts.items():
            total = np.clip(np.logaddexp.reduce(odds[:, :, part], axis=2), -80, 80)
            out |= {f"{name}_{round(1 / h)}": total[:, i] for i, h in enumerate(hazards)}
        out["short_long"] = out[f"any_{round(1 / hazards[0])}"] - out[f"any_{round(1 / hazards[-1])}"]
        return pd.DataFrame(out)[["id", "t", *HAZARD]]

    return rows.groupBy("id").applyInPandas(filtered, schema)


HAZARD = [f"{c}_{n}" for n in (64, 256, 1024) for c in ("any", "mean_up", "mean_down", "scale_down", "scale_up")] + ["short_long"]


def branches(rows: Relation, x: str, name: str) -> Relation:
    """Adds the distances of x under and over the history's median in units of their own medians (name_low, name_high), and against the history (..._z)."""
    rows = rows.add(**{f"{name}_c": median(x)})
    rows = rows.add(**{f"{name}_under": f"greatest({name}_c - ({x}), 0e0)", f"{name}_over": f"greatest(({x}) - {name}_c, 0e0)"})
    unit = lambda c: f"greatest(coalesce(percentile(CASE WHEN t <= 0 AND {c} > 0e0 THEN {c} END, 0.5e0) OVER (PARTITION BY id), 0e0), 1e-4)"
    rows = rows.add(**{f"{name}_low": f"least({name}_under / {unit(f'{name}_under')}, 12e0)", f"{name}_high": f"least({name}_over / {unit(f'{name}_over')}, 12e0)"})
    rows = rows.add(**{f"{name}_{d}_mu": history("avg", f"{name}_{d}") for d in ("low", "high")})
    rows = rows.add(**{f"{name}_{d}_off": f"abs({name}_{d} - {name}_{d}_mu)" for d in ("low", "high")})
    rows = rows.add(**{f"{name}_{d}_sp": f"greatest({median(f'{name}_{d}_off')}, 0.1e0)" for d in ("low", "high")})
    return rows.add(**{f"{name}_{d}_z": f"({name}_{d} - {name}_{d}_mu) / {name}_{d}_sp" for d in ("low", "high")})


def semitail(rows: Relation) -> Relation:
    """Split log-energy branches: value, moving averages and a reflected sum of each."""
    rows = branches(standard(rows), "ln(w * w + 1e-4)", "e").where("t > 0")
    for d in ("low", "high"):
        rows = scores(rows, f"e_{d}_z", f"{d}_ewma", (8, 32), 1e-8).add(**{f"{d}_sum": kit.running(f"{kit.clip(f'e_{d}_z', 12)} - 0.25e0")})
        rows = rows.add(**{f"{d}_cusum": f"ln(1e0 + {kit.reflected(f'{d}_sum')})"})
    return rows


SEMITAIL = [f"{c}" for d in ("low", "high") for c in (f"e_{d}", f"{d}_ewma_8", f"{d}_ewma_32", f"{d}_cusum")]


def two_pole(rows: Relation, halves: tuple[int, ...] = HALVES) -> Relation:
    """A moving average of a moving average, tanh-squashed by the noise of white input.

    With decay b and weight a the second pole is a**2 * sum over s of (t - s + 1) b**(t - s) x(s), so it takes two running sums.
    """
    rows = standard(rows).add(x8=kit.clip("w", 8)).where("t > 0")
    columns = {}
    for h in halves:
        a, rate = alpha(h), num(-math.log1p(-alpha(h)))
        columns |= {f"u{h}": kit.ewma("x8", a), f"v{h}": f"{num(a * a)} * exp(-{rate} * t) * ((t + 1e0) * sum(x8 * exp({rate} * t)) {kit.UPTO} - sum(t * x8 * exp({rate} * t)) {kit.UPTO})"}
        b = num(2 * math.log1p(-a))
        columns |= {f"uu{h}": f"{num(a * a)} * sum(exp({b} * (t - 1e0))) {kit.UPTO}", f"vv{h}": f"{num(a**4)} * sum(t * t * exp({b} * (t - 1e0))) {kit.UPTO}"}
    rows = rows.add(**columns)
    rows = rows.add(**{f"one_{h}": f"tanh(u{h} / sqrt(greatest(uu{h}, 1e-12)))" for h in halves}, **{f"two_{h}": f"tanh(v{h} / sqrt(greatest(vv{h}, 1e-12)))" for h in halves})
    a, b = halves[0], halves[-1]
    return rows.add(short_long=f"tanh((v{a} / sqrt(greatest(vv{a}, 1e-12)) - v{b} / sqrt(greatest(vv{b}, 1e-12))) / 2e0)", now="tanh(x8)")


TWO_POLE = [f"{c}_{h}" for h in HALVES for c in ("one", "two")] + ["short_long", "now"]


def _summaries(parts: list[str], name: str) -> dict[str, str]:
    low, high = log_mix(parts[:2], "2e0"), log_mix(parts[2:], "2e0")
    return {f"{name}_down": low, f"{name}_up": high}


def window_likelihood(rows: Relation, kind: str = "student", windows: tuple[int, ...] = (8, 32, 128)) -> Relation:
    """Log likelihood ratios of variance alternatives over windows, for normal, Student-5 or history-fitted Student innovations."""
    rows = standard(rows)
    if kind == "adaptive":
        rows = rows.add(excess=f"({history('avg', 'w * w * w * w')}) / greatest(pow({history('avg', 'w * w')}, 2e0), 1e-12) - 3e0")
        rows = rows.add(nu="CASE WHEN excess > 0e0 THEN greatest(4.5e0, least(50e0, 4e0 + 6e0 / excess)) ELSE 50e0 END")
    rows = rows.where("t > 0")
    forms = {
        "normal": lambda v: f"{num(-0.5 * math.log(v))} + {num(0.5 * (1 - 1 / v))} * w * w",
        "student": lambda v: f"{num(-0.5 * math.log(v))} - 3e0 * (ln(1e0 + w * w / {num(3 * v)}) - ln(1e0 + w * w / 3e0))",
        "adaptive": lambda v: f"{num(-0.5 * math.log(v))} - 0.5e0 * (nu + 1e0) * (ln(1e0 + w * w / ((nu - 2e0) * {num(v)})) - ln(1e0 + w * w / (nu - 2e0)))",
    }
    rows = rows.add(**{f"now{i}": forms[kind](v) for i, v in enumerate(VARIANCES)})
    rows = rows.add(**{f"cum{i}": kit.running(f"now{i}") for i in range(4)})
    for i in range(4):
        rows = suffixes(rows, f"cum{i}", f"x{i}_", windows, True)
    columns = _summaries([f"now{i}" for i in range(4)], "now")
    for n in windows:
        columns |= _summaries([f"x{i}_{n}" for i in range(4)], f"win{n}")
    rows = rows.add(**columns)
    names = ["now", *(f"win{n}" for n in windows)]
    return rows.add(**{f"{n}_gap": f"{n}_up - {n}_down" for n in names}, **{f"{n}_mix": f"{kit.log_add(f'{n}_up', f'{n}_down')} - ln(2e0)" for n in names})


WINDOW_LIKELIHOOD = [f"{n}_{c}" for n in ("now", "win8", "win32", "win128") for c in ("down", "up", "gap", "mix")]


def sign_run(rows: Relation) -> Relation:
    """Signs about the history's median: moving averages, and how long the current run of one sign has lasted."""
    rows = rows.add(z_med=median("z")).add(s="CASE WHEN z > z_med THEN 1 WHEN z < z_med THEN -1 ELSE 0 END")
    rows = rows.add(s1=kit.lag("s"))
    rows = standard(rows.add(sf="cast(s AS double)"), "sf", "sz").add(same=f"greatest(0.01e0, least(0.99e0, coalesce(avg(CASE WHEN t <= 0 AND s <> 0 AND s1 IS NOT NULL THEN CASE WHEN s = s1 THEN 1e0 ELSE 0e0 END END) OVER (PARTITION BY id), 0.5e0)))")
    rows = scores(rows.where("t > 0"), "sz", "sign", floor=1e-8)
    rows = rows.add(fresh=f"CASE WHEN s <> coalesce({kit.lag('s')}, 0) OR s = 0 THEN 1 ELSE 0 END").add(island=kit.running("fresh"))
    rows = rows.add(run="CASE WHEN s = 0 THEN 0 ELSE row_number() OVER (PARTITION BY id, island ORDER BY t) END")
    return rows.add(run_log="s * ln(1e0 + run)", run_score="s * (1e0 - exp(run * ln(same)))")


SIGN_RUN = [*(f"sign_{h}" for h in HALVES), "run_log", "run_score"]


def student_location(rows: Relation, shifts: tuple[float, ...] = (-0.5, 0.5)) -> Relation:
    """Student likelihood ratios of a shifted location, against the history, averaged."""
    rows = standard(rows)
    for i, d in enumerate(shifts):
        rows = standard(rows.add(**{f"lr{i}": f"-3e0 * (ln(1e0 + (w - {num(d)}) * (w - {num(d)}) / 3e0) - ln(1e0 + w * w / 3e0))"}), f"lr{i}", f"lz{i}")
    rows = rows.where("t > 0")
    for i in range(len(shifts)):
        rows = scores(rows, f"lz{i}", f"shift{i}", floor=1e-8)
    return rows


STUDENT_LOCATION = [f"shift{i}_{h}" for i in range(2) for h in HALVES]


def cumulative_mixture(rows: Relation) -> Relation:
    """Evidence for variance alternatives since the start: mixtures, posterior entropy and expected log variance."""
    rows = standard(rows).where("t > 0").add(**{f"E{i}": kit.running(f"{num(-0.5 * math.log(v))} + {num(0.5 * (1 - 1 / v))} * w * w") for i, v in enumerate(VARIANCES)})
    e = [f"E{i}" for i in range(4)]
    rows = rows.add(lower=log_mix(e[:2], "2e0"), upper=log_mix(e[2:], "2e0"), total=log_mix(e, "4e0"), peak=kit.biggest(*e))
    rows = rows.add(mass=" + ".join(f"exp({x} - peak)" for x in e))
    rows = rows.add(**{f"post{i}": f"exp(E{i} - peak) / mass" for i in range(4)})
    return rows.add(gap="upper - lower", entropy="-(" + " + ".join(f"post{i} * ln(greatest(post{i}, 1e-300))" for i in range(4)) + ")", log_variance=" + ".join(f"post{i} * {num(math.log(v))}" for i, v in enumerate(VARIANCES)))


CUMULATIVE = ["lower", "upper", "total", "gap", "entropy", "log_variance"]


def persistence(rows: Relation) -> Relation:
    """How long energy branches stay up: two time scales, soft counts of the last 32, and recovery from shocks."""
    rows = branches(standard(rows), "ln(w * w + 1e-4)", "e")
    for d in ("low", "high"):
        rows = standard(rows, f"e_{d}", f"p_{d}").add(**{f"thr_{d}": median(f"e_{d}", 0.9)})
        rows = rows.add(**{f"hit_{d}": kit.flag(f"e_{d} > thr_{d}")}).add(**{f"prob_{d}": history("avg", f"hit_{d}")})
    rows = rows.where("t > 0")
    for d in ("low", "high"):
        rows = scores(rows, f"p_{d}", f"{d}_scale", (8, 64), 1e-8)
        rows = rows.add(**{f"{d}_count": f"avg(hit_{d}) {kit.last(32)}", f"{d}_soft": f"{kit.ewma(f'hit_{d} - prob_{d}', alpha(64))} / greatest(sqrt(prob_{d} * (1e0 - prob_{d})), 0.1e0)", f"{d}_shock": kit.decayed_max(f"e_{d}", 0.5**0.25), f"{d}_level": kit.ewma(f"e_{d}", alpha(64), f"p_{d}_mu")})
        rows = rows.add(**{f"{d}_both": f"least(greatest({d}_scale_8, 0e0), greatest({d}_scale_64, 0e0))", f"{d}_recovery": f"{d}_shock - {d}_level", f"{d}_ratio": f"{d}_level / (1e0 + {d}_shock)"})
    return rows


PERSISTENCE = [f"{d}_{c}" for d in ("low", "high") for c in ("scale_8", "scale_64", "both", "count", "soft", "shock", "recovery", "ratio")]


def energy_pit(rows: Relation) -> Relation:
    """The energy's mid-rank in the history, as -log(u) and -log(1 - u), averaged."""
    rows = uniform(standard(rows).add(energy="w * w"), "energy", "eu")
    rows = standard(standard(rows.add(lo="-ln(eu)", hi="-ln(1e0 - eu)"), "lo", "lo_z"), "hi", "hi_z").where("t > 0")
    return scores(scores(rows, "lo_z", "pit_low", floor=1e-8), "hi_z", "pit_high", floor=1e-8)


ENERGY_PIT = [f"pit_{d}_{h}" for d in ("low", "high") for h in HALVES]


def window_ratio(rows: Relation, windows: tuple[int, ...] = (16, 32, 64, 128)) -> Relation:
    """Log ratios of plain, capped and log energies over windows to the history's, and how fast and slow windows disagree."""
    rows = standard(rows).add(energy="w * w").add(cap=f"greatest({median('energy', 0.95)}, 1e-8)").add(capped="least(energy, cap)", log_e="ln(energy + 1e-4)")
    rows = rows.add(energy_mu=f"greatest({history('avg', 'energy')}, 1e-8)", capped_mu=f"greatest({history('avg', 'capped')}, 1e-8)", log_mu=history("avg", "log_e")).where("t > 0")
    rows = rows.add(**{f"c_{c}": kit.running(c) for c in ("energy", "capped", "log_e")})
    for c in ("energy", "capped", "log_e"):
        rows = suffixes(rows, f"c_{c}", f"{c}_", windows, True)
    rows = rows.add(**{f"ratio_{n}": f"ln(greatest(energy_{n} / least(t, {n}), 1e-8) / energy_mu)" for n in windows}, **{f"trimmed_{n}": f"ln(greatest(capped_{n} / least(t, {n}), 1e-8) / capped_mu)" for n in windows}, **{f"log_{n}": f"log_e_{n} / least(t, {n}) - log_mu" for n in windows})
    a, b = windows[0], windows[-1]
    return rows.add(disagree=f"ratio_{a} - ratio_{b}", both_up=f"least(greatest(ratio_{a}, 0e0), greatest(ratio_{b}, 0e0))", both_down=f"least(greatest(-ratio_{a}, 0e0), greatest(-ratio_{b}, 0e0))")


WINDOW_RATIO = [f"{c}_{n}" for n in (16, 32, 64, 128) for c in ("ratio", "trimmed", "log")] + ["disagree", "both_up", "both_down"]


def cross_products(left: Relation, right: Relation, pairs: list[tuple[str, str]]) -> Relation:
    """Bounded products of columns of two banks at the same point."""
    columns = ", ".join(f"tanh($1.{a} / 3e0) * tanh($2.{b} / 3e0) AS x_{a}_{b}" for a, b in pairs)
    return left.then(f"SELECT $1.id, $1.t, $1.y, {columns} FROM $1 JOIN $2 ON $1.id = $2.id AND $1.t = $2.t", right)


def sequential_ratios(rows: Relation, decay: float = 0.995) -> Relation:
    """Leaky likelihood-ratio sums of a mean shift, a scale change and a tail change, squashed to [0, 1); inputs are id, t, y and value."""
    rows = rows.add(mu=history("avg", "value"))
    rows = rows.add(c0="value - mu").add(c1=kit.lag("c0"))
    rows = rows.add(num_c=history("sum", "c0 * c1"), den_c=f"sum(CASE WHEN t < 0 THEN c0 * c0 END) OVER (PARTITION BY id)", lowq=median("value", 0.05), highq=median("value", 0.95))
    rows = rows.add(phi=kit.clip("coalesce(num_c / greatest(den_c, 1e-8), 0e0)", 0.99)).add(res="CASE WHEN c1 IS NOT NULL OR t > 0 THEN c0 - phi * coalesce(c1, 0e0) END", out=kit.flag("value < lowq OR value > highq"))
    rows = rows.add(res_mu=history("avg", "res"), res_sd=f"greatest(coalesce({history('stddev_pop', 'res')}, 0e0), 1e-8)", p0=f"greatest(0.001e0, least(0.999e0, {history('avg', 'out')}))")
    rows = rows.add(zr=kit.clip("(res - res_mu) / res_sd", 6)).add(energy=f"greatest({history('avg', 'zr * zr')}, 1e-8)").where("t > 0")
    steps = ["0.5e0 * zr - 0.125e0", "-0.5e0 * zr - 0.125e0"] + [f"{num(-0.5 * math.log(r))} + {num(0.5 * (1 - 1 / r))} * zr * zr / energy" for r in (0.5, 2.0)]
    rows = rows.add(**{f"p{i}": f"greatest(0.001e0, least(0.999e0, p0 * {num(m)}))" for i, m in ((1, 0.5), (2, 2.0))})
    steps += [f"CASE WHEN out > 0e0 THEN ln(p{i} / p0) ELSE ln((1e0 - p{i}) / (1e0 - p0)) END" for i in (1, 2)]
    rows = rows.add(**{f"k{i}": kit.running(kit.scaled_up(s, decay)) for i, s in enumerate(steps)})
    rows = rows.add(**{f"e{i}": kit.leaky(f"k{i}", decay) for i in range(6)})
    return rows.add(**{f"c_{n}": f"greatest(e{2 * i}, e{2 * i + 1}) / (10e0 + greatest(e{2 * i}, e{2 * i + 1}))" for i, n in enumerate(("mean", "scale", "tail"))})


SEQUENTIAL = ["c_mean", "c_scale", "c_tail"]


def score_evidence(rows: Relation, ages: tuple[int, ...] = AGES) -> Relation:
    """Evidence that the autoregression itself has changed: the innovation times its two regressors, whitened by the history's covariance.

    The inverse square root of a 2 by 2 covariance M with d = sqrt(det) and s = sqrt(trace + 2 d) is the inverse of (M + d I) / s, a closed form.
    """
    rows = rows.add(a0="r * v1", b0="r * v2").add(am=history("avg", "a0"), bm=history("avg", "b0"))
    rows = rows.add(a="a0 - am", b="b0 - bm").add(maa=f"{history('avg', 'a * a')} + 1e-8", mbb=f"{history('avg', 'b * b')} + 1e-8", mab=history("avg", "a * b"))
    rows = rows.add(d="sqrt(greatest(maa * mbb - mab * mab, 1e-16))").add(s="sqrt(maa + mbb + 2e0 * d)").add(raa="(maa + d) / s", rbb="(mbb + d) / s", rab="mab / s").add(rd="raa * rbb - rab * rab")
    rows = rows.add(ua="(rbb * a - rab * b) / rd", ub="(raa * b - rab * a) / rd").where("t > 0")
    rows = scores(scores(rows, "ua", "ua"), "ub", "ub").add(norm="(ua * ua + ub * ub) / 2e0 - 1e0")
    rows = cusums(rows, "norm", "norm", (0.25,)).add(ca=kit.running("ua"), cb=kit.running("ub"))
    rows = suffixes(suffixes(rows, "ca", "sa", ages), "cb", "sb", ages)
    rows = rows.add(**{f"g{n}": f"(sa{n} * sa{n} + sb{n} * sb{n}) / {num(2 * n)}" for n in ages}, **{f"f{n}": f"CASE WHEN t >= {n} THEN {num(math.log(w) - math.log1p(n))} + 0.5e0 * (sa{n} * sa{n} + sb{n} * sb{n}) / {num(1 + n)} END" for n, w in zip(ages, widths(ages), strict=True)})
    rows = rows.add(glr=f"greatest({', '.join(f'g{n}' for n in ages)}, 0e0)", width=_known([f"g{n}" for n in ages], widths(ages)))
    rows = rows.add(bayes=log_mix([f"f{n}" for n in ages], "width"), **{f"size_{h}": f"sqrt(ua_{h} * ua_{h} + ub_{h} * ub_{h})" for h in HALVES})
    return rows.add(glr_max=kit.running("glr", "max"), glr_decayed=kit.decayed_max("glr", math.exp(-math.log(2) / 32)))


SCORE_EVIDENCE = [*(f"size_{h}" for h in HALVES), "norm_up_025", "glr", "bayes", "glr_max", "glr_decayed"]
