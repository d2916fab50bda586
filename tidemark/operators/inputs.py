"""Transforms of inputs and banks, and constants of a series' history."""

from __future__ import annotations

import math

from tidemark.functions import kit
from tidemark.functions.numeric import normal_quantile
from tidemark.operators import base_bank as bank
from tidemark.operators.whitening import H, WINSOR, history, median, standard, standardised
from tidemark.plans.relation import Relation, num


def startup(rows: Relation, s: bank.Settings = bank.Settings()) -> Relation:
    """Bank rows with the averages' start corrected: at t a moving average has only part of its eventual noise."""
    unscaled = ("log_second_ratio", "log_variance_ratio", "ar_log_second_ratio")
    every = [c for c in bank.output(s) if any(c.endswith(f"_{k}") for k in s.scales)]
    columns = {}
    for c in every:
        name, k = c.rsplit("_", 1)
        fade = f"exp({num(math.log1p(-1 / int(k)))} * t)"
        ratio = f"(1e0 - {fade} * {fade})" if name in unscaled else f"((1e0 - {fade}) * (1e0 - {fade} * {fade}))"
        columns[c] = f"{c} / sqrt(greatest({ratio}, 1e-12))"
    return rows.keep("id", "t", "y", **columns)


def second_order(rows: Relation) -> Relation:
    """Adds r1 and r2, the innovations of orders 1 and 2 (the latter by Cramer's rule, its poles drawn inside by shrinking), to standardised rows."""
    rows = standardised(rows).add(v1=kit.lag("v"), v2=kit.lag("v", 2))
    pair = "CASE WHEN t <= 0 AND v2 IS NOT NULL THEN {} END"
    sums = {"g11": "v1 * v1", "g12": "v1 * v2", "g22": "v2 * v2", "q1": "v * v1", "q2": "v * v2"}
    rows = rows.add(**{k: f"sum({pair.format(e)}) OVER (PARTITION BY id)" for k, e in sums.items()}, o11=history("sum", "v1 * v1"), oq=history("sum", "v * v1"))
    rows = rows.add(ridge="greatest((g11 + g22) / 2e0 * 0.001e0, 1e-8)")
    rows = rows.add(det="(g11 + ridge) * (g22 + ridge) - g12 * g12")
    rows = rows.add(a1="coalesce((q1 * (g22 + ridge) - q2 * g12) / nullif(det, 0e0), 0e0)", a2="coalesce((q2 * (g11 + ridge) - q1 * g12) / nullif(det, 0e0), 0e0)", c1=kit.clip("coalesce(oq / nullif(o11 * 1.001e0, 0e0), 0e0)", 0.995))
    # stationary if |a2| < 1 and |a1| < 1 - a2
    rows = rows.add(shrink="least(1e0, 0.995e0 / greatest(abs(a2), 1e-9), 0.995e0 * (1e0 - a2) / greatest(abs(a1), 1e-9))")
    return rows.where("v2 IS NOT NULL").add(r1="v - c1 * v1", r2="v - shrink * (a1 * v1 + a2 * v2)")


def mismatch(rows: Relation) -> Relation:
    """What the second order explains beyond the first: gap, energy advantage and log advantage, against the history, averaged."""
    from tidemark.operators.evidence import scores

    rows = second_order(rows).add(e1=f"greatest({history('avg', 'r1 * r1')}, 1e-8)", e2=f"greatest({history('avg', 'r2 * r2')}, 1e-8)")
    rows = rows.add(gap="(r1 - r2) / sqrt(e1)", energy="r1 * r1 / e1 - r2 * r2 / e2", log_adv="ln(r1 * r1 / e1 + 1e-4) - ln(r2 * r2 / e2 + 1e-4)")
    for c in ("gap", "energy", "log_adv"):
        rows = standard(rows, c, f"{c}_z")
    rows = rows.where("t > 0")
    for c in ("gap", "energy", "log_adv"):
        rows = scores(rows.add(**{f"{c}_c": kit.clip(f"{c}_z", 12)}), f"{c}_c", c)
    return rows


MISMATCH = [f"{c}_{h}" for c in ("gap", "energy", "log_adv") for h in (8, 32, 128)]


def moving_variance(rows: Relation, weight: float = 2 / 33) -> Relation:
    """Adds z: innovations r over the root of a moving average of their capped squares up to the point before."""
    rows = rows.where("r IS NOT NULL").add(mu=history("avg", "r")).add(sq="(r - mu) * (r - mu)")
    rows = rows.add(cap=f"greatest({median('sq', WINSOR)}, 1e-12)").add(capped="least(sq, cap)").add(start=f"greatest({history('avg', 'least(sq, cap)')}, 1e-12)", online="t")
    rows = rows.add(place="row_number() OVER (PARTITION BY id ORDER BY t)")
    rate = num(-math.log1p(-weight))
    total = "OVER (PARTITION BY id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.add(level=f"exp(-{rate} * place) * (start + {num(weight)} * sum(capped * exp({rate} * place)) {total})")
    rows = rows.add(before="coalesce(lag(level) OVER (PARTITION BY id ORDER BY t), start)")
    return rows.add(z=kit.clip("(r - mu) / sqrt(greatest(before, greatest(start * 0.0001e0, 1e-12)))", 12))


def quantile_mapped(rows: Relation, x: str = "x", knots: int = 65) -> Relation:
    """Adds g: x through the history's quantile function, linear between knots, as a normal score; ends are held, equal knots count as their mean.

    Knots and values are sorted together, so a value finds the knots around it with two windows and no join of ranges.
    """
    low, step = 0.001, 0.998 / (knots - 1)
    found = rows.where("t <= 0").group("id", values_h="count(*)", **{f"q{k}": f"percentile({x}, {num(low + step * k)})" for k in range(knots)})
    cases = "CASE k " + " ".join(f"WHEN {k} THEN q{k}" for k in range(knots)) + " END"
    grid = found.then(f"SELECT *, EXPAND(0, {knots - 1}) AS k FROM $1").keep("id", p=f"{num(low)} + {num(step)} * k", q=cases)
    grid = grid.group("id", "q", p="avg(p)")
    both = rows.keep("id", "t", v=x).then("SELECT id, t, v, cast(NULL AS double) AS q, cast(NULL AS double) AS p FROM $1 UNION ALL SELECT id, cast(NULL AS bigint) AS t, q AS v, q, p FROM $2", grid)
    # knots come before equal values on the way up, and after them on the way down
    up = "OVER (PARTITION BY id ORDER BY v, CASE WHEN q IS NULL THEN 1 ELSE 0 END, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    down = "OVER (PARTITION BY id ORDER BY v DESC, CASE WHEN q IS NULL THEN 1 ELSE 0 END, t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    both = both.add(q0=f"KNOWN(q) {up}", p0=f"KNOWN(p) {up}", q1=f"KNOWN(q) {down}", p1=f"KNOWN(p) {down}").where("t IS NOT NULL")
    both = both.add(pm="CASE WHEN q0 IS NULL THEN p1 WHEN q1 IS NULL OR q1 <= q0 THEN p0 ELSE p0 + (v - q0) / (q1 - q0) * (p1 - p0) END")
    return both.keep("id", "t", "v", "pm", g=normal_quantile("pm"))


def contexts(rows: Relation) -> Relation:
    """One row for each series: constants of its history that condition later models."""
    rows = standardised(rows).where("t <= 0").add(lag1=kit.lag("v"), lag4=kit.lag("v", 4), sd="stddev_pop(filled) OVER (PARTITION BY id)")
    rows = rows.add(m="avg(v) OVER (PARTITION BY id)", s="greatest(coalesce(stddev_pop(v) OVER (PARTITION BY id), 0e0), 1e-8)", square="v * v").add(square1=kit.lag("square"))
    rows = rows.group(
        "id",
        log_length="ln(1e0 + count(*))",
        log_sd="ln(greatest(max(sd), 1e-8))",
        log_mad_sd="ln(max(unit) / greatest(max(sd), 1e-8))",
        acf1="avg((v - m) * (lag1 - m)) / max(s * s)",
        acf4="avg((v - m) * (lag4 - m)) / max(s * s)",
        arch="corr(square, square1)",
        tail_share="avg(CASE WHEN abs(v - m) > 2e0 * s THEN 1e0 ELSE 0e0 END)",
        tail_ratio="ln(greatest(percentile(abs(v), 0.95e0), 1e-8) / greatest(percentile(abs(v), 0.5e0), 1e-8))",
        kurtosis_log="ln(1e0 + avg(pow((v - m) / s, 4e0)))",
        skew_size="abs(avg(pow((v - m) / s, 3e0)))",
    )
    return rows


CONTEXTS = ["log_length", "log_sd", "log_mad_sd", "acf1", "acf4", "arch", "tail_share", "tail_ratio", "kurtosis_log", "skew_size"]


def terciles(context: Relation, column: str) -> Relation:
    """Adds band: 0, 1 or 2 by the terciles of a context column over series, 3 where it is null."""
    cuts = context.group(low=f"percentile({column}, {num(1 / 3)})", high=f"percentile({column}, {num(2 / 3)})")
    return context.then(f"SELECT /*+ BROADCAST($2) */ $1.*, CASE WHEN {column} IS NULL THEN 3 WHEN {column} <= low THEN 0 WHEN {column} <= high THEN 1 ELSE 2 END AS band FROM $1 CROSS JOIN $2", cuts)


def magnitude(rows: Relation, scales: tuple[int, ...] = (5, 20, 80)) -> Relation:
    """Lagged products of the standardised size and of the capped square, averaged at three scales, in units of their eventual noise."""
    rows = standard(rows).add(size="abs(w)", square="w * w").add(cap=median("square", 0.99)).add(capped="least(square, cap)")
    rows = standard(standard(rows, "size", "sz"), "capped", "qz")
    rows = rows.add(ps=f"sz * {kit.lag('sz')}", pq=f"qz * {kit.lag('qz')}")
    rows = standard(standard(rows, "ps", "psz"), "pq", "pqz").where("t > 0")
    return rows.add(**{f"{n}_{k}": f"{kit.ewma(c, 1 / k)} / {num(math.sqrt((1 / k) / (2 - 1 / k)))}" for k in scales for n, c in (("size", "psz"), ("energy", "pqz"))})


MAGNITUDE = [f"{n}_{k}" for k in (5, 20, 80) for n in ("size", "energy")]


def semideviation(rows: Relation) -> Relation:
    """Adds s: z over the deviation of its own side of the history's mean, and b, the indicator of the history's lowest quarter, both against the history."""
    rows = rows.add(zm=history("avg", "z")).add(d="z - zm", low_q=median("z", 0.25))
    rows = rows.add(lower=f"greatest(sqrt(coalesce(avg({H.format('CASE WHEN d < 0e0 THEN d * d END')}) OVER (PARTITION BY id), 0e0)), 1e-6)", upper=f"greatest(sqrt(coalesce(avg({H.format('CASE WHEN d >= 0e0 THEN d * d END')}) OVER (PARTITION BY id), 0e0)), 1e-6)")
    rows = rows.add(side="CASE WHEN d < 0e0 THEN d / lower ELSE d / upper END", quarter=kit.flag("z <= low_q"))
    return standard(standard(rows, "side", "s"), "quarter", "b")


def forward_energy(rows: Relation, share: float = 0.6) -> Relation:
    """Adds fz: log energy of z, centred and scaled by the history's later part only, after the earlier part has been set aside."""
    rows = rows.add(place="t + n_h", cut=f"floor(n_h * {num(share)})", le="ln(z * z + 1e-4)")
    later = "CASE WHEN t <= 0 AND place > cut THEN le END"
    return rows.add(f_mu=f"avg({later}) OVER (PARTITION BY id)", f_sd=f"greatest(coalesce(stddev_pop({later}) OVER (PARTITION BY id), 0e0), 1e-6)").add(fz="(le - f_mu) / f_sd")


def directional_bayes(rows: Relation, prior: float = 1.0) -> Relation:
    """Log Bayes factors of the mean over ages, split by the sign of the sum."""
    from tidemark.operators import evidence as ev

    rows = standard(rows).where("t > 0").add(total=kit.running("w"))
    rows = ev.suffixes(rows, "total", "s")
    w = dict(zip(ev.AGES, ev.widths(ev.AGES), strict=True))
    columns = {}
    for n in ev.AGES:
        factor = f"{num(math.log(w[n]) - 0.5 * math.log1p(prior * n))} + {num(0.5 * prior / (1 + prior * n))} * s{n} * s{n}"
        columns |= {f"neg{n}": f"CASE WHEN s{n} < 0e0 THEN {factor} WHEN s{n} IS NOT NULL THEN {num(math.log(w[n]) - 0.5 * math.log1p(prior * n))} END", f"pos{n}": f"CASE WHEN s{n} >= 0e0 THEN {factor} WHEN s{n} IS NOT NULL THEN {num(math.log(w[n]) - 0.5 * math.log1p(prior * n))} END"}
    rows = rows.add(**columns, width=ev._known([f"s{n}" for n in ev.AGES], list(w.values())))
    return rows.add(negative=ev.log_mix([f"neg{n}" for n in ev.AGES], "width"), positive=ev.log_mix([f"pos{n}" for n in ev.AGES], "width"))


def drift_identity(rows: Relation) -> Relation:
    """The cumulative likelihood ratio of variance alternatives as a function of t and the energy sum alone, beside the running sum itself."""
    from tidemark.operators import evidence as ev

    rows = standard(rows).where("t > 0").add(energy=kit.running("w * w"))
    step = lambda v: f"{num(-0.5 * math.log(v))} + {num(0.5 * (1 - 1 / v))} * w * w"
    return rows.add(**{f"sum_{i}": kit.running(step(v)) for i, v in enumerate(ev.VARIANCES)}, **{f"form_{i}": f"{num(-0.5 * math.log(v))} * t + {num(0.5 * (1 - 1 / v))} * energy" for i, v in enumerate(ev.VARIANCES)})


def resetting(rows: Relation, reset: float = -2.0) -> Relation:
    """A reflected sum of the standardised energy that starts anew where the energy's average falls under a level: islands between resets, reflected within."""
    from tidemark.operators import evidence as ev

    rows = standard(rows).add(energy="w * w - 1e0").where("t > 0")
    rows = rows.add(fast=f"{kit.ewma('energy', ev.alpha(8))} / {ev.noise(8)}").add(cut=f"CASE WHEN fast < {num(reset)} THEN 1 ELSE 0 END").add(island=f"coalesce(sum(cut) {kit.BEFORE}, 0)")
    within = "OVER (PARTITION BY id, island ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = rows.add(partial=f"sum(energy - 0.25e0) {within}")
    return rows.add(level=f"partial - least(0e0, min(partial) {within})").add(log_level="ln(1e0 + level)")


def null_growth(rows: Relation, replicates: int = 512, ages: tuple[int, ...] = (4, 8, 16, 32, 64, 128, 256, 512, 1024), order: float = 0.95, least: int = 8) -> Relation:
    """For each series of enough history blocks and each age in blocks: the order statistic of the greatest sum of four block means that resampled history reaches by then.

    A replicate strings together segments of four contiguous blocks; sums across their borders count. All series share the seeded draws.
    """
    from tidemark.operators.blocks import BLOCK

    blocks = rows.where("t <= 0").add(place="t + n_h - 1").add(block=f"cast(floor(place / {num(BLOCK)}) AS bigint)").group("id", "block", points="count(*)", m="avg(z)").where(f"points = {BLOCK}")
    listed = blocks.group("id", n="count(*)", ms="LISTED(m, block)").where(f"n >= {least}")
    draw = lambda k: f"((((cast(replicate AS bigint) * 48271 + ({k}) * 69621 + 777) % 2147483647) * 16807 % 2147483647) * 16807 % 2147483647) / 2147483647e0"
    draws = Relation.select(f"SELECT EXPAND(1, {replicates}) AS replicate").then(f"SELECT replicate, EXPAND(1, {max(ages) // 4}) AS segment FROM $1").add(u=draw("segment"), v=draw("segment - 1"))
    # the draws are the same few for any number of series, so they go to where the series are and no drawn row is shuffled
    walk = listed.then("SELECT /*+ BROADCAST($2) */ /*+ BROADCAST(d) */ id, ms, replicate, segment, cast(floor(u * (n - 3)) AS int) AS a, cast(floor(v * (n - 3)) AS int) AS b FROM $1 CROSS JOIN $2 AS d", draws)
    walk = walk.keep("id", "replicate", "segment", **{f"m{i}": f"ITEM(ms, a + {i + 1})" for i in range(4)}, **{f"b{i}": f"ITEM(ms, b + {i + 1})" for i in (1, 2, 3)})
    walk = walk.add(top="greatest(abs(m0 + m1 + m2 + m3), CASE WHEN segment > 1 THEN greatest(abs(b1 + b2 + b3 + m0), abs(b2 + b3 + m0 + m1), abs(b3 + m0 + m1 + m2)) ELSE 0e0 END) / 2e0")
    tops = walk.group("id", "replicate", **{f"top{n}": f"max(CASE WHEN segment <= {n // 4} THEN top END)" for n in ages})
    long = tops.then(" UNION ALL ".join(f"SELECT id, replicate, {n} AS age, top{n} AS top FROM $1" for n in ages))
    long = long.add(place="row_number() OVER (PARTITION BY id, age ORDER BY top, replicate)")
    return long.where(f"place = {min(replicates, math.ceil((replicates + 1) * order))}").keep("id", "age", cut="top")
