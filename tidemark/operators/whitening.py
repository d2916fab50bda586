"""Innovations: what is left of a series after the autoregression of its history, and their normalisation.

Order 1 is a closed form and stays in SQL. Higher orders take the history's normal equations, which are aggregates, through one small solver a
series (see tidemark.functions.linear); everything after that is SQL again.
"""

from __future__ import annotations

from tidemark.functions import kit
from tidemark.functions.numeric import normal_quantile
from tidemark.plans.relation import Relation, num
from tidemark.sources.panel import sanitised

#: Clipping of the input, share of the trace that is added to the diagonal, largest pole.
CLIP, RIDGE, RADIUS, WINSOR, SLOPE_LIMIT, RECENT = 12.0, 0.001, 0.995, 0.99, 0.95, 2 / 33
H = "CASE WHEN t <= 0 THEN {} END"


def history(how: str, x: str) -> str:
    """An aggregate of the history, on every row of its series."""
    return f"{how}({H.format(x)}) OVER (PARTITION BY id)"


def median(x: str, p: float = 0.5) -> str:
    return f"percentile({H.format(x)}, {num(p)}) OVER (PARTITION BY id)"


def standardised(rows: Relation) -> Relation:
    """Adds v: values against the history's median in units of its median deviation, clipped and centred."""
    rows = sanitised(rows).add(off="abs(filled - med_h)", spread="stddev_pop(filled) OVER (PARTITION BY id)")
    rows = rows.add(unit=f"greatest(1.4826e0 * percentile(off, 0.5e0) OVER (PARTITION BY id), coalesce(spread, 0e0) * 0.01e0, 1e-8)")
    rows = rows.add(v0=kit.clip("(x - med_h) / unit", CLIP))
    return rows.add(v=f"v0 - {history('avg', 'v0')}")


def first_order(rows: Relation) -> Relation:
    """Adds the innovation r of order 1; null at a series' first point."""
    rows = standardised(rows).add(v1=kit.lag("v"))
    rows = rows.add(gram=history("sum", "v1 * v1"), lead_sum=history("sum", "v1 * v"))
    rows = rows.add(c1=kit.clip(f"coalesce(lead_sum / nullif(gram + greatest(gram * {num(RIDGE)}, 1e-8), 0e0), 0e0)", RADIUS))
    return rows.add(r="v - c1 * v1")


def normalised(rows: Relation, mode: str = "sd") -> Relation:
    """Adds z and u (mid-rank among the history's innovations) to rows with innovations; mode is sd, mad, arch1, uniform, gaussian or raw."""
    rows = rows.where("r IS NOT NULL")
    rows = rows.add(r_mean=history("avg", "r"), r_med=median("r"), r_sd=f"greatest(coalesce({history('stddev_pop', 'r')}, 0e0), 1e-8)", n_r=f"{history('sum', '1')}")
    rows = rows.add(r_off="abs(r - r_med)")
    rows = rows.add(r_mad=f"greatest(1.4826e0 * {median('r_off')}, r_sd * 0.01e0, 1e-8)")
    rows = uniform(rows, "r", "u")
    if mode == "mad":
        return rows.add(z=kit.clip("(r - r_med) / r_mad", CLIP))
    if mode == "arch1":
        return conditional(rows)
    forms = {"raw": "r", "sd": "(r - r_mean) / r_sd", "uniform": "sqrt(12e0) * (u - 0.5e0)", "gaussian": normal_quantile("u")}
    return rows.add(z=kit.clip(forms[mode], CLIP))


def uniform(rows: Relation, x: str, name: str) -> Relation:
    """Adds the mid-rank of x among its series' history: (left + right + 1) / (2 (n + 1))."""
    h = "CASE WHEN t <= 0 THEN 1 ELSE 0 END"
    rows = rows.add(
        **{
            f"{name}_upto": f"sum({h}) OVER (PARTITION BY id ORDER BY {x} RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)",
            f"{name}_same": f"sum({h}) OVER (PARTITION BY id, {x})",
            f"{name}_n": f"sum({h}) OVER (PARTITION BY id)",
        }
    )
    return rows.add(**{name: f"(2e0 * {name}_upto - {name}_same + 1e0) / (2e0 * ({name}_n + 1e0))"})


def conditional(rows: Relation, cap: float = CLIP) -> Relation:
    """Adds z: innovations over the square root of a variance forecast from the last capped square; also energy and forecast against the mean variance."""
    rows = rows.add(sq="(r - r_mean) * (r - r_mean)")
    rows = rows.add(sq_cap=f"greatest({median('sq', WINSOR)}, 1e-12)")
    rows = rows.add(capped="least(sq, sq_cap)").add(capped1=kit.lag("capped"), variance=f"greatest({history('avg', 'least(sq, sq_cap)')}, 1e-12)")
    both = f"CASE WHEN t <= 0 AND capped1 IS NOT NULL THEN {{}} END"
    rows = rows.add(m1=f"avg({both.format('capped1')}) OVER (PARTITION BY id)", m0=f"avg({both.format('capped')}) OVER (PARTITION BY id)")
    rows = rows.add(sxx=f"sum({both.format('(capped1 - m1) * (capped1 - m1)')}) OVER (PARTITION BY id)", sxy=f"sum({both.format('(capped1 - m1) * (capped - m0)')}) OVER (PARTITION BY id)")
    rows = rows.add(slope=f"least({num(SLOPE_LIMIT)}, greatest(0e0, coalesce(sxy / (sxx + greatest(sxx * {num(RIDGE)}, 1e-12)), 0e0)))")
    rows = rows.add(forecast="greatest(variance * (1e0 - slope) + slope * coalesce(capped1, variance), greatest(variance * 0.0001e0, 1e-12))")
    return rows.add(z=kit.clip("(r - r_mean) / sqrt(forecast)", cap), raw_energy="sq / variance", forecast_energy="forecast / variance", conditional_energy="sq / forecast")


def innovations(rows: Relation, mode: str = "sd") -> Relation:
    """Innovations of order 1 with z and u, history included."""
    found = normalised(first_order(rows), mode)
    energies = ["raw_energy", "forecast_energy", "conditional_energy"] if mode == "arch1" else []
    return found.keep("id", "t", "y", "tau", "cnt", "n_h", "value", "r", "z", "u", *energies)


def standard(rows: Relation, x: str = "z", name: str = "w", floor: float = 1e-6) -> Relation:
    """Adds x against its mean and deviation in the history."""
    rows = rows.add(**{f"{name}_mu": history("avg", x), f"{name}_sd": f"greatest(coalesce({history('stddev_pop', x)}, 0e0), {num(floor)})"})
    return rows.add(**{name: f"({x} - {name}_mu) / {name}_sd"})
