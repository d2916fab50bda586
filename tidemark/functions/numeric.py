"""Functions that neither engine has: normal quantile and distribution, log-gamma at half-integers."""

from __future__ import annotations

import math

from tidemark.plans.relation import num

# The coefficients of Acklam's rational approximation of the normal quantile.
TAIL_TOP = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_BOTTOM = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00)
MIDDLE_TOP = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_BOTTOM = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01)
LOW = 0.02425


def _polynomial(x: str, coefficients: tuple[float, ...]) -> str:
    text = num(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {num(c)})"
    return text


def normal_quantile(p: str) -> str:
    """The standard normal quantile of p in (0, 1)."""
    low, high, r = f"sqrt(-2e0 * ln({p}))", f"sqrt(-2e0 * ln(1e0 - {p}))", f"(({p} - 0.5e0) * ({p} - 0.5e0))"
    tail = lambda q: f"{_polynomial(q, TAIL_TOP)} / {_polynomial(q, (*TAIL_BOTTOM, 1.0))}"
    middle = f"({p} - 0.5e0) * {_polynomial(r, MIDDLE_TOP)} / {_polynomial(r, (*MIDDLE_BOTTOM, 1.0))}"
    return f"CASE WHEN {p} < {num(LOW)} THEN {tail(low)} WHEN {p} > {num(1 - LOW)} THEN -({tail(high)}) ELSE {middle} END"


def normal_distribution(x: str) -> str:
    """The standard normal distribution function, to 7e-8 (Abramowitz and Stegun 26.2.17)."""
    k = f"(1e0 / (1e0 + 0.2316419e0 * abs({x})))"
    tail = f"(0.3989422804014327e0 * exp(-0.5e0 * {x} * {x}) * {k} * {_polynomial(k, (1.330274429, -1.821255978, 1.781477937, -0.356563782, 0.319381530))})"
    return f"CASE WHEN {x} >= 0e0 THEN 1e0 - {tail} ELSE {tail} END"


def log_gamma(x: float) -> str:
    """A literal: ages are known when the plan is written."""
    return num(math.lgamma(x))
