"""Recurrences of a series in closed form over the window PARTITION BY id ORDER BY t.

Each function gives SQL for a relation with columns id and t; t is 1 at the first online point, and history has t <= 0. Arguments that are used twice
should be columns. Powers of a decay limit the length of a series: see ewma().
"""

from __future__ import annotations

import math

from tidemark.plans.relation import num

BY, ORDER = "PARTITION BY id", "ORDER BY t"
UPTO = f"OVER ({BY} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
BEFORE = f"OVER ({BY} {ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
ALL = f"OVER ({BY})"


def lag(x: str, k: int = 1) -> str:
    return f"lag({x}, {k}) OVER ({BY} {ORDER})"


def last(n: int) -> str:
    """The frame of the last n rows."""
    return f"OVER ({BY} {ORDER} ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"


def running(x: str, how: str = "sum") -> str:
    return f"{how}({x}) {UPTO}"


def reflected(total: str) -> str:
    """max(0, s + x) step by step, from the running sum of x."""
    return f"({total} - least(0e0, min({total}) {UPTO}))"


def ewma(x: str, alpha: float, start: str = "0e0") -> str:
    """m + alpha * (x - m) step by step, from start. Exact as long as (1 - alpha) ** -t is a double: t up to 709 / -ln(1 - alpha); an error beyond."""
    rate = num(-math.log1p(-alpha))
    return within(rate, f"(exp(-{rate} * t) * ({start} + {num(alpha)} * sum({x} * exp({rate} * t)) {UPTO}))")


def within(rate: str, value: str) -> str:
    """value as long as exp(rate * t) is a double, else an error."""
    return f"(CASE WHEN {rate} * t <= 709e0 THEN {value} ELSE RAISE('the series is too long for a closed form, see evidence.long_average') END)"


def ewma_noise(alpha: float, floor: float = 1e-10) -> str:
    """The standard deviation of ewma() of unit noise from 0."""
    rate = num(2 * math.log1p(-alpha))
    return f"sqrt(greatest({num(alpha / (2 - alpha))} * (1e0 - exp({rate} * t)), {num(floor)}))"


def decayed_max(x: str, decay: float) -> str:
    """max(decay * m, x) step by step, from 0."""
    rate = num(-math.log(decay))
    return within(rate, f"greatest(0e0, exp(-{rate} * t) * max({x} * exp({rate} * t)) {UPTO})")


def scaled_up(x: str, decay: float) -> str:
    """x / decay ** t, whose running sum and its minimum give leaky()."""
    return f"({x}) * exp({num(-math.log(decay))} * t)"


def leaky(total: str, decay: float) -> str:
    """max(0, decay * s + x) step by step, from the running sum of scaled_up(x)."""
    return within(num(-math.log(decay)), f"(exp({num(math.log(decay))} * t) * {reflected(total)})")


def clip(x: str, bound: float) -> str:
    return f"greatest({num(-bound)}, least({num(bound)}, {x}))"


def flag(condition: str) -> str:
    return f"CASE WHEN {condition} THEN 1e0 ELSE 0e0 END"


def biggest(*columns: str) -> str:
    return f"greatest({', '.join(columns)})"


def log_sum(terms: list[str]) -> str:
    """Logarithm of a sum of exponentials; terms that are null don't count. The terms should be columns."""
    top = f"greatest({', '.join(terms)})" if len(terms) > 1 else terms[0]
    return f"({top} + ln({' + '.join(f'coalesce(exp({x} - {top}), 0e0)' for x in terms)}))"


def log_add(a: str, b: str) -> str:
    return f"(greatest({a}, {b}) + ln(1e0 + exp(-abs({a} - {b}))))"


def over(a: str, b: str) -> str:
    """a / b, null where b is 0."""
    return f"({a}) / nullif({b}, 0e0)"


def best_of(values: list[str], names: list[str], least: str | None = None) -> str:
    """The name of the greatest value, the first among those that are equal but for rounding."""
    top = f"greatest({', '.join(values)})" if len(values) > 1 else values[0]
    cases = " ".join(f"WHEN {v} >= {top} - 1e-9 THEN {n}" for v, n in zip(values, names, strict=True))
    return f"CASE {cases} ELSE {least or names[0]} END"
