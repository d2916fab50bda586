"""Ridge regressions spelled as SQL for the oracle: sums, elimination and back substitution, beside the learners' own solve."""

from __future__ import annotations

from tidemark.plans.relation import Relation, num


def sums(rows: Relation, columns: list[str], response: str, *by: str) -> Relation:
    """n, s<i> and p<i>_<j> for i <= j over the columns and the response, which is the last."""
    every = [*columns, response]
    found = {f"s{i}": f"sum({a} * 1e0)" for i, a in enumerate(every)} | {f"p{i}_{j}": f"sum({a} * 1e0 * {b})" for i, a in enumerate(every) for j, b in enumerate(every) if i <= j}
    return rows.group(*by, n="count(*)", **found)


def without_own(parts: Relation, size: int, by: str) -> Relation:
    """The sums of all other groups, for each group."""
    names = ["n", *(f"s{i}" for i in range(size + 1)), *(f"p{i}_{j}" for i in range(size + 1) for j in range(i, size + 1))]
    return parts.then(f"SELECT a.{by}, {', '.join(f'sum(b.{c}) AS {c}' for c in names)} FROM $1 AS a JOIN $1 AS b ON a.{by} <> b.{by} GROUP BY a.{by}")


def ridge(totals: Relation, size: int, *by: str, alpha: float = 100.0) -> Relation:
    """by, k0 to k<size-1> and intercept, of a ridge on standardised columns. The system is positive definite, so no pivots are looked for."""
    places = range(size)
    rows = totals.keep(*by, "n", **{f"m{i}": f"s{i} / n" for i in range(size + 1)}, **{f"c{i}_{j}": f"p{i}_{j} / n - s{i} / n * s{j} / n" for i in places for j in range(i, size + 1)})
    rows = rows.add(**{f"d{i}": f"sqrt(greatest(c{i}_{i}, 1e-12))" for i in places})
    system = {f"e0_{i}_{j}": f"c{i}_{j} / (d{i} * d{j}) * n" + (f" + {num(alpha)}" if i == j else "") for i in places for j in range(i, size)}
    rows = rows.add(**system, **{f"r0_{i}": f"c{i}_{size} / d{i} * n" for i in places})
    for k in range(size - 1):  # row k is final in step k
        left = {f"e{k + 1}_{i}_{j}": f"e{k}_{i}_{j} - e{k}_{k}_{i} / e{k}_{k}_{k} * e{k}_{k}_{j}" for i in range(k + 1, size) for j in range(i, size)}
        rows = rows.add(**left, **{f"r{k + 1}_{i}": f"r{k}_{i} - e{k}_{k}_{i} / e{k}_{k}_{k} * r{k}_{k}" for i in range(k + 1, size)})
    for i in reversed(places):
        known = "".join(f" - e{i}_{i}_{j} * x{j}" for j in range(i + 1, size))
        rows = rows.add(**{f"x{i}": f"(r{i}_{i}{known}) / e{i}_{i}_{i}"})
    rows = rows.add(**{f"k{i}": f"x{i} / d{i}" for i in places})
    return rows.keep(*by, *(f"k{i}" for i in places), intercept=f"m{size}" + "".join(f" - k{i} * m{i}" for i in places))


def scored(rows: Relation, models: Relation, columns: list[str], on: str = "1 = 1") -> Relation:
    """rows with p, of the model that `on` (with $1 and $2) chooses."""
    line = "$2.intercept" + "".join(f" + $2.k{i} * $1.{c}" for i, c in enumerate(columns))
    return rows.then(f"SELECT $1.*, {line} AS p FROM $1 JOIN $2 ON {on}", models)
