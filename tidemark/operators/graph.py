"""Lagged relations between coordinates of a series: which coordinate's past helps to predict which, and how often, over many series.

Coordinates are columns of a panel. A candidate edge (source, lag, target) is judged on series that its coefficients weren't fitted on: by the share of
squared error that it removes beyond the target's own past, the time and an intercept. A series weighs the same however long it is. Fits are
ridge regressions from mean products by series; elimination is written out as columns. Phases (0 before the break, 1 after) are fitted apart.
"""

from __future__ import annotations

from tidemark.operators import splits
from tidemark.plans.relation import Relation, num

GAIN, POSITIVE, SERIES, EDGES, PARENTS, LAGS = 0.005, 0.55, 32, 24, 2, (1, 2, 4, 8, 16)

#: Places in the mean products: the intercept, the time and the target's own lags, then the candidate and the target.
OWN = 2 + len(LAGS)
EXTRA, GOAL = OWN, OWN + 1


def _products(rows: Relation, columns: list[str]) -> Relation:
    """Mean products m<a>_<b> of one phase of a series, for each target and candidate (source and lag)."""
    past = [f"p{i}_{k}" for i in range(len(columns)) for k in range(len(LAGS))]
    rows = rows.add(**{f"p{i}_{k}": f"lag({c}, {n}) OVER (PARTITION BY id ORDER BY t)" for i, c in enumerate(columns) for k, n in enumerate(LAGS)})
    rows = rows.where(" AND ".join(["t > 0", *(f"{c} IS NOT NULL" for c in [*columns, *past])]))
    rows = rows.then(f"SELECT id, t, y AS phase, EXPAND(0, {len(columns) - 1}) AS target, {', '.join([*columns, *past])} FROM $1")
    pick = lambda of: f"CASE target {' '.join(f'WHEN {i} THEN {x}' for i, x in enumerate(of))} END"
    own = {"x0": "1e0", "x1": "ln(1e0 + t) / 8e0"} | {f"x{2 + k}": pick([f"p{i}_{k}" for i in range(len(columns))]) for k in range(len(LAGS))} | {f"x{GOAL}": pick(columns)}
    rows = rows.keep("id", "phase", "target", *past, **own)
    places = [*range(OWN), GOAL]
    base = rows.group("id", "phase", "target", **{f"m{a}_{b}": f"avg(x{a} * x{b})" for a in places for b in places if a <= b})
    rows = rows.then(f"SELECT *, EXPAND(0, {len(past) - 1}) AS edge FROM $1").where(f"cast(floor(edge / {num(len(LAGS))}) AS bigint) <> target")
    rows = rows.add(z=f"CASE edge {' '.join(f'WHEN {e} THEN {x}' for e, x in enumerate(past))} END")
    with_edge = rows.group("id", "phase", "target", "edge", **{f"m{a}_{EXTRA}": f"avg(x{a} * z)" for a in range(OWN)}, **{f"m{EXTRA}_{EXTRA}": "avg(z * z)", f"m{EXTRA}_{GOAL}": f"avg(z * x{GOAL})"})
    names = [f"m{a}_{b}" for a in places for b in places if a <= b]
    return with_edge.then(f"SELECT $1.*, {', '.join(f'$2.{n}' for n in names)} FROM $1 JOIN $2 ON $1.id = $2.id AND $1.phase = $2.phase AND $1.target = $2.target", base)


def _fitted(products: Relation, ridge: float) -> Relation:
    """Coefficients without (b<a>) and with the candidate (f<a>), and the number of series, by half."""
    names = [(a, b) for a in range(GOAL + 1) for b in range(a, GOAL + 1)]
    penalty = lambda a: 0.0 if a == GOAL else 1e-8 if a == 0 else ridge
    rows = products.group("half", "phase", "target", "edge", fitted="count(*)", **{f"e0_{a}_{b}": f"avg(m{a}_{b})" + (f" + {num(penalty(a))}" if a == b else "") for a, b in names})
    for p in range(EXTRA):
        rows = rows.add(**{f"e{p + 1}_{a}_{b}": f"e{p}_{a}_{b} - e{p}_{p}_{a} * e{p}_{p}_{b} / e{p}_{p}_{p}" for a, b in names if a > p})
    rows = rows.add(**{f"f{EXTRA}": f"e{EXTRA}_{EXTRA}_{GOAL} / e{EXTRA}_{EXTRA}_{EXTRA}"})
    for p in range(OWN - 1, -1, -1):
        solved = lambda c, last, p=p: f"(e{p}_{p}_{GOAL}" + "".join(f" - e{p}_{p}_{q} * {c}{q}" for q in range(p + 1, last + 1)) + f") / e{p}_{p}_{p}"
        rows = rows.add(**{f"b{p}": solved("b", OWN - 1), f"f{p}": solved("f", EXTRA)})
    return rows.keep("half", "phase", "target", "edge", "fitted", *(f"b{p}" for p in range(OWN)), *(f"f{p}" for p in range(OWN + 1)))


def _error(c: str, last: int) -> str:
    """The mean squared error of coefficients on a series' mean products."""
    terms = [f"m{GOAL}_{GOAL}", *(f"- 2e0 * {c}{a} * m{a}_{GOAL}" for a in range(last + 1))]
    terms += [f"+ {'' if a == b else '2e0 * '}{c}{a} * {c}{b} * m{a}_{b}" for a in range(last + 1) for b in range(a, last + 1)]
    return " ".join(terms)


def gains(rows: Relation, columns: list[str], ridge: float = 0.05) -> Relation:
    """For each series, phase and edge: the share of its squared error that the edge removes, as fitted on the other half of the series.

    rows: id, t, y and the columns, with history for the lags of the first online points. Halves are those of splits.halves.
    """
    products = _products(rows, columns)
    products = products.then("SELECT $1.*, $2.half FROM $1 JOIN $2 ON $1.id = $2.id", splits.halves(rows.then("SELECT DISTINCT id FROM $1")))
    fits = _fitted(products, ridge)
    coefficients = ", ".join([*(f"$2.b{p}" for p in range(OWN)), *(f"$2.f{p}" for p in range(OWN + 1))])
    judged = products.then(f"SELECT $1.*, $2.fitted, {coefficients} FROM $1 JOIN $2 ON $1.half <> $2.half AND $1.phase = $2.phase AND $1.target = $2.target AND $1.edge = $2.edge", fits)
    judged = judged.add(own=_error("b", OWN - 1), more=_error("f", EXTRA)).add(source=f"cast(floor(edge / {num(len(LAGS))}) AS bigint)", place=f"edge % {len(LAGS)}")
    return judged.keep("id", "half", "phase", "source", "target", "fitted", lag="CASE place " + " ".join(f"WHEN {k} THEN {n}" for k, n in enumerate(LAGS)) + " END", coefficient=f"f{EXTRA}", gain="(own - more) / greatest(own, 0.01e0)")


def edges(rows: Relation, columns: list[str]) -> Relation:
    """Edges that gain enough in most series of both halves, with one sign, in a phase: at most EDGES, PARENTS for each target, one lag for each source."""
    keys = ("phase", "source", "target", "lag")
    rows = gains(rows, columns).group(*keys, "half", series="least(count(*), max(fitted))", gain="avg(gain)", positive="avg(CASE WHEN gain > 0e0 THEN 1e0 ELSE 0e0 END)", coefficient="max(coefficient)")
    rows = rows.where(f"series >= {SERIES} AND gain >= {num(GAIN)} AND positive >= {num(POSITIVE)}")
    rows = rows.group(*keys, halves="count(*)", gain="min(gain)", signs="min(sign(coefficient)) * max(sign(coefficient))").where("halves = 2 AND signs > 0").add(supported="1")
    rows = rows.add(best="row_number() OVER (PARTITION BY source, target ORDER BY gain DESC, lag, phase)").where("best = 1")
    rows = rows.add(place="row_number() OVER (PARTITION BY target ORDER BY gain DESC, source)").where(f"place <= {PARENTS}")
    return rows.add(rank_all="row_number() OVER (ORDER BY gain DESC, target, source)").where(f"rank_all <= {EDGES}")
