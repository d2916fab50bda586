"""Disjoint blocks of BLOCK points, confirmation over the last four, and what is remembered of confirmed events."""

from __future__ import annotations

import math

from tidemark.plans.relation import Relation, num

BLOCK, MEMORY, CAP, EPISODES, RECOVERY = 16, 4, 4.0, 7, 2


def block_levels(rows: Relation) -> Relation:
    """One row for each whole block: id, segment (fit, calibration or online), block from 0, its last t and log of the median absolute deviation."""
    rows = rows.add(n="t + n_h", n_fit="cast(floor(n_h * 6 / 10e0) AS bigint)")
    rows = rows.add(segment="CASE WHEN n <= n_fit THEN 'fit' WHEN t <= 0 THEN 'calibration' ELSE 'online' END", place="CASE WHEN n <= n_fit THEN n - 1 WHEN t <= 0 THEN n - n_fit - 1 ELSE t - 1 END")
    rows = rows.add(block=f"cast(floor(place / {num(BLOCK)}) AS bigint)", fit_med="percentile(CASE WHEN n <= n_fit THEN value END, 0.5e0) OVER (PARTITION BY id)")
    rows = rows.add(fit_off="abs(value - fit_med)", med="percentile(value, 0.5e0) OVER (PARTITION BY id, segment, block)")
    rows = rows.add(off="abs(value - med)", eps="greatest(1e-12 * percentile(CASE WHEN n <= n_fit THEN fit_off END, 0.5e0) OVER (PARTITION BY id), 1e-30)")
    rows = rows.group("id", "segment", "block", t="max(t)", points="count(*)", level="LN(greatest(percentile(off, 0.5e0), max(eps)))")
    return rows.where(f"points = {BLOCK}")


def block_evidence(rows: Relation) -> Relation:
    """Online blocks with z, the level against shrunken fit and calibration references, and pit, its logit rank; both clipped."""
    rows = block_levels(rows)
    part = lambda s, x: f"CASE WHEN segment = '{s}' THEN {x} END"
    columns = {f"n_{s[:3]}": f"sum(CASE WHEN segment = '{s}' THEN 1 ELSE 0 END) OVER (PARTITION BY id)" for s in ("fit", "calibration")}
    columns |= {f"{s[:3]}_{n}": f"percentile({part(s, 'level')}, {num(q)}) OVER (PARTITION BY id)" for s in ("fit", "calibration") for n, q in (("q1", 0.25), ("q2", 0.5), ("q3", 0.75))}
    rows = rows.add(**columns, used="CASE WHEN segment = 'calibration' THEN 1 ELSE 0 END")
    # few calibration blocks: the fit blocks take their place
    rows = rows.add(**{f"use_{q}": f"CASE WHEN n_cal < 16 THEN fit_{q} ELSE cal_{q} END" for q in ("q1", "q2", "q3")}, in_use="CASE WHEN segment = CASE WHEN n_cal < 16 THEN 'fit' ELSE 'calibration' END THEN 1 ELSE 0 END", in_fit="CASE WHEN segment = 'fit' THEN 1 ELSE 0 END")
    rows = rows.add(centre="(n_cal * use_q2 + 32e0 * fit_q2) / (n_cal + 32e0)", spread="sqrt((n_cal * pow(greatest((use_q3 - use_q1) / 1.349e0, 0.15e0), 2e0) + 32e0 * pow(greatest((fit_q3 - fit_q1) / 1.349e0, 0.15e0), 2e0)) / (n_cal + 32e0))")
    middle = lambda c: f"(sum({c}) OVER (PARTITION BY id ORDER BY level RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - sum({c}) OVER (PARTITION BY id, level) / 2e0)"
    rows = rows.add(prior=f"({middle('in_fit')} + 0.5e0) / (sum(in_fit) OVER (PARTITION BY id) + 1e0)", mid=middle("in_use"), n_use="sum(in_use) OVER (PARTITION BY id)").where("segment = 'online'")
    rows = rows.add(u="(mid + 32e0 * prior + 0.5e0) / (n_use + 33e0)")
    return rows.add(z=f"greatest({num(-CAP)}, least({num(CAP)}, (level - centre) / spread))", pit=f"greatest({num(-CAP)}, least({num(CAP)}, ln(u / (1e0 - u)) / {num(math.pi / math.sqrt(3))}))")


def confirmed(blocks: Relation, channel: str = "pit") -> Relation:
    """Adds strength and direction by three rules over the last four blocks: all agree (their least), three agree and two agree (their mean)."""
    window = f"OVER (PARTITION BY id ORDER BY block ROWS BETWEEN {MEMORY - 1} PRECEDING AND CURRENT ROW)"
    rows = blocks.add(ups=f"sum(CASE WHEN {channel} > 0e0 THEN 1 ELSE 0 END) {window}", downs=f"sum(CASE WHEN {channel} < 0e0 THEN 1 ELSE 0 END) {window}", total=f"sum({channel}) {window}", low=f"min({channel}) {window}", high=f"max({channel}) {window}")
    full = f"block >= {MEMORY - 1}"
    rules = {"hard": ("low", "-high", 4), "soft": ("total / 4e0", "-total / 4e0", 3), "sum": ("total / 4e0", "-total / 4e0", 2)}
    for name, (up, down, least) in rules.items():
        rows = rows.add(**{f"{name}_up": f"CASE WHEN {full} AND ups >= {least} THEN greatest(0e0, {up}) ELSE 0e0 END", f"{name}_down": f"CASE WHEN {full} AND downs >= {least} THEN greatest(0e0, {down}) ELSE 0e0 END"})
        rows = rows.add(**{name: f"greatest({name}_up, {name}_down)", f"{name}_direction": f"CASE WHEN {name}_up = 0e0 AND {name}_down = 0e0 THEN 0 WHEN {name}_down >= {name}_up THEN -1 ELSE 1 END"})
    return rows


def events(blocks: Relation, strength: str = "hard", cut: float = 0.5) -> Relation:
    """Adds the memory of events: confirmed, episodes, ages since the first and the last confirmation in points, recovery, direction and state.

    States: 4 while confirmed, 5 for RECOVERY blocks after, else 3 (a strong block) or 1.
    """
    by, upto = "PARTITION BY id ORDER BY block", "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    rows = blocks.add(ratio=f"{strength} / {num(cut)}").add(confirm="CASE WHEN ratio > 1e0 THEN 1 ELSE 0 END")
    rows = rows.add(before=f"coalesce(lag(confirm) OVER ({by}), 0)", mark="CASE WHEN confirm = 1 THEN t END", block_mark="CASE WHEN confirm = 1 THEN block END", way=f"CASE WHEN confirm = 1 THEN {strength}_direction END")
    rows = rows.add(episodes=f"least(sum(CASE WHEN confirm = 1 AND before = 0 THEN 1 ELSE 0 END) OVER ({by} {upto}), {EPISODES})", first=f"min(mark) OVER ({by} {upto})", latest=f"max(mark) OVER ({by} {upto})", last_block=f"max(block_mark) OVER ({by} {upto})", direction=f"coalesce(KNOWN(way) OVER ({by} {upto}), 0)", ever=f"max(CASE WHEN confirm = 1 THEN 1e0 - exp(-ratio) ELSE 0e0 END) OVER ({by} {upto})")
    rows = rows.add(age_first="coalesce(t - first, -1)", age_last="coalesce(t - latest, -1)", since="coalesce(block - last_block, 1000000)")
    return rows.add(recovery=f"CASE WHEN since BETWEEN 1 AND {RECOVERY} THEN 1 ELSE 0 END", state=f"CASE WHEN confirm = 1 THEN 4 WHEN since BETWEEN 1 AND {RECOVERY} THEN 5 WHEN abs(z) >= 2e0 THEN 3 ELSE 1 END")


def fresh_channels(rows: Relation) -> Relation:
    """Block means of rank channels against the history's blocks: id, block, n0 .. n7 clipped, and the dominant one that kept its sign and size for four blocks."""
    from tidemark.operators.whitening import uniform

    rows = uniform(rows, "value", "u0").add(u="2e0 * u0 - 1e0")
    rows = rows.add(**{f"p{k}": f"coalesce(lag(u, {k}) OVER (PARTITION BY id ORDER BY t), 0e0)" for k in (1, 4)}, e2="avg(CASE WHEN t <= 0 THEN u * u END) OVER (PARTITION BY id)")
    forms = ["u", "u * u", "CASE WHEN abs(u) > 0.9e0 THEN 1e0 ELSE 0e0 END", "u * u * u", "u * p1", "u * p4", "(u * u - e2) * (p1 * p1 - e2)", "(u * u - e2) * (p4 * p4 - e2)"]
    rows = rows.add(**{f"c{k}": f for k, f in enumerate(forms)}, block=f"cast(floor((t - 1) / {num(BLOCK)}) AS bigint)")
    rows = rows.group("id", "block", points="count(*)", **{f"m{k}": f"avg(c{k})" for k in range(8)}).where(f"points = {BLOCK}")
    rows = rows.add(**{f"k{k}": f"percentile(CASE WHEN block < 0 THEN m{k} END, 0.5e0) OVER (PARTITION BY id)" for k in range(8)})
    rows = rows.add(**{f"o{k}": f"abs(m{k} - k{k})" for k in range(8)})
    rows = rows.add(**{f"s{k}": f"greatest(1.4826e0 * percentile(CASE WHEN block < 0 THEN o{k} END, 0.5e0) OVER (PARTITION BY id), 1e-6)" for k in range(8)}).where("block >= 0")
    rows = rows.add(**{f"n{k}": f"greatest(-12e0, least(12e0, (m{k} - k{k}) / s{k}))" for k in range(8)})
    window = f"OVER (PARTITION BY id ORDER BY block ROWS BETWEEN {MEMORY - 1} PRECEDING AND CURRENT ROW)"
    rows = rows.add(**{f"g{k}": f"CASE WHEN block < {MEMORY - 1} THEN 0e0 ELSE greatest(0e0, min(n{k}) {window}, -(max(n{k}) {window})) END" for k in range(8)})
    rows = rows.add(severity=f"greatest({', '.join(f'g{k}' for k in range(8))})")
    return rows.add(dominant="CASE " + " ".join(f"WHEN g{k} >= severity THEN {k}" for k in range(8)) + " END")
