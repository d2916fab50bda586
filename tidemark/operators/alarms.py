"""Alarms on scores p over time, and their summary."""

from __future__ import annotations

from tidemark.plans.relation import Relation, num

Z = 1.959963984540054


def threshold(scores: Relation, alpha: float = 0.05) -> Relation:
    """The finite-sample order statistic of the maxima of series without a break; no row if the rank exceeds their number."""
    maxima = scores.where("tau IS NULL").group("id", top="max(p)").add(place="cast(row_number() OVER (ORDER BY top, id) AS bigint)", n="count(*) OVER ()")
    return maxima.where(f"place = cast(ceil((n + 1) * {num(1 - alpha)}) AS bigint)").keep("n", "place", threshold="top")


def first_alarms(scores: Relation, cut: Relation) -> Relation:
    """For each series: its first online step (from 0) over the threshold, or -1, and what that makes it. Without a threshold no series has an alarm."""
    rows = scores.then("SELECT /*+ BROADCAST($2) */ $1.*, $2.threshold FROM $1 LEFT JOIN $2 ON 1 = 1", cut)
    rows = rows.add(length="max(t) OVER (PARTITION BY id)").group("id", n_o="max(t)", tau="max(CASE WHEN tau < length THEN tau END)", first="coalesce(min(CASE WHEN p > threshold THEN t - 1 END), -1)")
    rows = rows.add(has_break="CASE WHEN tau IS NULL THEN 0 ELSE 1 END")
    rows = rows.add(false_alarm="CASE WHEN has_break = 0 AND first >= 0 THEN 1 ELSE 0 END", premature="CASE WHEN has_break = 1 AND first >= 0 AND first < tau THEN 1 ELSE 0 END", detected="CASE WHEN has_break = 1 AND first >= tau THEN 1 ELSE 0 END")
    return rows.add(delay="CASE WHEN detected = 1 THEN first - tau END")


def summary(alarms: Relation) -> Relation:
    """Rates of false, premature and clean alarms, the Wilson interval of the false ones, and quantiles of the delay."""
    rows = alarms.group(nulls="sum(1 - has_break)", breaks="sum(has_break)", false_alarms="sum(false_alarm)", premature="sum(premature)", detected="sum(detected)", delay_mean="avg(delay)", **{f"delay_q{round(q * 100)}": f"percentile(delay, {num(q)})" for q in (0.5, 0.9)}, **{f"within_{h}": f"sum(CASE WHEN delay <= {h} THEN 1 ELSE 0 END)" for h in (10, 25, 50)})
    rows = rows.add(rate="false_alarms / (nulls * 1e0)")
    centre, radius, below = f"(rate + {num(Z * Z / 2)} / nulls)", f"({num(Z)} * sqrt(rate * (1e0 - rate) / nulls + {num(Z * Z / 4)} / nulls / nulls))", f"(1e0 + {num(Z * Z)} / nulls)"
    return rows.add(rate_low=f"greatest(0e0, ({centre} - {radius}) / {below})", rate_high=f"least(1e0, ({centre} + {radius}) / {below})")


def age_normalised(p: str, beta: float) -> str:
    """p discounted for the time that has passed: p / (p + (1 - p) (1 + t / 128) ** beta), with t from 0."""
    return f"({p} / ({p} + (1e0 - {p}) * pow(1e0 + (t - 1) / 128e0, {num(beta)})))"


def bootstrapped(alarms: Relation, weights: Relation) -> Relation:
    """Intervals of the alarm rates over whole-series resamples (replicate, id, weight); replicate 0 is the sample."""
    rows = alarms.then("SELECT $2.replicate, $2.weight, $1.has_break, $1.false_alarm, $1.premature, $1.detected FROM $1 JOIN $2 ON $1.id = $2.id", weights)
    rates = {"false_rate": ("false_alarm", "1 - has_break"), "premature_rate": ("premature", "has_break"), "detected_rate": ("detected", "has_break")}
    rows = rows.group("replicate", **{k: f"sum(weight * {a}) / nullif(sum(weight * ({b})) * 1e0, 0e0)" for k, (a, b) in rates.items()})
    parts = " UNION ALL ".join(f"SELECT '{k}' AS rate, max(CASE WHEN replicate = 0 THEN {k} END) AS own, percentile(CASE WHEN replicate > 0 THEN {k} END, 0.025e0) AS low, percentile(CASE WHEN replicate > 0 THEN {k} END, 0.975e0) AS high FROM $1" for k in rates)
    return rows.then(parts)
