"""Losses, cluster inference, multiple testing and gates over scores; blends of scores."""

from __future__ import annotations

from tidemark.functions.numeric import normal_distribution
from tidemark.operators import metrics
from tidemark.plans.relation import Relation, num


def losses(scores: Relation) -> Relation:
    """Series-weighted log loss, Brier score, recalls and balanced accuracy of p against y."""
    rows = scores.add(q="least(1e0 - 1e-7, greatest(1e-7, p))", w="1e0 / count(*) OVER (PARTITION BY id)")
    rows = rows.add(loss="-(y * ln(q) + (1 - y) * ln(1e0 - q))", brier="2e0 * (p - y) * (p - y)", hit="CASE WHEN (p > 0.5e0 AND y = 1) OR (p <= 0.5e0 AND y = 0) THEN w ELSE 0e0 END")
    rows = rows.group(rows="count(*)", series="count(DISTINCT id)", log_loss="sum(w * loss) / sum(w)", brier="sum(w * brier) / sum(w)", recall0="sum(CASE WHEN y = 0 THEN hit END) / sum(CASE WHEN y = 0 THEN w END)", recall1="sum(CASE WHEN y = 1 THEN hit END) / sum(CASE WHEN y = 1 THEN w END)")
    return rows.add(balanced="(recall0 + recall1) / 2e0")


def gains(scores: Relation, reference: str, *others: str) -> Relation:
    """For each other score: the mean over series of the drop in log loss against the reference, its normal two-sided p-value by series."""
    loss = lambda c: f"-(y * ln(least(1e0 - 1e-7, greatest(1e-7, {c}))) + (1 - y) * ln(1e0 - least(1e0 - 1e-7, greatest(1e-7, {c}))))"
    parts = " UNION ALL ".join(f"SELECT id, '{c}' AS name, avg({loss(reference)} - ({loss(c)})) AS gain FROM $1 GROUP BY id" for c in others)
    rows = scores.then(parts).group("name", series="count(*)", gain="avg(gain)", se="stddev_samp(gain) / sqrt(count(*))")
    return rows.add(zs="abs(gain) / nullif(se, 0e0)").add(p_value=f"least(1e0, 2e0 * (1e0 - ({normal_distribution('zs')})))")


def holm(rows: Relation) -> Relation:
    """Adds the step-down adjusted p-value."""
    rows = rows.add(place="row_number() OVER (ORDER BY p_value, name)", family="count(*) OVER ()")
    return rows.add(raw="least(1e0, p_value * (family - place + 1))").add(adjusted="max(raw) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")


def endpoints(scores: Relation) -> Relation:
    """Adds, for each row, its wins among the opposite class of its time, and that class's number."""
    rows = scores.add(pos="sum(y) OVER (PARTITION BY t)", neg="sum(1 - y) OVER (PARTITION BY t)", pos_upto="sum(y) OVER (PARTITION BY t ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", neg_upto="sum(1 - y) OVER (PARTITION BY t ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", pos_tied="sum(y) OVER (PARTITION BY t, p)", neg_tied="sum(1 - y) OVER (PARTITION BY t, p)")
    return rows.add(wins="CASE WHEN y = 1 THEN neg_upto - neg_tied / 2e0 ELSE pos - pos_upto + pos_tied / 2e0 END", degree="CASE WHEN y = 1 THEN neg ELSE pos END")


def influence(scores: Relation) -> Relation:
    """For each series: its first-order influence on the time-wise AUC."""
    auc = metrics.ts_auc(scores)
    rows = endpoints(scores).then("SELECT /*+ BROADCAST($2) */ $1.*, $2.ts_auc, $2.pairs FROM $1 CROSS JOIN $2", auc)
    return rows.group("id", influence="sum(wins - ts_auc * degree) / greatest(max(pairs), 1)", ts_auc="max(ts_auc)")


def cluster_interval(scores: Relation) -> Relation:
    """The time-wise AUC with a normal interval over series."""
    rows = influence(scores).group(ts_auc="max(ts_auc)", series="count(*)", ss="sum(influence * influence)")
    rows = rows.add(se="sqrt(series / greatest(series - 1, 1) * 1e0 * ss)")
    return rows.add(low="greatest(0e0, ts_auc - 1.96e0 * se)", high="least(1e0, ts_auc + 1.96e0 * se)")


def slices(scores: Relation) -> Relation:
    """Time-wise AUC within bins of online time and, for positives, of time since the break (negatives are in all of those)."""
    times, ages = [(0, 10), (10, 25), (25, 50), (50, 100), (100, 200), (200, 10**9)], [(0, 5), (5, 10), (10, 20), (20, 50), (50, 10**9)]
    parts = [f"SELECT 'online_time' AS kind, {a} AS low, id, t, y, p FROM $1 WHERE t - 1 >= {a} AND t - 1 < {b}" for a, b in times]
    parts += [f"SELECT 'evidence_age' AS kind, {a} AS low, id, t, y, p FROM $1 WHERE y = 0 OR (t - 1 - tau >= {a} AND t - 1 - tau < {b})" for a, b in ages]
    rows = scores.then(" UNION ALL ".join(parts))
    counts = rows.group("kind", "low", rows="count(*)", positive="sum(y)", mean="avg(p)", p95="percentile(CASE WHEN y = 0 THEN p END, 0.95e0)")
    auc = metrics.ts_auc(rows, "kind", "low")
    return counts.then("SELECT $1.*, $2.pairs, $2.ts_auc FROM $1 JOIN $2 ON $1.kind = $2.kind AND $1.low = $2.low", auc)


#: Where the bins of online time begin.
TIME_BINS = (0, 10, 25, 50, 100, 200, 400)


def time_credits(scores: Relation, reference: str) -> Relation:
    """For each bin of online time: its share of all pairs, its gain in AUC over the reference score, and what it adds to the whole gain. Bins without pairs have a null gain."""
    old = metrics.auc_by_time(scores.keep("id", "t", "y", p=reference))
    rows = metrics.auc_by_time(scores.keep("id", "t", "y", "p")).then("SELECT $1.t - 1 AS time, $1.pairs, $1.wins - $2.wins AS delta FROM $1 JOIN $2 ON $1.t = $2.t", old)
    rows = rows.add(low="CASE " + " ".join(f"WHEN time >= {a} THEN {a}" for a in reversed(TIME_BINS)) + " END").group("low", pairs="sum(pairs)", delta="sum(delta)")
    bins = Relation.select(" UNION ALL ".join(f"SELECT {a} AS low" for a in TIME_BINS))
    rows = bins.then("SELECT $1.low, coalesce($2.pairs, 0) AS pairs, coalesce($2.delta, 0e0) AS delta FROM $1 LEFT JOIN $2 ON $1.low = $2.low", rows)
    rows = rows.add(total="nullif(sum(pairs) OVER (), 0) * 1e0")
    return rows.keep("low", pairs="cast(pairs AS bigint)", share="pairs / total", gain="delta / nullif(pairs, 0)", credit="delta / total")


def delete_one(scores: Relation) -> Relation:
    """The time-wise AUC without each series in turn: a series' wins and pairs are taken off the sums over all, so no score is ranked again."""
    parts = endpoints(scores).group("id", wins="sum(wins)", pairs="sum(degree)")
    whole = parts.group(all_wins="sum(wins) / 2e0", all_pairs="sum(pairs) / 2e0")  # each pair has two ends
    rows = parts.then("SELECT /*+ BROADCAST($2) */ $1.id, all_wins - wins AS wins, all_pairs - pairs AS pairs FROM $1 CROSS JOIN $2", whole)
    return rows.keep("id", pairs="cast(pairs AS bigint)", ts_auc="CASE WHEN pairs > 0.5e0 THEN wins / pairs ELSE 0.5e0 END")


def draws(ids: Relation, replicates: int) -> Relation:
    """Whole-series resamples: replicate, id, weight. Replicate 0 is the sample itself; the others draw as many series with replacement, by a fixed integer hash."""
    rows = ids.add(k="LONG(row_number() OVER (ORDER BY id)) - 1", n="count(*) OVER ()")
    picks = rows.then(f"SELECT k, n, EXPAND(0, {replicates}) AS replicate FROM $1")
    picks = picks.add(mixed="((cast(replicate AS bigint) * 48271 + k * 69621 + 12345) % 2147483647) * 16807 % 2147483647").add(pick="CASE WHEN replicate = 0 THEN k ELSE (cast(mixed AS bigint) * 16807 % 2147483647) % n END")
    return picks.group("replicate", "pick", weight="count(*)").then("SELECT $1.replicate, $2.id, $1.weight FROM $1 JOIN $2 ON $1.pick = $2.k", rows)


def joint_envelope(replicates: Relation, level: float = 0.95) -> Relation:
    """replicates (replicate, name, value), where replicate 0 is the sample -> for each name its value, standard error, interval over draws and joint bounds.

    The joint bounds hold for all names at once: the critical value is the quantile over draws of the largest standardised error of any name. Names whose
    draws don't vary have null bounds and don't enter the critical value.
    """
    rows = replicates.add(own="max(CASE WHEN replicate = 0 THEN value END) OVER (PARTITION BY name)").where("replicate > 0")
    rows = rows.add(se="nullif(stddev_samp(value) OVER (PARTITION BY name), 0e0)").add(error="abs(value - own) / se")
    critical = rows.group("replicate", worst="max(error)").group(critical=f"percentile(worst, {num(level)})")
    rows = rows.group("name", own="max(own)", se="max(se)", low="percentile(value, 0.025e0)", high="percentile(value, 0.975e0)", positive="avg(CASE WHEN value > 0e0 THEN 1e0 ELSE 0e0 END)")
    rows = rows.then("SELECT /*+ BROADCAST($2) */ $1.*, $2.critical FROM $1 CROSS JOIN $2", critical)
    return rows.add(joint_low="own - critical * se", joint_high="own + critical * se").add(above="CASE WHEN joint_low > 0e0 THEN 1 ELSE 0 END")


def gates(folds: Relation, better: float = 0.001, worst: float = 0.002) -> Relation:
    """Summary over folds (fold, reference, candidate) and whether the candidate is promoted; null evidence leaves a gate null."""
    rows = folds.add(delta="candidate - reference").group(folds="count(*)", mean="avg(candidate)", median="percentile(candidate, 0.5e0)", sd="stddev_pop(candidate)", worst="min(candidate)", best="max(candidate)", delta_median="percentile(delta, 0.5e0)", delta_worst="min(candidate) - min(reference)")
    return rows.add(gain_ok=f"CASE WHEN delta_median IS NULL THEN NULL WHEN delta_median >= {num(better)} THEN 1 ELSE 0 END", worst_ok=f"CASE WHEN delta_worst IS NULL THEN NULL WHEN delta_worst >= {num(-worst)} THEN 1 ELSE 0 END")


def blended(scores: Relation, left: str, right: str, weight: float = 0.5) -> Relation:
    """Adds blend: both scores as 32-bit floats, mixed, as a 32-bit float."""
    return scores.add(blend=f"cast(cast({num(weight)} * cast(cast({left} AS float) AS double) + {num(1 - weight)} * cast(cast({right} AS float) AS double) AS float) AS double)")


def routed(scores: Relation, primary: str, complement: str, kind: str = "gap") -> Relation:
    """Adds route: the complement's weight steps up to .3 with its lead over the primary score, or with its share of the evidence."""
    gap = f"({complement} - {primary})"
    weight = f"CASE WHEN {gap} > 0.1e0 THEN 0.3e0 WHEN {gap} > 0e0 THEN 0.2e0 WHEN {gap} > -0.1e0 THEN 0.1e0 ELSE 0e0 END"
    if kind == "ratio":
        ratio = f"({complement} / (1e0 + {primary}))"
        weight = f"CASE WHEN {complement} < 0.2e0 THEN 0e0 WHEN {ratio} > 0.6e0 THEN 0.3e0 WHEN {ratio} > 0.4e0 THEN 0.2e0 WHEN {ratio} > 0.2e0 THEN 0.1e0 ELSE 0e0 END"
    return scores.add(route_weight=weight).add(route=f"(1e0 - route_weight) * {primary} + route_weight * {complement}")


def residual_complement(scores: Relation, primary: str, strength: str, response: str, ridge: float = 0.01, share: float = 0.2) -> Relation:
    """Adds complemented: primary plus a share of what a ridge regression on (primary, strength) leaves of the response, in [0, 1].

    Rows weigh by the opposite class at their time. With centred, scaled predictors the three normal equations are solved in closed form.
    """
    rows = scores.add(weight="CASE WHEN y = 1 THEN sum(1 - y) OVER (PARTITION BY t) ELSE sum(y) OVER (PARTITION BY t) END")
    c = rows.group(mu1=f"avg({primary})", mu2=f"avg({strength})", sd1=f"greatest(stddev_pop({primary}), 1e-6)", sd2=f"greatest(stddev_pop({strength}), 1e-6)")
    rows = rows.then(f"SELECT /*+ BROADCAST($2) */ $1.*, greatest(-8e0, least(8e0, ({primary} - mu1) / sd1)) AS a, greatest(-8e0, least(8e0, ({strength} - mu2) / sd2)) AS b FROM $1 CROSS JOIN $2", c)
    m = rows.group(w="sum(weight)", **{f"s{k}": f"sum(weight * {e}) / sum(weight)" for k, e in (("a", "a"), ("b", "b"), ("aa", "a * a"), ("bb", "b * b"), ("ab", "a * b"), ("y", response), ("ay", f"a * {response}"), ("by", f"b * {response}"))})
    # eliminating the unpenalised intercept leaves two equations
    m = m.add(caa=f"saa - sa * sa + {num(ridge)}", cbb=f"sbb - sb * sb + {num(ridge)}", cab="sab - sa * sb", cay="say - sa * sy", cby="sby - sb * sy").add(det="caa * cbb - cab * cab")
    m = m.add(k1="(cay * cbb - cby * cab) / det", k2="(cby * caa - cay * cab) / det").add(k0="sy - k1 * sa - k2 * sb")
    return rows.then(f"SELECT /*+ BROADCAST($2) */ $1.*, k0, k1, k2, greatest(0e0, least(1e0, {primary} + {num(share)} * ({response} - (k0 + k1 * a + k2 * b)))) AS complemented FROM $1 CROSS JOIN $2", m)
