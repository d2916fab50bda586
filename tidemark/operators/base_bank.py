"""The base bank: references of the history, and the statistics of every online point against them.

Everything is a window over one partitioning by id, so a panel is shuffled once. Columns that a query doesn't select are pruned by the planner.
"""

from __future__ import annotations

from dataclasses import dataclass

from tidemark.functions import kit
from tidemark.plans.relation import Relation, num
from tidemark.sources.panel import sanitised


@dataclass(frozen=True)
class Settings:
    """Constants of the bank (fixed values)."""

    scales: tuple[int, ...] = (5, 20, 80)
    lags: tuple[int, ...] = (1, 2, 4, 8)
    tails: tuple[float, float] = (2.0, 3.0)
    cuts: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)
    clip: float = 20.0
    drift: float = 0.25
    decay: float = 0.99
    phi_limit: float = 0.99
    moment_floor: float = 1e-8
    rate_floor: float = 0.01
    scale_floor: float = 1e-8
    mad_factor: float = 1.4826
    mad_share: float = 0.01
    robust: bool = False


STATS = ("z", "square", "size", "tail_low", "tail_high", "positive")
H = "CASE WHEN t <= 0 THEN {} END"


def referenced(rows: Relation, s: Settings = Settings()) -> Relation:
    """Adds mean, sd, med, mad of the history and the standardised z and robust of every row."""
    rows = sanitised(rows).add(mean_h="avg(filled) OVER (PARTITION BY id)", sd_raw_h="stddev_samp(filled) OVER (PARTITION BY id)", deviation="abs(filled - med_h)")
    rows = rows.add(mad_raw="percentile(deviation, 0.5e0) OVER (PARTITION BY id)", sd_h=f"greatest(coalesce(sd_raw_h, 1e0), {num(s.scale_floor)})")
    rows = rows.add(mad_h=f"greatest(mad_raw * {num(s.mad_factor)}, sd_h * {num(s.mad_share)}, {num(s.scale_floor)})")
    at, by = ("med_h", "mad_h") if s.robust else ("mean_h", "sd_h")
    return rows.add(z=kit.clip(f"(x - {at}) / {by}", s.clip), robust_z=kit.clip("(x - med_h) / mad_h", s.clip))


def statistics(rows: Relation, s: Settings = Settings()) -> Relation:
    """Adds each row's 17 statistics and their means over the history (b_...); lagged products reach back over the border."""
    rows = rows.add(**{f"z{k}": kit.lag("z", k) for k in s.lags})
    low, high = s.tails
    rows = rows.add(square="z * z", size="abs(z)", tail_low=kit.flag(f"abs(z) > {num(low)}"), tail_high=kit.flag(f"abs(z) > {num(high)}"), positive=kit.flag("z > 0e0"), **{f"lag{k}": f"z * coalesce(z{k}, CASE WHEN t > 0 THEN 0e0 END)" for k in s.lags}, **{f"cut{i}": f"percentile({H.format('z')}, {num(q)}) OVER (PARTITION BY id)" for i, q in enumerate(s.cuts)})
    rows = rows.add(bin=" + ".join(f"CASE WHEN z > cut{i} THEN 1 ELSE 0 END" for i in range(len(s.cuts))), **{f"b_{c}": f"coalesce(avg({H.format(c)}) OVER (PARTITION BY id), 0e0)" for c in (*STATS, *(f"lag{k}" for k in s.lags))})
    rows = rows.add(phi=kit.clip(f"b_lag{s.lags[0]} / greatest(b_square, {num(s.moment_floor)})", s.phi_limit), **{f"in{i}": kit.flag(f"bin = {i}") for i in range(len(s.cuts) + 1)})
    rows = rows.add(error="CASE WHEN t > 0 THEN z - phi * coalesce(z1, 0e0) WHEN z1 IS NOT NULL THEN z - phi * z1 WHEN n_h = 1 THEN z END", **{f"b_in{i}": f"avg({H.format(f'in{i}')}) OVER (PARTITION BY id)" for i in range(len(s.cuts) + 1)})
    rows = rows.add(error2="error * error")
    return rows.add(b_error=f"avg({H.format('error')}) OVER (PARTITION BY id)", b_error2=f"avg({H.format('error2')}) OVER (PARTITION BY id)")


def names(s: Settings = Settings()) -> list[str]:
    return [*STATS, *(f"lag{k}" for k in s.lags), "error", "error2", *(f"in{i}" for i in range(len(s.cuts) + 1))]


def averages(rows: Relation, s: Settings = Settings(), only: tuple[str, ...] | None = None) -> Relation:
    """Online rows with the moving average of each statistic at each scale (e5_z and so on) and the effective number of points."""
    rows = rows.where("t > 0")
    rows = rows.add(**{f"e{k}_{c}": kit.ewma(c, 1 / k, f"b_{c}") for k in s.scales for c in only or names(s)})
    return rows.add(**{f"root{k}": f"sqrt({num(k)} * (1e0 - exp({num(_log_keep(k))} * t)))" for k in s.scales})


def _log_keep(scale: int) -> float:
    import math

    return math.log1p(-1 / scale)


def features(rows: Relation, s: Settings = Settings(), also: tuple[str, ...] = ()) -> Relation:
    """The bank's output columns for a panel, one row for each online point, and the panel's columns named in also."""
    rows = averages(statistics(referenced(rows, s), s), s)
    rows = rows.add(up=kit.running(f"z - {num(s.drift)}"), down=kit.running(f"-z - {num(s.drift)}"), running_mean=f"{kit.running('z')} / t")
    rows = rows.add(cusum_positive=f"ln(1e0 + {kit.reflected('up')})", cusum_negative=f"ln(1e0 + {kit.reflected('down')})")
    floor = num(s.moment_floor)
    columns = {}
    for k in s.scales:
        e, root = f"e{k}_", f"root{k}"
        columns |= {
            f"mean_z_{k}": f"({e}z - b_z) * {root}",
            f"log_second_ratio_{k}": f"ln(greatest({e}square, {floor}) / greatest(b_square, {floor}))",
            f"log_variance_ratio_{k}": f"ln(greatest({e}square - {e}z * {e}z, {floor}) / greatest(b_square - b_z * b_z, {floor}))",
            f"absolute_moment_delta_{k}": f"({e}size - b_size) * {root}",
            **{f"{name}_{k}": f"({e}{c} - b_{c}) * {root} / sqrt(greatest(b_{c} * (1e0 - b_{c}), {num(s.rate_floor)}))" for name, c in (("tail2_delta", "tail_low"), ("tail3_delta", "tail_high"), ("sign_delta", "positive"))},
            f"quantile_l1_{k}": f"({' + '.join(f'abs({e}in{i} - b_in{i})' for i in range(len(s.cuts) + 1))}) * {root}",
            **{f"lag{j}_delta_{k}": f"({e}lag{j} - b_lag{j}) * {root}" for j in s.lags},
            f"ar_mean_z_{k}": f"({e}error - b_error) * {root} / sqrt(greatest(b_error2, {floor}))",
            f"ar_log_second_ratio_{k}": f"ln(greatest({e}error2, {floor}) / greatest(b_error2, {floor}))",
        }
    rows = rows.add(**columns)
    fast, slow = s.scales[0], s.scales[-1]
    evidence = [f"abs(mean_z_{k}) / 3e0" for k in s.scales] + [f"abs(log_variance_ratio_{k})" for k in s.scales] + [f"abs(lag{s.lags[0]}_delta_{k}) / 3e0" for k in s.scales]
    rows = rows.add(fast_slow_mean=f"e{fast}_z - e{slow}_z", fast_slow_scale=f"ln(greatest(e{fast}_square, {floor}) / greatest(e{slow}_square, {floor}))", fast_slow_dependence=f"e{fast}_lag{s.lags[0]} - e{slow}_lag{s.lags[0]}", evidence=kit.biggest(*evidence), **{f"abs_mean_z_{k}": f"abs(mean_z_{k})" for k in s.scales})
    rows = rows.add(evidence_max=kit.running("evidence", "max"), evidence_decayed_max=kit.decayed_max("evidence", s.decay))
    return rows.keep("id", "t", "y", *also, *output(s))


def output(s: Settings = Settings()) -> list[str]:
    per_scale = ["mean_z", "abs_mean_z", "log_second_ratio", "log_variance_ratio", "absolute_moment_delta", "tail2_delta", "tail3_delta", "sign_delta", "quantile_l1", *(f"lag{k}_delta" for k in s.lags), "ar_mean_z", "ar_log_second_ratio"]
    return ["z", "robust_z", "missing", "cusum_positive", "cusum_negative", "running_mean", *(f"{c}_{k}" for k in s.scales for c in per_scale), "fast_slow_mean", "fast_slow_scale", "fast_slow_dependence", "evidence_max", "evidence_decayed_max"]


def squash(x: str) -> str:
    return f"({x}) / (1e0 + ({x}))"


def baselines(bank: Relation, s: Settings = Settings(), also: tuple[str, ...] = ()) -> Relation:
    """Scores B2 to B7 from the bank, and the constant B0."""
    each = lambda c: [f"abs({c}_{k})" for k in s.scales]
    rows = bank.add(
        mean_part=f"{kit.biggest(*each('mean_z'))} / 3e0",
        cusum_part="greatest(cusum_positive, cusum_negative) / 4e0",
        scale_part=f"{kit.biggest(*each('log_variance_ratio'))} / 2e0",
        tail_part=f"{kit.biggest(*each('tail2_delta'), *(f'quantile_l1_{k}' for k in s.scales))} / 4e0",
        dependence_part=f"{kit.biggest(*each(f'lag{s.lags[0]}_delta'), *each('ar_log_second_ratio'))} / 4e0",
    )
    return rows.keep("id", "t", "y", *also, b0="0.5e0", b2=squash("mean_part"), b3=squash("cusum_part"), b4=squash("scale_part"), b5=squash("tail_part"), b6=squash("dependence_part"), b7=squash("(mean_part + scale_part + tail_part + dependence_part) / 4e0"))


def official_ewma(rows: Relation) -> Relation:
    """Score B1: an average with weight .05 against the history's mean, in units of its standard error."""
    rows = rows.add(mean_h="avg(CASE WHEN t <= 0 THEN value END) OVER (PARTITION BY id)", sd_h="greatest(coalesce(stddev_samp(CASE WHEN t <= 0 THEN value END) OVER (PARTITION BY id), 1e0), 1e-8)").where("t > 0")
    rows = rows.add(ew=kit.ewma("value", 0.05, "mean_h"), n_eff=f"20e0 * (1e0 - exp({num(_log_keep(20))} * t))")
    return rows.add(p="tanh(abs((ew - mean_h) / greatest(sd_h / sqrt(greatest(n_eff, 1e0)), 1e-8)) / 3e0)").keep("id", "t", "y", "p")


#: Columns of the moving averages that calibration standardises, and those it reports here.
BURN, SPREAD_FLOOR, CALIBRATED_CLIP = 160, 0.05, 12.0
CALIBRATED = [f"{c}_{k}" for k in (5, 20, 80) for c in ("mean_z", "log_variance_ratio", "tail2_delta", "lag1_delta")]


def calibrated(rows: Relation, s: Settings = Settings(), robust: bool = False) -> Relation:
    """Bank columns against their own distribution when the bank runs over the history after a burn-in.

    The second run treats the whole history as if it were online: the references are the same, and time starts anew at the series' first point.
    """
    rows = statistics(referenced(rows, s), s)
    floor = num(s.moment_floor)

    def columns(part: Relation) -> Relation:
        part = part.add(**{f"e{k}_{c}": kit.ewma(c, 1 / k, f"b_{c}") for k in s.scales for c in ("z", "square", "tail_low", "lag1")})
        part = part.add(**{f"root{k}": f"sqrt({num(k)} * (1e0 - exp({num(_log_keep(k))} * t)))" for k in s.scales})
        made = {}
        for k in s.scales:
            made |= {f"mean_z_{k}": f"(e{k}_z - b_z) * root{k}", f"log_variance_ratio_{k}": f"ln(greatest(e{k}_square - e{k}_z * e{k}_z, {floor}) / greatest(b_square - b_z * b_z, {floor}))", f"tail2_delta_{k}": f"(e{k}_tail_low - b_tail_low) * root{k} / sqrt(greatest(b_tail_low * (1e0 - b_tail_low), {num(s.rate_floor)}))", f"lag1_delta_{k}": f"(e{k}_lag1 - b_lag1) * root{k}"}
        return part.add(**made)

    online = columns(rows.where("t > 0"))
    base = [c for c in ("id", "z", "square", "tail_low", "b_z", "b_square", "b_tail_low", "b_lag1")]
    past = columns(rows.where("t <= 0").keep(*base, "n_h", t="t + n_h", lag1="coalesce(lag1, 0e0)")).where(f"t > least({BURN}, floor(n_h / 2e0))")
    if robust:
        past = past.add(**{f"m_{c}": f"percentile({c}, 0.5e0) OVER (PARTITION BY id)" for c in CALIBRATED}).add(**{f"o_{c}": f"abs({c} - m_{c})" for c in CALIBRATED})
        centres = past.group("id", **{f"m_{c}": f"max(m_{c})" for c in CALIBRATED}, **{f"s_{c}": f"greatest(1.4826e0 * percentile(o_{c}, 0.5e0), {num(SPREAD_FLOOR)})" for c in CALIBRATED})
    else:
        centres = past.group("id", **{f"m_{c}": f"avg({c})" for c in CALIBRATED}, **{f"s_{c}": f"greatest(stddev_pop({c}), {num(SPREAD_FLOOR)})" for c in CALIBRATED})
    outs = ", ".join(kit.clip(f"($1.{c} - m_{c}) / s_{c}", CALIBRATED_CLIP) + f" AS {c}" for c in CALIBRATED)
    return online.then(f"SELECT $1.id, $1.t, $1.y, {outs} FROM $1 JOIN $2 ON $1.id = $2.id", centres)
