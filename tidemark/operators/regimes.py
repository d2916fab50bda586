"""Descriptors of a series' history, and what kind of change a break is, measured on both sides of it."""

from __future__ import annotations

from tidemark.functions import kit
from tidemark.plans.relation import Relation, num
from tidemark.sources.panel import sanitised

#: The lags of the history's autocorrelations.
LAGS = (1, 2, 4, 8)
DESCRIPTORS = ["location_mean", "location_median", "log_sd", "log_mad", "skewness", "log_kurtosis", "tail2_rate", "tail3_rate", "log_length", *(f"acf_{k}" for k in LAGS)]
EFFECTS = ["mean_effect", "scale_effect", "dependence_effect", "tail_effect"]


def correlation(x: str, before: str) -> str:
    """The correlation of x with an earlier value over the rows that have one; 0 with two of them or fewer."""
    own = f"CASE WHEN {before} IS NOT NULL THEN {x} END"
    return f"CASE WHEN count({before}) > 2 THEN covar_pop({own}, {before}) * count({before}) / greatest(stddev_pop({own}) * stddev_pop({before}) * count({before}), 1e-12) ELSE 0e0 END"


def descriptors(rows: Relation) -> Relation:
    """One row for each series: moments, rates beyond two and three robust deviations, and autocorrelations of the robust scores within 12, of its history.

    Missing values count as the history's median.
    """
    rows = sanitised(rows).where("t <= 0")
    rows = rows.add(mu="avg(x) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(x) OVER (PARTITION BY id), 0e0), 1e-8)", med="percentile(x, 0.5e0) OVER (PARTITION BY id)")
    rows = rows.add(off="abs(x - med)").add(mad="greatest(1.4826e0 * percentile(off, 0.5e0) OVER (PARTITION BY id), 1e-8)")
    rows = rows.add(z="(x - mu) / sd", size="off / mad", r=kit.clip("(x - med) / mad", 12))
    rows = rows.add(**{f"r{k}": kit.lag("r", k) for k in LAGS})
    return rows.group(
        "id",
        location_mean="max(mu)",
        location_median="max(med)",
        log_sd="ln(max(sd))",
        log_mad="ln(max(mad))",
        skewness="avg(z * z * z)",
        log_kurtosis="ln(greatest(avg(z * z * z * z), 1e-8))",
        tail2_rate=f"avg({kit.flag('size > 2e0')})",
        tail3_rate=f"avg({kit.flag('size > 3e0')})",
        log_length="ln(count(*) * 1e0)",
        **{f"acf_{k}": correlation("r", f"r{k}") for k in LAGS},
    )


def mechanisms(rows: Relation, window: int = 128, least: int = 32, mean: float = 0.5, scale: float = 0.25, dependence: float = 0.25, tail: float = 0.1, cutoff: float = 3.0, lags: tuple[int, ...] = (1, 2, 4)) -> Relation:
    """One row for each series: effects of its break between `window` points on either side, and the signature that they give. For evaluation only, as it reads tau.

    An effect over its threshold (mean, scale, dependence, tail) is present. The largest one gives the name, unless the second is present too and more than
    two thirds of it. Series without a break are controls; with fewer than `least` points on a side all effects are 0 and the signature is weak.
    """
    rows = sanitised(rows).add(side=f"CASE WHEN t > tau AND t <= tau + {window} THEN 1 WHEN t <= tau AND t > tau - {window} THEN 0 END")
    rows = rows.add(pre="CASE WHEN side = 0 THEN x END", post="CASE WHEN side = 1 THEN x END")
    rows = rows.add(mu="avg(pre) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(pre) OVER (PARTITION BY id), 0e0), 1e-8)", med="percentile(pre, 0.5e0) OVER (PARTITION BY id)")
    rows = rows.add(off="abs(x - med)").add(near="CASE WHEN side = 0 THEN off END")
    rows = rows.add(mad="greatest(1.4826e0 * percentile(near, 0.5e0) OVER (PARTITION BY id), sd * 0.01e0, 1e-8)")
    rows = rows.add(far=f"CASE WHEN off / mad > {num(cutoff)} THEN 1e0 ELSE 0e0 END", **{f"pre{k}": kit.lag("pre", k) for k in lags}, **{f"post{k}": kit.lag("post", k) for k in lags})
    # a lag of the first points after the break is null, as is one of points outside a side
    rows = rows.add(**{f"a{k}": f"CASE WHEN side = 0 THEN pre{k} END" for k in lags}, **{f"b{k}": f"CASE WHEN side = 1 THEN post{k} END" for k in lags})
    gaps = [f"abs(({correlation('x', f'b{k}')}) - ({correlation('x', f'a{k}')}))" for k in lags]
    found = rows.group(
        "id",
        tau="max(tau)",
        pre_count="count(pre)",
        post_count="count(post)",
        e1="abs(avg(post) - max(mu)) / max(sd)",
        e2="abs(ln(greatest(stddev_pop(post), 1e-8) / max(sd)))",
        e3=f"greatest({', '.join(['0e0', *gaps])})",
        e4="abs(avg(CASE WHEN side = 1 THEN far END) - avg(CASE WHEN side = 0 THEN far END))",
    )
    found = found.add(enough=f"CASE WHEN least(pre_count, post_count) >= {least} THEN 1 ELSE 0 END")
    found = found.keep("id", "tau", "pre_count", "post_count", "enough", **{name: f"CASE WHEN enough = 1 THEN e{i} ELSE 0e0 END" for i, name in enumerate(EFFECTS, 1)})
    found = found.add(**{f"u{i}": f"{name} / {num(limit)}" for i, (name, limit) in enumerate(zip(EFFECTS, (mean, scale, dependence, tail), strict=True), 1)})
    found = found.add(top="greatest(u1, u2, u3, u4)").add(which="CASE WHEN u1 = top THEN 1 WHEN u2 = top THEN 2 WHEN u3 = top THEN 3 ELSE 4 END")
    found = found.add(second="CASE which WHEN 1 THEN greatest(u2, u3, u4) WHEN 2 THEN greatest(u1, u3, u4) WHEN 3 THEN greatest(u1, u2, u4) ELSE greatest(u1, u2, u3) END")
    name = "CASE which WHEN 1 THEN 'MEAN_DOMINANT' WHEN 2 THEN 'SCALE_DOMINANT' WHEN 3 THEN 'DEPENDENCE_DOMINANT' ELSE 'TAIL_DOMINANT' END"
    signature = f"CASE WHEN tau IS NULL THEN 'NO_BREAK_CONTROL' WHEN enough = 0 OR top < 1e0 THEN 'WEAK_OR_AMBIGUOUS' WHEN second >= 1e0 AND top < 1.5e0 * second THEN 'MIXED' ELSE {name} END"
    return found.keep("id", "pre_count", "post_count", *EFFECTS, signature=signature)
