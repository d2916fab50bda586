"""Movement states, transition laws and future targets of a feature x; codes 0 down, 1 flat, 2 up, 3 unknown."""

from __future__ import annotations

from tidemark.operators.statistics import draws
from tidemark.plans.relation import Relation, num

SPAN, HORIZONS, SMOOTHING = 16, (1, 4, 16), 0.5
W = "PARTITION BY id ORDER BY t"


def thresholds(rows: Relation, x: str = "z", floor: float = 0.02) -> Relation:
    """Adds x, epsilon (median step of the history), low and high (its 20 and 80 % quantiles)."""
    rows = rows.add(x=x).add(step=f"x - lag(x) OVER ({W})")
    rows = rows.add(size="abs(step)")
    return rows.add(epsilon=f"greatest(percentile(CASE WHEN t <= 0 THEN size END, 0.5e0) OVER (PARTITION BY id), {num(floor)})", low="percentile(CASE WHEN t <= 0 THEN x END, 0.2e0) OVER (PARTITION BY id)", high="percentile(CASE WHEN t <= 0 THEN x END, 0.8e0) OVER (PARTITION BY id)")


def category(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN 3 WHEN {x} < low THEN 0 WHEN {x} > high THEN 2 ELSE 1 END"


def direction(step: str) -> str:
    return f"CASE WHEN {step} IS NULL THEN 3 WHEN {step} > epsilon THEN 2 WHEN {step} < -epsilon THEN 0 ELSE 1 END"


def movement(rows: Relation) -> Relation:
    """Online rows with the states that the 16 values before them show: direction, with its run or slope, and reversal memory."""
    rows = rows.add(move=direction("step"))
    rows = rows.add(move1=f"lag(move) OVER ({W})")
    rows = rows.add(fresh="CASE WHEN move = move1 THEN 0 ELSE 1 END", solid="CASE WHEN move IN (0, 2) THEN move END", solid_t="CASE WHEN move IN (0, 2) THEN t END")
    before = f"OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    rows = rows.add(island=f"sum(fresh) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", prior=f"KNOWN(solid) {before}", prior_t=f"KNOWN(solid_t) {before}")
    rows = rows.add(run_now="row_number() OVER (PARTITION BY id, island ORDER BY t)", turn="CASE WHEN solid IS NOT NULL AND prior IS NOT NULL AND solid <> prior THEN t END")
    rows = rows.add(turn_prior="CASE WHEN turn IS NOT NULL THEN prior_t END", turn_to="CASE WHEN turn IS NOT NULL THEN solid END")
    rows = rows.add(last=f"lag(move) OVER ({W})", run=f"least(lag(run_now) OVER ({W}), {SPAN - 1})", last_turn=f"KNOWN(turn) {before}", last_prior=f"KNOWN(turn_prior) {before}", last_to=f"KNOWN(turn_to) {before}", changes=f"sum(fresh) OVER ({W} ROWS BETWEEN {SPAN - 2} PRECEDING AND 1 PRECEDING)", **{f"x{k}": f"lag(x, {k}) OVER ({W})" for k in range(1, 9)})
    rows = rows.where("t > 0")
    rows = rows.add(slope="(" + " + ".join(f"{num(4.5 - k)} * x{k}" for k in range(1, 9)) + ") / 42e0", seen=f"CASE WHEN last_prior >= t - {SPAN - 1} THEN 1 ELSE 0 END")
    rows = rows.add(age=f"CASE WHEN seen = 1 THEN least(t - 1 - last_turn, {SPAN - 1}) ELSE {SPAN - 1} END", bucket="CASE WHEN run = 1 THEN 0 WHEN run <= 3 THEN 1 ELSE 2 END", steep="CASE WHEN abs(slope) > epsilon THEN 1 ELSE 0 END")
    rows = rows.add(recent="CASE WHEN seen = 1 AND age <= 3 AND last_to = last THEN 1 ELSE 0 END")
    return rows.add(s1="last", s2="last * 3 + bucket", s3="last * 2 + steep", s4="CASE WHEN last = 2 THEN CASE WHEN recent = 1 THEN 3 ELSE 0 END WHEN last = 0 THEN CASE WHEN recent = 1 THEN 2 ELSE 1 END ELSE 4 END")


def futures(rows: Relation, horizons: tuple[int, ...] = HORIZONS) -> Relation:
    """Online rows with the value, change, direction, state and sign reversal at each horizon; null beyond the series."""
    rows = rows.where("t > 0")
    rows = rows.add(**{f"v{h}": f"CASE WHEN lead(t, {h}) OVER ({W}) = t + {h} THEN lead(x, {h}) OVER ({W}) END" for h in horizons})
    rows = rows.add(**{f"d{h}": f"v{h} - x" for h in horizons})
    return rows.add(**{f"move{h}": f"CASE WHEN v{h} IS NOT NULL THEN {direction(f'd{h}')} END" for h in horizons}, **{f"state{h}": f"CASE WHEN v{h} IS NOT NULL THEN {category(f'v{h}')} END" for h in horizons}, **{f"reversal{h}": f"CASE WHEN v{h} IS NOT NULL THEN CASE WHEN sign(v{h}) * sign(x) < 0 THEN 1 ELSE 0 END END" for h in horizons})


def law(rows: Relation, state: str, following: str, states: int = 3) -> Relation:
    """Transition probabilities between states: rows weigh one over their series' rows, and every cell starts at SMOOTHING."""
    rows = rows.where(f"{state} IS NOT NULL AND {following} IS NOT NULL").add(weight="1e0 / count(*) OVER (PARTITION BY id)")
    rows = rows.then("SELECT /*+ BROADCAST($2) */ $1.*, $2.weight_all FROM $1 CROSS JOIN $2", rows.group(weight_all="avg(weight)"))
    counts = rows.keep("id", a=state, b=following, w="weight / weight_all").group("a", "b", w="sum(w)", series="count(DISTINCT id)")
    cells = Relation.select(f"SELECT a, EXPAND(0, {states - 1}) AS b FROM (SELECT EXPAND(0, {states - 1}) AS a) AS s")
    rows = cells.then(f"SELECT $1.a, $1.b, coalesce($2.w, 0e0) + {num(SMOOTHING)} AS w, coalesce($2.series, 0) AS series FROM $1 LEFT JOIN $2 ON $1.a = $2.a AND $1.b = $2.b", counts)
    return rows.add(p="w / sum(w) OVER (PARTITION BY a)")


def law_shares(rows: Relation, state: str, following: str, states: int = 3) -> Relation:
    """One table of shares for each series, states squared rows at most: id, a, b and share."""
    rows = rows.where(f"{state} < {states} AND {following} < {states}").add(weight="1e0 / count(*) OVER (PARTITION BY id)")
    return rows.keep("id", "weight", a=state, b=following).group("id", "a", "b", share="sum(weight)")


def law_interval(rows: Relation, state: str, following: str, replicates: int = 2000, least: int = 64, states: int = 3) -> Relation:
    """Each transition probability with its 95 % interval over whole-series resamples; empty with fewer than `least` series.

    A series is one table of shares, states squared numbers at most, before it meets the replicates; every cell starts at SMOOTHING in each of them.
    """
    shares = law_shares(rows, state, following, states)
    drawn = shares.then("SELECT $2.replicate, $1.a, $1.b, sum($1.share * $2.weight) AS w FROM $1 JOIN $2 ON $1.id = $2.id GROUP BY $2.replicate, $1.a, $1.b", draws(shares.then("SELECT DISTINCT id FROM $1"), replicates))
    return law_bounds(shares, drawn, replicates, least, states)


def law_bounds(shares: Relation, drawn: Relation, replicates: int = 2000, least: int = 64, states: int = 3) -> Relation:
    """What law_interval() makes of the shares of series and of their sums over resamples (replicate, a, b, w)."""
    cells = Relation.select(f"SELECT replicate, a, EXPAND(0, {states - 1}) AS b FROM (SELECT replicate, EXPAND(0, {states - 1}) AS a FROM (SELECT EXPAND(0, {replicates}) AS replicate) AS r) AS s")
    laws = cells.then(f"SELECT $1.replicate, $1.a, $1.b, coalesce($2.w, 0e0) + {num(SMOOTHING)} AS w FROM $1 LEFT JOIN $2 ON $1.replicate = $2.replicate AND $1.a = $2.a AND $1.b = $2.b", drawn)
    laws = laws.add(p="w / sum(w) OVER (PARTITION BY replicate, a)")
    parts = laws.group("a", "b", point="max(CASE WHEN replicate = 0 THEN p END)", low="percentile(CASE WHEN replicate > 0 THEN p END, 0.025e0)", high="percentile(CASE WHEN replicate > 0 THEN p END, 0.975e0)")
    return parts.then(f"SELECT /*+ BROADCAST($2) */ $1.*, $2.series FROM $1 CROSS JOIN $2 WHERE $2.series >= {least}", shares.group(series="count(DISTINCT id)"))


#: Where the domains of online time after the first end, and the points of a sampling phase.
DOMAIN_ENDS, PHASES = (9, 24, 49, 99, 199, 399), 8


def phase_support(rows: Relation) -> Relation:
    """How often the states s1 to s4 occur by domain of online time (0 for all) and sampling phase (8 for all), as the mean over series of their shares.

    Only series that have points in every phase of a domain count in it, so that phases are compared on the same series.
    """
    domain = "CASE " + " ".join(f"WHEN t - 1 <= {end} THEN {k}" for k, end in enumerate(DOMAIN_ENDS, 1)) + f" ELSE {len(DOMAIN_ENDS) + 1} END"
    points = rows.keep("id", "s1", "s2", "s3", "s4", dom=domain, ph=f"(t - 1) % {PHASES}")
    counts = points.then(" UNION ALL ".join(f"SELECT id, dom, ph, {k} AS family, s{k} AS code, count(*) AS n FROM $1 GROUP BY id, dom, ph, s{k}" for k in range(1, 5)))
    sets = ", ".join(f"(id, family, code{x})" for x in (", dom, ph", ", dom", ", ph", ""))
    counts = counts.then(f"SELECT id, family, code, coalesce(dom, 0) AS domain, coalesce(ph, {PHASES}) AS phase, sum(n) AS n FROM $1 GROUP BY GROUPING SETS ({sets})")
    able = counts.where(f"phase < {PHASES}").group("id", "domain", phases="count(DISTINCT phase)").where(f"phases = {PHASES}")
    counts = counts.add(total="sum(n) OVER (PARTITION BY id, family, domain, phase)").then("SELECT $1.* FROM $1 JOIN $2 ON $1.id = $2.id AND $1.domain = $2.domain", able)
    found = counts.group("domain", "phase", "family", "code", total="sum(n / (total * 1e0))")
    return found.then("SELECT $1.domain, $1.phase, $1.family, $1.code, $2.series, $1.total / $2.series AS frequency FROM $1 JOIN $2 ON $1.domain = $2.domain", able.group("domain", series="count(*)"))


def surprises(rows: Relation, table: Relation, state: str = "s1") -> Relation:
    """Adds what a law issued one step earlier made of the state: surprise, and of the next one: reversal, stay and entropy."""
    rows = rows.add(state=state).add(before=f"lag(state) OVER ({W})")
    wide = table.group("a", **{f"p{k}": f"max(CASE WHEN b = {k} THEN p END)" for k in range(3)}, entropy="-sum(p * ln(greatest(p, 1e-8)))")
    rows = rows.then("SELECT $1.*, $2.p0, $2.p1, $2.p2, $2.entropy FROM $1 JOIN $2 ON $1.state = $2.a", wide)
    rows = rows.then("SELECT $1.*, $2.p AS issued FROM $1 LEFT JOIN $2 ON $1.before = $2.a AND $1.state = $2.b", table)
    return rows.add(surprise="-ln(greatest(coalesce(issued, 1e0), 1e-8))", reversal="CASE state WHEN 0 THEN p2 WHEN 2 THEN p0 ELSE 0e0 END", stay="CASE state WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END")


def state_products(rows: Relation, state: str, value: str, states: int = 3, scale: float = 3.0) -> Relation:
    """Adds one column a state: the bounded value where the series is in it, else 0; and the columns of the fixed basis."""
    rows = rows.add(bounded=f"tanh({value} / {num(scale)})")
    return rows.add(**{f"in_{k}": f"CASE WHEN {state} = {k} THEN bounded ELSE 0e0 END" for k in range(states)}, base_abs="abs(bounded)", base_rise="greatest(bounded, 0e0)", base_fall="greatest(-bounded, 0e0)", base_square="bounded * bounded")
