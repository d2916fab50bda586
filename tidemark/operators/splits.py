"""Deterministic splits, samples, weights and duplicate groups of series."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans.relation import Relation, num
from tidemark.sources.shared import checkpointed

SEED, FOLDS, STRATA = 20260710, 5, (0, 10, 25, 50, 100, 200, 400)


def digest(x: str) -> str:
    return f"sha2({x}, 256)"


def hex_sum_mod(x: str, m: int) -> str:
    """A hexadecimal number mod m, for m that divides 15: the sum of its digits, as 16 is 1 mod m."""
    return "(" + " + ".join(f"{d} * (length({x}) - length(replace({x}, '{d:x}', '')))" for d in range(1, 16)) + f") % {m}"


def assigned(ids: Relation, key: str = "id", seed: int = SEED) -> Relation:
    """Adds role (the fifth with the least hash is sealed) and fold (by another hash; -1 for the sealed)."""
    rows = ids.add(h_role=digest(f"concat('{seed}:role:', cast({key} AS string))"), h_fold=digest(f"concat('{seed}:fold:', cast({key} AS string))"))
    fifth = "3" * 64  # floor(2**256 / 5) in hexadecimal
    return rows.add(role=f"CASE WHEN h_role < '{fifth}' THEN 'LOCAL_FINAL_SEAL' ELSE 'DEVELOPMENT_POOL' END").add(fold=f"CASE WHEN h_role < '{fifth}' THEN cast(-1 AS bigint) ELSE cast({hex_sum_mod('h_fold', FOLDS)} AS bigint) END")


def halves(ids: Relation, seed: int = SEED) -> Relation:
    """Adds half: 0 and 1 in turn in the order of a hash."""
    return ids.add(h=digest(f"concat('{seed}:half:', cast(id AS string))")).add(half="cast((row_number() OVER (ORDER BY h, id) - 1) % 2 AS int)")


def _spaced(rows: Relation, low: str, high: str, most: int) -> str:
    """Whether index i is one of at most `most` evenly spaced ones from low to high - 1."""
    n = f"({high} - {low})"
    k = f"least({most}, {n})"
    # i is taken if some j has floor(j * (n - 1) / (k - 1)) = i - low
    j = f"cast(ceil((i - {low}) * ({k} - 1e0) / greatest({n} - 1, 1)) AS bigint)"
    return f"CASE WHEN {n} <= {most} THEN 1 WHEN {j} < {k} AND cast(floor({j} * ({n} - 1e0) / ({k} - 1e0)) AS bigint) = i - {low} THEN 1 ELSE 0 END"


def sampled(rows: Relation) -> Relation:
    """Adds s1 (at most 256 evenly spaced points) and s2 (at most 32 in each stratum of time) to online rows."""
    rows = rows.where("t > 0").add(i="t - 1", n_o="count(*) OVER (PARTITION BY id)")
    cuts = [f"WHEN i < {b} THEN {a}" for a, b in zip(STRATA, STRATA[1:], strict=False)]
    ends = [f"WHEN i < {b} THEN least({b}, n_o)" for b in STRATA[1:]]
    rows = rows.add(low=f"CASE {' '.join(cuts)} ELSE {STRATA[-1]} END", high=f"CASE {' '.join(ends)} ELSE n_o END")
    return rows.add(s1=_spaced(rows, "0", "n_o", 256), s2=_spaced(rows, "low", "high", 32))


def weighted(rows: Relation) -> Relation:
    """Adds w0 .. w3 and s3_sqrt of online rows: none, one over the series' rows, pairs over rows at a time, opposite class at a time; mean 1."""
    rows = rows.where("t > 0").add(pos="sum(y) OVER (PARTITION BY t)", neg="sum(1 - y) OVER (PARTITION BY t)", own="count(*) OVER (PARTITION BY id)")
    rows = rows.add(r1="1e0 / own", r2="pos * neg / greatest(pos + neg, 1e0)", r3="CASE WHEN y = 1 THEN neg ELSE pos END * 1e0")
    rows = rows.add(r4="sqrt(r3)")
    means = rows.group(**{f"m{k}": f"avg(r{k})" for k in (1, 2, 3, 4)})
    return rows.then("SELECT /*+ BROADCAST($2) */ $1.id, $1.t, $1.y, 1e0 AS w0, r1 / m1 AS w1, r2 / nullif(m2, 0e0) AS w2, r3 / nullif(m3, 0e0) AS w3, r4 / nullif(m4, 0e0) AS s3_sqrt FROM $1 CROSS JOIN $2", means)


def every_eighth(rows: Relation, most: int = 128) -> Relation:
    """Every eighth online point, at most `most` a series."""
    return rows.where("t > 0 AND t % 8 = 0").add(k="row_number() OVER (PARTITION BY id ORDER BY t)").where(f"k <= {most}")


def signatures(rows: Relation) -> Relation:
    """For each series: hashes of the exact and of the standardised history and of its first 64 points, rounded so that engines agree on the text."""
    h = rows.where("t <= 0").add(n="t + n_h", mu="avg(value) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(value) OVER (PARTITION BY id), 0e0), 1e-8)")
    h = h.add(exact="cast(cast(round(value * 100e0) AS bigint) AS string)", normal="cast(cast(round((value - mu) / sd * 10000e0) AS bigint) AS string)")
    return h.group("id", n_h="max(n_h)", exact_sha=digest("JOINED(exact, n)"), normal_sha=digest("JOINED(normal, n)"), prefix_sha=digest("JOINED(CASE WHEN n <= 64 THEN exact END, n)"))


def fingerprints(rows: Relation, points: int = 16) -> Relation:
    """One row for each series and grid point: the standardised history, linearly interpolated."""
    h = rows.where("t <= 0").add(n="t + n_h", mu="avg(value) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(value) OVER (PARTITION BY id), 0e0), 1e-8)")
    h = h.add(v="(value - mu) / sd", next="lead((value - mu) / sd) OVER (PARTITION BY id ORDER BY t)")
    grid = h.group("id", n_h="max(n_h)").then(f"SELECT id, n_h, EXPAND(0, {points - 1}) AS g FROM $1").add(spot=f"g * (n_h - 1) / {num(points - 1)}").add(low="cast(floor(spot) AS bigint) + 1")
    return grid.then("SELECT $1.id, $1.n_h, $1.g, $2.v + ($1.spot - floor($1.spot)) * (coalesce($2.next, $2.v) - $2.v) AS v FROM $1 JOIN $2 ON $1.id = $2.id AND $1.low = $2.n", h)


def neighbours(prints: Relation, k: int = 8, slack: int = 3, asked: str = "1 = 1") -> Relation:
    """For each series that is asked for: the k nearest of all series of a length within slack of its own, by root mean square distance of fingerprints, with the largest difference.

    The series asked for go to where the others are, so their pairs are made and added up there.
    """
    pairs = prints.where(asked).then(f"SELECT /*+ BROADCAST(a) */ a.id, b.id AS other, sqrt(avg((a.v - b.v) * (a.v - b.v))) AS rmse, max(abs(a.v - b.v)) AS most FROM $1 AS a JOIN $2 AS b ON a.g = b.g AND a.id <> b.id AND abs(a.n_h - b.n_h) <= {slack} GROUP BY a.id, b.id", prints)
    return pairs.add(place="cast(row_number() OVER (PARTITION BY id ORDER BY rmse, other) AS bigint)").where(f"place <= {k}")


def duplicates(rows: Relation, k: int = 8, rmse: float = 0.01, most: float = 0.1, least: int = 128) -> Relation:
    """Links a, b between duplicates, and of every series with itself: equal signatures, or whole standardised histories that are near.

    One series for each standardised signature is compared with its k nearest ones of the same length, of `least` points at least, by fingerprints.
    These can't differ by more than `most` where histories don't, so no other pair takes a place. Non-finite points must agree.
    """
    marks = signatures(rows).add(normal="min(id) OVER (PARTITION BY n_h, normal_sha)", exact="min(id) OVER (PARTITION BY n_h, exact_sha)")
    prints = fingerprints(rows).then(f"SELECT $1.* FROM $1 JOIN $2 ON $1.id = $2.id WHERE $2.normal = $2.id AND $2.n_h >= {least}", marks)
    pairs = prints.then(f"SELECT a.id, b.id AS other, avg((a.v - b.v) * (a.v - b.v)) AS apart FROM $1 AS a JOIN $1 AS b ON a.n_h = b.n_h AND a.g = b.g AND a.id <> b.id GROUP BY a.id, b.id HAVING max(abs(a.v - b.v)) <= {num(most + 1e-9)}")
    pairs = pairs.add(place="row_number() OVER (PARTITION BY id ORDER BY apart, other)").where(f"place <= {k}")
    pairs = pairs.then("SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM $1")
    h = rows.where("t <= 0").add(mu="avg(value) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(value) OVER (PARTITION BY id), 0e0), 1e-8)").keep("id", "t", v="(value - mu) / sd")
    near = pairs.then("SELECT p.a, p.b, x.v AS x, y.v AS y FROM $1 AS p JOIN $2 AS x ON p.a = x.id JOIN $2 AS y ON p.b = y.id AND x.t = y.t", h)
    near = near.group("a", "b", rmse="sqrt(avg((x - y) * (x - y)))", most="max(abs(x - y))", odd="sum(CASE WHEN (x IS NULL) <> (y IS NULL) THEN 1 ELSE 0 END)")
    near = near.where(f"odd = 0 AND rmse <= {num(rmse)} AND most <= {num(most)}")
    return near.then("SELECT a, b FROM $1 UNION ALL SELECT normal AS a, id AS b FROM $2 UNION ALL SELECT exact AS a, id AS b FROM $2 UNION ALL SELECT id AS a, id AS b FROM $2", marks)


def _described(rows: Relation, points: int = 16) -> Relation:
    """One row for each series, in one pass: n_h, the hashes of its history, and the fingerprint as p0, p1 and so on, as signatures() and fingerprints() have them."""
    h = rows.where("t <= 0").add(n="t + n_h", mu="avg(value) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(value) OVER (PARTITION BY id), 0e0), 1e-8)")
    h = h.add(exact="cast(cast(round(value * 100e0) AS bigint) AS string)", normal="cast(cast(round((value - mu) / sd * 10000e0) AS bigint) AS string)", v="(value - mu) / sd")
    h = h.add(rise="coalesce(lead(v) OVER (PARTITION BY id ORDER BY t), v) - v")
    spot = lambda g: f"({g} * (n_h - 1) / {num(points - 1)})"
    grid = {f"p{g}": f"max(CASE WHEN n = cast(floor({spot(g)}) AS bigint) + 1 THEN v + ({spot(g)} - floor({spot(g)})) * rise END)" for g in range(points)}
    return h.group("id", n_h="max(n_h)", exact_sha=digest("JOINED(exact, n)"), normal_sha=digest("JOINED(normal, n)"), **grid)


def _near_prints(prints: DataFrame, most: float, points: int = 16, places: tuple[int, ...] = (2, 6, 9, 13)) -> DataFrame:
    """id, other (larger) and apart of all pairs of equal length whose fingerprints differ by `most` at no point that both have.

    Cells of four points, four times as wide as `most`, bring them together: one series is in its own cell, the other in each that it is near.
    A series that lacks one of these points may be near any other, and is compared with all of its length.
    """
    lacks = F.lit(False)
    for g in places:
        lacks = lacks | F.col(f"p{g}").isNull()
    prints = prints.withColumn("lacks", lacks)
    cell = lambda x: F.floor(x / (4 * most))
    reach = 1.001 * most  # room for rounding; the pairs are judged below
    own, near = prints, prints
    for g in places:
        x = F.col(f"p{g}")
        own = own.withColumn(f"c{g}", cell(x))
        near = near.withColumn(f"c{g}", F.explode(F.array_distinct(F.array(cell(x - reach), cell(x + reach)))))
    d = [f"(a.p{g} - b.p{g})" for g in range(points)]
    judge = f"greatest({', '.join(f'abs({x})' for x in d)}) <= {num(most)}"
    apart = f"({' + '.join(f'coalesce({x} * {x}, 0e0)' for x in d)}) / ({' + '.join(f'CASE WHEN {x} IS NULL THEN 0e0 ELSE 1e0 END' for x in d)})"
    met = own.alias("a").join(near.alias("b"), F.expr(" AND ".join(["a.n_h = b.n_h", *(f"a.c{g} = b.c{g}" for g in places), "a.id < b.id", judge])))
    rest = prints.filter("lacks").alias("a").join(prints.alias("b"), F.expr(f"a.n_h = b.n_h AND (a.id < b.id OR a.id > b.id AND NOT b.lacks) AND {judge}"))
    pair = [F.expr("least(a.id, b.id) AS id"), F.expr("greatest(a.id, b.id) AS other"), F.expr(apart).alias("apart")]
    return met.select(*pair).unionByName(rest.select(*pair))


def linked(spark: SparkSession, panel: Callable[[Relation | None], Relation], sf_dir: str = "", k: int = 8, rmse: float = 0.01, most: float = 0.1, least: int = 128, told: int = 1_000_000) -> DataFrame:
    """The links of duplicates(), with a row for each series instead of one for each pair and grid point.

    panel gives the rows of all series, or of those in a relation (id): whole histories are read again only of series that are near another by
    fingerprint. Every task gets their ids if there are at most `told`.
    """
    marks = checkpointed(_described(panel(None)).frame(spark, sf_dir))
    marks = checkpointed(Relation.of(marks).add(normal="min(id) OVER (PARTITION BY n_h, normal_sha)", exact="min(id) OVER (PARTITION BY n_h, exact_sha)").frame(spark))
    pairs = Relation.of(_near_prints(marks.filter(f"normal = id AND n_h >= {least}").select("id", "n_h", *(c for c in marks.columns if c[0] == "p")), most + 1e-9))
    pairs = pairs.then("SELECT id, other, apart FROM $1 UNION ALL SELECT other AS id, id AS other, apart FROM $1").add(place="row_number() OVER (PARTITION BY id ORDER BY apart, other)").where(f"place <= {k}")
    pairs = checkpointed(pairs.then("SELECT DISTINCT least(id, other) AS a, greatest(id, other) AS b FROM $1").frame(spark))
    links = Relation.of(marks).then("SELECT normal AS a, id AS b FROM $1 UNION ALL SELECT exact AS a, id AS b FROM $1 UNION ALL SELECT id AS a, id AS b FROM $1").frame(spark)
    if pairs.isEmpty():
        return links
    ids = checkpointed(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    few = panel(Relation.of(F.broadcast(ids) if ids.count() <= told else ids))
    h = few.where("t <= 0").add(mu="avg(value) OVER (PARTITION BY id)", sd="greatest(coalesce(stddev_pop(value) OVER (PARTITION BY id), 0e0), 1e-8)").keep("id", "t", v="(value - mu) / sd")
    near = Relation.of(pairs).then("SELECT p.a, p.b, x.v AS x, y.v AS y FROM $1 AS p JOIN $2 AS x ON p.a = x.id JOIN $2 AS y ON p.b = y.id AND x.t = y.t", h)
    near = near.group("a", "b", rmse="sqrt(avg((x - y) * (x - y)))", most="max(abs(x - y))", odd="sum(CASE WHEN (x IS NULL) <> (y IS NULL) THEN 1 ELSE 0 END)")
    return near.where(f"odd = 0 AND rmse <= {num(rmse)} AND most <= {num(most)}").keep("a", "b").frame(spark, sf_dir).unionByName(links)


def audited(rows: Relation) -> Relation:
    """One row for each series: lengths, break, history statistics, and how far the points before the break depart."""
    rows = rows.add(h="CASE WHEN t <= 0 THEN value END", mu="avg(CASE WHEN t <= 0 THEN value END) OVER (PARTITION BY id)", sd="stddev_pop(CASE WHEN t <= 0 THEN value END) OVER (PARTITION BY id)", med="percentile(CASE WHEN t <= 0 THEN value END, 0.5e0) OVER (PARTITION BY id)")
    rows = rows.add(zh="(h - mu) / greatest(sd, 1e-8)", off="abs(h - med)", before="CASE WHEN t > 0 AND t <= coalesce(tau, 1000000000) THEN value END")
    rows = rows.add(zz="zh * lag(zh) OVER (PARTITION BY id ORDER BY t)")
    rows = rows.group("id", n_h="max(n_h)", n_o="max(cnt - n_h)", tau="max(CASE WHEN tau < cnt - n_h THEN tau END)", mean_h="max(mu)", sd_h="max(sd)", median_h="max(med)", mad_h="percentile(off, 0.5e0)", min_h="min(h)", max_h="max(h)", lag1="avg(zz)", excess="avg(zh * zh * zh * zh) - 3e0", before="avg(before)")
    return rows.add(has_break="CASE WHEN tau IS NULL THEN 0 ELSE 1 END", tau_fraction="tau / (n_o * 1e0)", departure="(before - mean_h) / greatest(sd_h, 1e-8)")
