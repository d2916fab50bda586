"""Panels of series: id, t (1 at the first online point, 0 and less in the history), value, tau and y.

A panel is read from any table with a series key, a total order and a value. The first floor(HISTORY * n) rows of a series are its clean history.
Where a table has no labels, breaks are put in by rule: a series has one if its number is even, tau is its online step, and the values after it move up
by SHIFT standard deviations of the history.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame

from tidemark.plans.relation import Relation, num

#: History in tenths of a series.
HISTORY, SHIFT = 6, 0.5


@dataclass(frozen=True)
class Spec:
    """Where a panel's columns come from."""

    table: str
    key: str
    order: tuple[str, ...]
    value: str
    number: str  # an integer that decides on breaks
    ranked: bool = False  # whether nearly equal values are ranked, so that the last bit of a break's height counts


LINEITEM = Spec("lineitem", "l_suppkey", ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"), "l_extendedprice", "l_suppkey")
USERS = Spec("events", "user_id", ("ts", "event_id"), "value", "user_id")
TYPES = Spec("events", "event_type", ("ts", "event_id"), "value", "length(event_type)")
RANKED_TYPES = replace(TYPES, ranked=True)
ORDERS = Spec("orders", "o_custkey", ("o_orderdate", "o_orderkey"), "o_totalprice", "o_custkey")

#: Non-finite values, which arithmetic on windows must not meet.
FINITE = "({x} IS NOT NULL AND NOT isnan({x}) AND abs({x}) < 1e300)"


def finite(x: str) -> str:
    return FINITE.format(x=x)


def numbered(spec: Spec, among: Relation | None = None) -> Relation:
    """id, number, n (place in the series from 1), cnt and raw; of the series in among (id) alone, if it is given."""
    # the key is named first, so that every later window finds the rows partitioned by it
    rows = Relation.select(f"SELECT {spec.key} AS id, cast({spec.number} AS bigint) AS number, cast({spec.value} AS double) AS raw, {', '.join(spec.order)} FROM {{{spec.table}}}")
    if among is not None:
        rows = rows.then("SELECT $1.* FROM $1 LEFT SEMI JOIN $2 ON $1.id = $2.id", among)
    rows = rows.add(n=f"row_number() OVER (PARTITION BY id ORDER BY {', '.join(spec.order)})", cnt="count(*) OVER (PARTITION BY id)")
    return rows.keep("id", "number", "raw", "n", "cnt")


def panel(spec: Spec = LINEITEM, shift: float = SHIFT, among: Relation | None = None) -> Relation:
    """id, t, cnt, n_h, value, tau (null without a break) and y (1 from the break on); of the series in among (id) alone, if it is given."""
    rows = numbered(spec, among).add(n_h=f"cast(floor(cnt * {HISTORY} / 10e0) AS bigint)").where("n_h > 0")
    return timed(rows.keep("id", "number", "cnt", "n_h", "raw", t="n - n_h"), shift, spec.ranked)


def timed(rows: Relation, shift: float, ranked: bool = False) -> Relation:
    history = "CASE WHEN t <= 0 THEN raw END"
    deviation = f"DEVIATION({history}, t)" if ranked else f"stddev_samp({history})"
    rows = rows.add(tau="CASE WHEN number % 2 = 0 THEN 20 + (number * 7) % 100 END", sd_raw=f"{deviation} OVER (PARTITION BY id)")
    return rows.keep("id", "t", "cnt", "n_h", "tau", value=f"raw + CASE WHEN t > tau THEN {num(shift)} * coalesce(sd_raw, 0e0) ELSE 0e0 END", y="CASE WHEN t > coalesce(tau, 1000000000) THEN 1 ELSE 0 END")


def of_frame(df: DataFrame, id_col: str = "id", time_col: str = "time", value_col: str = "value", period_col: str = "period", labels: DataFrame | None = None, tau_col: str = "tau") -> Relation:
    """A panel of a frame with a period column: 1 history, 2 online. labels (id, tau): the online step of the break from 0, null or -1 without one."""
    rows = Relation.of(df.select(df[id_col].alias("id"), df[time_col].alias("at"), df[period_col].cast("int").alias("period"), df[value_col].cast("double").alias("value")))
    rows = rows.add(n="row_number() OVER (PARTITION BY id ORDER BY at)", cnt="count(*) OVER (PARTITION BY id)", n_h="sum(CASE WHEN period = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY id)")
    if labels is None:
        return rows.keep("id", "cnt", "n_h", "value", t="n - n_h", tau="cast(NULL AS bigint)", y="0")
    taus = Relation.of(labels.select(labels[id_col].alias("id"), labels[tau_col].cast("long").alias("tau"))).keep("id", tau="CASE WHEN tau >= 0 THEN tau END")
    return rows.then("SELECT $1.id, n - n_h AS t, cnt, n_h, tau, value, CASE WHEN n - n_h > coalesce(tau, 1000000000) THEN 1 ELSE 0 END AS y FROM $1 LEFT JOIN $2 ON $1.id = $2.id", taus)


def disorder(df: DataFrame, id_col: str = "id", time_col: str = "time", period_col: str = "period") -> Relation:
    """Rows that break the two-segment contract: time that doesn't rise within an id, a period that falls, or one that isn't 1 or 2."""
    rows = Relation.of(df.select(df[id_col].alias("id"), df[time_col].alias("at"), df[period_col].alias("period")))
    rows = rows.add(seen="count(*) OVER (PARTITION BY id, at)", before="lag(period) OVER (PARTITION BY id ORDER BY at)")
    return rows.where("seen > 1 OR period < before OR period NOT IN (1, 2) OR period IS NULL OR at IS NULL")


def sanitised(rows: Relation) -> Relation:
    """Non-finite history becomes the finite median of the history, a non-finite online value its mean; both are bounded by 1e100. missing marks them."""
    rows = rows.add(ok=f"CASE WHEN {finite('value')} THEN greatest(-1e100, least(1e100, value)) END")
    rows = rows.add(med_h="coalesce(percentile(CASE WHEN t <= 0 THEN ok END, 0.5e0) OVER (PARTITION BY id), 0e0)")
    rows = rows.add(filled="CASE WHEN t <= 0 THEN coalesce(ok, med_h) END", missing="CASE WHEN ok IS NULL THEN 1 ELSE 0 END")
    return rows.add(x="CASE WHEN t <= 0 THEN filled ELSE coalesce(ok, avg(filled) OVER (PARTITION BY id), 0e0) END")
