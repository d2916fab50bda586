"""Ranks among nearly equal values, which the last bit of a logarithm decides."""

import math

import duckdb
import pytest

from tidemark.plans import catalog
from tidemark.plans.relation import Relation


def test_logarithm_is_that_of_the_c_library(spark):
    xs = [0.01 + i / 97 for i in range(5000)]
    rows = Relation.of(spark.createDataFrame([(x,) for x in [*xs, 0.0, None]], "x double")).add(y="LN(x)")
    assert {r.x: r.y for r in rows.frame(spark).collect()} == {x: math.log(x) for x in xs} | {0.0: None, None: None}
    assert "LN" not in Relation.select("SELECT LN(x) AS y FROM {t}").sql() and Relation.select("SELECT LN(x) AS y FROM {t}").sql() == Relation.select("SELECT ln(x) AS y FROM {t}").sql()


@pytest.mark.parametrize("name", ["block_logmad", "block_confirmation"])
def test_blocks_of_series_without_a_break_are_those_of_the_sql(spark, name):
    """The values of series with a break hold a sum's rounding, which DuckDB's threads change from run to run."""
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    got, want = catalog.queries()[name](spark, sf).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    got, want = (f[f.id.str.len() % 2 == 1].sort_values(["id", "block"]).reset_index(drop=True)[sorted(f.columns)] for f in (got, want))
    assert len(got) > 900 and (got == want).all().all()


@pytest.mark.parametrize("name", ["block_logmad", "block_confirmation", "block_events"])
def test_blocks_of_all_series_are_those_of_the_sql_on_one_thread(spark, name):
    sf = "/root/testdata/sf0.1"
    con = duckdb.connect()
    con.execute("SET threads = 1")
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{sf}/events.parquet')")
    got, want = catalog.queries()[name](spark, sf).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    got, want = (f.sort_values(["id", "block"]).reset_index(drop=True)[sorted(f.columns)] for f in (got, want))
    assert len(got) > 2000 and (got == want).all().all()


def test_deviation_is_added_up_in_the_given_order(spark):
    rows = [("a", t, (t * 7919 % 1000) / 7) for t in range(500)] + [("b", 1, 3.0), ("c", 1, None), ("d", 1, 1.0), ("d", 2, None), ("d", 3, 2.0)]
    frame = Relation.of(spark.createDataFrame(rows[::-1], "id string, t long, x double")).add(d="DEVIATION(x, t) OVER (PARTITION BY id)").frame(spark)
    got = {r.id: r.d for r in frame.collect()}
    con = duckdb.connect()
    con.execute("SET threads = 1")
    want = dict(con.sql("SELECT id, stddev_samp(x ORDER BY t) FROM (VALUES " + ", ".join(f"('{i}', {t}, {'NULL' if x is None else repr(x)}::DOUBLE)" for i, t, x in rows) + ") v(id, t, x) GROUP BY id").fetchall())
    assert got == want and got["b"] is None and got["c"] is None
    assert "stddev_samp(x) OVER" in Relation.select("SELECT DEVIATION(x, t) OVER (PARTITION BY id) AS d FROM {v}").sql()
