"""Whole-series resamples of many series."""

import numpy as np
import pytest

from tidemark.operators import metrics, resamples, statistics
from tidemark.plans import catalog
from tidemark.plans.relation import Relation


def picked(n, replicate):
    """How often a replicate draws each of n series, by the rule of the SQL."""
    if not replicate:
        return [1] * n
    prime, found = 2147483647, [0] * n
    for k in range(n):
        found[(replicate * 48271 + k * 69621 + 12345) % prime * 16807 % prime * 16807 % prime % n] += 1
    return found


def test_draws_of_many_series(spark):
    """The place of a series times a factor is beyond 32 bits from 30,846 series on."""
    n = 40_000
    rows = statistics.draws(Relation.of(spark.range(n)), 2).frame(spark).toPandas().pivot(index="id", columns="replicate", values="weight").fillna(0)
    assert all(np.array_equal(rows[r], picked(n, r)) for r in range(3))


def test_resampled_auc_is_that_of_joined_rows(spark):
    rng = np.random.default_rng(11)
    data = [(i, t, int(i % 3 == 0 and t > 2), round(float(rng.normal()), 1), float(rng.normal())) for i in range(40) for t in range(1, 3 + i % 6)]
    rows = Relation.of(spark.createDataFrame(data, "id long, t long, y int, p double, q double"))
    ids = Relation.of(spark.range(45))  # five of them without a row
    got = resamples.ts_auc(rows, ids, ["p", "q"], 20, spark).toPandas()
    assert len(got) == 2 * 21
    for c in ("p", "q"):
        want = metrics.weighted_ts_auc(rows.keep("id", "t", "y", p=c), statistics.draws(ids, 20)).frame(spark).toPandas().sort_values("replicate")
        own = got[got.name == c].sort_values("replicate")
        assert own[["replicate", "pairs", "ts_auc"]].to_numpy().tolist() == want[["replicate", "pairs", "ts_auc"]].to_numpy().tolist()


@pytest.mark.parametrize("name", ["bootstrap_ts_auc", "bootstrap_summary", "catalog_winners", "joint_envelope"])
def test_no_row_is_copied_for_a_replicate(spark, name):
    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan


def test_sums_of_tables_need_no_row_for_each_draw(spark):
    rng = np.random.default_rng(13)
    n, replicates = 31_000, 130  # numbers beyond 32 bits, and two tasks
    a, b, share = rng.integers(0, 3, n), rng.integers(0, 3, n), rng.random(n).round(3)
    shares = Relation.of(spark.createDataFrame([(i, int(x), int(y), float(z)) for i, (x, y, z) in enumerate(zip(a, b, share, strict=True))], "id long, a int, b int, share double"))
    got = resamples.sums(shares, replicates, spark).toPandas().set_index(["replicate", "a", "b"]).w
    assert len(got) == 131 * 9
    for r in (0, 1, 127, 128, 130):
        weight = np.array(picked(n, r))
        for x in range(3):
            for y in range(3):
                assert got[r, x, y] == pytest.approx((weight * share)[(a == x) & (b == y)].sum())
