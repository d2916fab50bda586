"""The shared folder, and joins whose keys weigh any number of rows."""

import re

import pytest
from pyspark.sql import functions as F

from tidemark.operators import components as comp
from tidemark.sources import shared


class Cluster:
    """What shared_dir reads of a session on a cluster without a shared folder."""

    master = "spark://host:7077"
    conf = property(lambda self: self)
    sparkContext = property(lambda self: self)

    def get(self, name, default=None):
        return default

    def getCheckpointDir(self):
        return None


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError):
        shared.shared_dir(Cluster())


def test_shared_dir_is_the_sessions(spark):
    assert shared.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir")


@pytest.mark.parametrize("bound", [1, 5, 10_000])
def test_attached_is_a_join(spark, monkeypatch, bound):
    monkeypatch.setattr(comp, "HOT_ROWS", bound)
    many = spark.createDataFrame([(k, i) for k, n in ((1, 40), (2, 3), (3, 1), (4, 7)) for i in range(n)], "k long, i long")
    one = many.filter("k < 4").groupBy("k").agg(F.max("i").alias("top"), F.count("*").alias("n"))
    got = comp.attached(many, one, ["k"], "n", 51)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    assert re.search(r"Exchange hashpartitioning\(k#\d+L?, part#", comp.attached(many, one, ["k"], "n", 51)._jdf.queryExecution().toString())
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got.columns == ["k", "i", "top"] and sorted(map(tuple, got.collect())) == sorted(map(tuple, many.join(one.drop("n"), "k").collect()))


@pytest.mark.parametrize("bound", [1, 256])
def test_components_of_a_hub(spark, monkeypatch, bound):
    monkeypatch.setattr(comp, "HOT_ROWS", bound)
    edges = [(500, i) for i in range(400)] + [(i, i + 1) for i in range(1000, 1040)] + [(7, 7)]
    got = dict(map(tuple, comp.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(400), 500]} | {i: 1000 for i in range(1000, 1041)}


@pytest.mark.parametrize("few", [0, 150, 100_000])
def test_components_in_rounds_and_in_one_task(spark, monkeypatch, few):
    """Rounds alone, rounds and then one task, and one task alone give the same."""
    monkeypatch.setattr(comp, "FEW", few)
    edges = [(i, i + 1) for i in range(-40, 40)] + [(i * 37 % 101 + 1000, i * 53 % 101 + 1000) for i in range(60)] + [(3000, i) for i in range(2000, 2060)] + [(5, 5), (9000, 9000), (3, 1)]
    low = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in low:
        for a, b in edges:
            if a != b:
                low[a] = low[b] = min(low[a], low[b])
    got = comp.components(spark.createDataFrame(edges, "a long, b long").repartition(3)).collect()
    assert sorted(map(tuple, got)) == sorted(low.items())


def test_components_of_few_edges_take_few_jobs(spark):
    """Rounds on a few edges took most of op2's time on a table of 211 partitions."""
    sc = spark.sparkContext
    sc.setJobGroup("few edges", "")
    try:
        assert comp.components(spark.range(300).selectExpr("id a", "id + 1 b")).filter("component = 0").count() == 301
        assert len(sc.statusTracker().getJobIdsForGroup("few edges")) <= 12
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
