"""Connected components of an edge table by alternating star contractions, and joins with keys of any weight."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.sources.shared import checkpointed

#: Rows of a key from which it is hot, at least, and the most keys that are. As a hot key has more than total / HOT_KEYS rows, there can't be more.
HOT_ROWS, HOT_KEYS = 256, 100_000
#: Edges up to which one task finds the components; a round costs about 14 stages, whatever the number of edges.
FEW = 100_000


def attached(many: DataFrame, one: DataFrame, keys: list[str], weight: str, total: int) -> DataFrame:
    """many joined with one, which has a single row for each key, and in weight about how many of the total rows of many have it.

    The rows of hot keys are sent to every task, and rows of many with such a key are dealt by all of their columns; there are at most HOT_KEYS hot
    keys, whatever the total. The other keys are shuffled, and none of them has more than total / HOT_KEYS rows, or HOT_ROWS.
    """
    bound = max(HOT_ROWS, total // HOT_KEYS)
    more = [c for c in one.columns if c not in (*keys, weight)]
    found = F.struct(*more)
    hot = one.filter(F.col(weight) > bound).select(*keys, found.alias("hot_row"))
    # no literal, as the planner would take that for a filter and deal the rows by their keys alone
    cold = one.filter(F.col(weight) <= bound).select(*keys, F.pmod(F.col(weight), F.lit(1)).alias("part"), found.alias("cold_row"))
    part = F.when(F.col("hot_row").isNull(), F.lit(0).cast("long")).otherwise(1 + F.pmod(F.xxhash64(*many.columns), F.lit(1 << 16)))
    met = many.join(F.broadcast(hot), keys, "left").withColumn("part", part).join(cold, [*keys, "part"], "left").withColumn("row", F.coalesce("hot_row", "cold_row"))
    return met.filter("row is not null").select(*many.columns, "row.*")


def _both(edges: DataFrame, *pairs: tuple) -> DataFrame:
    """A row (node, other) for each of the pairs of columns of an edge."""
    return edges.select(F.explode(F.array(*(F.struct(F.col(a).alias("a"), b.alias("b")) for a, b in pairs))).alias("e")).select("e.*")


def _stars(edges: DataFrame) -> bool:
    """Whether the edges (a, b) are stars: no a has several edges, or is a b."""
    ends = _both(edges, ("a", F.lit(1)), ("b", F.lit(0)))
    return ends.groupBy("a").agg(F.sum("b").alias("up"), F.min("b").alias("least")).filter("up > 1 or up = 1 and least = 0").isEmpty()


def _searched(edges: DataFrame) -> DataFrame:
    """components() of at most FEW edges, in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[int, int] = {}

        def root(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        for batch in batches:
            for a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = root(up.setdefault(a, a)), root(up.setdefault(b, b))
                up[max(x, y)] = min(x, y)
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in up], pa.int64())], names=["node", "component"])

    return edges.coalesce(1).mapInArrow(run, "node long, component long")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) of longs -> (node, component): every node of an edge, with the smallest node it can reach.

    Each round hangs the neighbours of a node on the smallest of them, first the larger ones, then the smaller ones, until the edges are stars
    around the smallest nodes. The number of rounds grows with the logarithm of the number of nodes. Minima are combined before they are
    shuffled; the edges of a hot node meet its minimum where they are, see attached(). As soon as at most FEW edges are left, one task does the rest.
    """
    now = checkpointed(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while (total := 2 * now.count()) > 2 * FEW:
        if _stars(now):
            return _both(now, ("a", F.col("b")), ("b", F.col("b"))).distinct().toDF("node", "component")
        both = _both(now, ("a", F.col("b")), ("b", F.col("a")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        large = attached(both, low, ["a"], "n", total).filter("b > a and b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
        small = attached(down, low, ["a"], "n", total).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        now = checkpointed(small.distinct())
    return _searched(now)


def grouped(links: DataFrame) -> DataFrame:
    """links (a, b), with a = b for every node -> (node, component) of all nodes, also of those without another link."""
    links = checkpointed(links)
    found = components(links).withColumnRenamed("node", "a")
    return links.filter("a = b").select("a").distinct().join(found, "a", "left").select(F.col("a").alias("node"), F.coalesce("component", "a").alias("component"))
