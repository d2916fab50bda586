"""Ranking within time: pair-weighted AUC, its parts, and what builds on it. Scores are p, labels y (0 or 1), time t."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.components import checkpointed
from tidemark.plans.relation import Relation


def ranked(scores: Relation, *by: str) -> Relation:
    """Adds each row's average rank among the rows of its time (and of by)."""
    keys = ", ".join([*by, "t"])
    return scores.add(rank_mid=f"rank() OVER (PARTITION BY {keys} ORDER BY p) + (count(*) OVER (PARTITION BY {keys}, p) - 1) / 2e0")


def auc_by_time(scores: Relation, *by: str) -> Relation:
    """For each time: positives, negatives, pairs, wins (ties count a half) and auc (null without pairs)."""
    rows = ranked(scores, *by).group(*by, "t", pos="sum(y)", n="count(*)", rank_sum="sum(CASE WHEN y = 1 THEN rank_mid ELSE 0e0 END)")
    rows = rows.keep(*by, "t", "rank_sum", "n", pos="cast(pos AS bigint)").keep(*by, "t", "pos", neg="n - pos", wins="CASE WHEN pos > 0 AND pos < n THEN rank_sum - pos * (pos + 1) / 2e0 ELSE 0e0 END")
    return rows.add(pairs="pos * neg").add(auc="CASE WHEN pairs > 0 THEN wins / pairs END")


def ts_auc(scores: Relation, *by: str) -> Relation:
    """Wins over pairs, over all times; a half without pairs."""
    rows = auc_by_time(scores, *by).group(*by, wins="sum(wins)", pairs="sum(pairs)")
    return rows.keep(*by, pairs="cast(pairs AS bigint)", ts_auc="CASE WHEN pairs > 0 THEN wins / pairs ELSE 0.5e0 END")


def pair_credit(scores: Relation) -> Relation:
    """For each positive row: how many negatives of its time it beats, ties a half, and out of how many."""
    rows = scores.add(neg="sum(1 - y) OVER (PARTITION BY t)", below="sum(1 - y) OVER (PARTITION BY t ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)", tied="sum(1 - y) OVER (PARTITION BY t, p)")
    return rows.where("y = 1").keep("id", "t", "neg", credit="below - tied / 2e0")


def weighted_ts_auc(scores: Relation, weights: Relation) -> Relation:
    """For each replicate of weights (replicate, id, weight): the AUC in which a pair counts with the product of its series' weights.

    Rows are joined with the replicates' positive weights by series; within a replicate and time, weighted sums of negatives below and tied replace counts.
    """
    rows = scores.then("SELECT $2.replicate, $1.t, $1.p, $1.y, $2.weight FROM $1 JOIN $2 ON $1.id = $2.id WHERE $2.weight > 0", weights)
    ties = rows.group("replicate", "t", "p", pos="sum(CASE WHEN y = 1 THEN weight ELSE 0 END)", neg="sum(CASE WHEN y = 0 THEN weight ELSE 0 END)")
    ties = ties.add(below="sum(neg) OVER (PARTITION BY replicate, t ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - neg / 2e0")
    times = ties.group("replicate", "t", wins="sum(pos * below)", pairs="sum(pos) * sum(neg)")
    rows = times.group("replicate", wins="sum(wins)", pairs="sum(pairs)")
    return rows.keep("replicate", pairs="cast(pairs AS bigint)", ts_auc="CASE WHEN pairs > 0 THEN wins / pairs ELSE 0.5e0 END")


def auc_by_time_spread(scores: DataFrame) -> DataFrame:
    """auc_by_time for panels with so many series that a single time is too much for a task.

    Equal scores of a time are added up first. Ranges of (t, p) are then dealt to tasks, so a time can span several; a task counts the negatives below within
    its own range, and the table of ranges, one row for each task and time, gives what lies in the ranges before.
    """
    ties = scores.groupBy("t", "p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    ties = checkpointed(ties.repartitionByRange("t", "p").withColumn("part", F.spark_partition_id()))
    ranges = ties.groupBy("t", "part").agg(F.sum("neg").alias("n"))
    ranges = ranges.select("t", "part", (F.sum("n").over(Window.partitionBy("t").orderBy("part")) - F.col("n")).alias("before"))
    own = F.sum("neg").over(Window.partitionBy("t", "part").orderBy("p")) - F.col("neg") / 2
    parts = ties.withColumn("own", own).groupBy("t", "part").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("pos") * F.col("own")).alias("wins"))
    rows = parts.join(ranges, ["t", "part"]).groupBy("t").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), F.sum(F.col("wins") + F.col("pos") * F.col("before")).alias("wins"))
    pairs = F.col("pos") * F.col("neg")
    return rows.select("t", "pos", "neg", pairs.alias("pairs"), F.when(pairs > 0, F.col("wins")).otherwise(0.0).alias("wins"), F.when(pairs > 0, F.col("wins") / pairs).alias("auc"))
