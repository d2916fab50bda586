"""Sinks and sources of intermediate tables: caches by fold, ledgers, manifests and checks of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_cache(rows: DataFrame, path: str, contract: str, fold: str = "fold") -> None:
    """Feature rows by fold, written once, with the hash of what made them."""
    rows.withColumn("contract", F.lit(contract)).write.mode("errorifexists").partitionBy(fold).parquet(path)


def read_fold(spark: SparkSession, path: str, folds: list[int], contract: str, fold: str = "fold") -> DataFrame:
    """The rows of some folds (only their files are read); an error if something else made them."""
    rows = spark.read.parquet(path).filter(F.col(fold).isin(folds))
    stale = rows.filter(F.col("contract") != contract).limit(1).count()
    if stale:
        raise ValueError("the cache was made by another configuration")
    return rows.drop("contract")


def append_ledger(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Name, bytes and sha256 of each file."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """An inner join; an error if a side repeats a key or has keys that the other lacks."""
    for side in (left, right):
        if side.groupBy(*keys).count().filter("count > 1").limit(1).count():
            raise ValueError("a key is repeated")
    if left.select(*keys).join(right.select(*keys), keys, "left_anti").limit(1).count() or right.select(*keys).join(left.select(*keys), keys, "left_anti").limit(1).count():
        raise ValueError("the sides have different keys")
    return left.join(right, keys)


def admitted(rows: DataFrame, allowed: DataFrame, key: str = "id") -> DataFrame:
    """rows, if all of their keys are among the allowed ones."""
    if rows.select(key).join(allowed.select(key), key, "left_anti").limit(1).count():
        raise ValueError("rows are outside the scope")
    return rows


def unit_interval(p: Column) -> Column:
    """p, or an error where it isn't a probability."""
    return F.when((p >= 0) & (p <= 1), p).otherwise(F.raise_error(F.lit("a score is outside [0, 1]")))
