"""What the corpus operators share: reading tables, batches of rows and the shared folder."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.sources.shared import checkpointed, shared_dir, staged

__all__ = ["bounded", "checkpointed", "map_rows", "shared_dir", "sliced", "staged", "table", "uncollected"]

#: Rows that a worker's function gets at once. Texts average a few kB; Spark bounds the bytes of a batch that has many long ones.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded(df: DataFrame, rows: int = 10_000) -> DataFrame | None:
    """df marked for broadcast if it has at most so many rows, which is counted; else None. df should be checkpointed."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else None


def sliced(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches cut to up to so many rows each. The session's settings stay as they are."""
    for batch in batches:
        for a in range(0, batch.num_rows, rows):
            yield batch.slice(a, rows)


@contextmanager
def uncollected() -> Iterator[None]:
    """Without the collector of cycles, which passes over every kept key again and again; for work that makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType, rows: int = BATCH_ROWS) -> DataFrame:
    """mapInArrow with per-task state: make() runs once a task and gives the function for its batches, of up to so many rows each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = make()
        yield from map(one, sliced(batches, rows))

    return df.mapInArrow(run, schema)
