"""One answer for each point: the running statistics of the base bank as a keyed stream.

The stream's state for a series is five numbers, whatever its length. References come from the clean history, which is a static table joined to the stream. Points of
a series must come in order of t; one that doesn't follow its predecessor is answered with a null score and leaves the state as it is.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.sources.shared import shared_dir

DRIFT, CLIP, ALPHA = 0.25, 20.0, 0.05
OUTPUT = "id {id}, t long, z double, cusum_positive double, cusum_negative double, running_mean double, ewma double, late boolean"
STATE = "t long, up double, down double, mean double, ewma double"


def advance(state: tuple, z: float) -> tuple:
    """The state after one standardised point."""
    t, up, down, mean, ewma = state
    t += 1
    return t, max(0.0, up + z - DRIFT), max(0.0, down - z - DRIFT), mean + (z - mean) / t, ewma + ALPHA * (z - ewma)


def _update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0)
    points = pd.concat(list(batches)).sort_values("t")
    out = []
    for t, value, mean, sd in zip(points["t"], points["value"], points["mean_h"], points["sd_h"], strict=True):
        if t != now[0] + 1:
            out.append((key[0], t, None, None, None, None, None, True))
            continue
        z = min(max((value - mean) / sd, -CLIP), CLIP) if np.isfinite(value) else 0.0
        now = advance(now, z)
        out.append((key[0], t, z, float(np.log1p(now[1])), float(np.log1p(now[2])), now[3], now[4], False))
    state.update(tuple(now))
    yield pd.DataFrame(out, columns=["id", "t", "z", "cusum_positive", "cusum_negative", "running_mean", "ewma", "late"])


def scored(points: DataFrame, references: DataFrame) -> DataFrame:
    """points (a stream of id, t, value) and references (id, mean_h, sd_h) -> one row for each point."""
    kind = dict(points.dtypes)["id"]
    joined = points.join(references.select("id", "mean_h", "sd_h"), "id")
    return joined.groupBy("id").applyInPandasWithState(_update, OUTPUT.format(id=kind), STATE, "append", GroupStateTimeout.NoTimeout)


def drained(spark: SparkSession, stream: DataFrame, name: str = "scores") -> DataFrame:
    """All rows of a stream over what is there now, through files in the shared folder."""
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


def replayed(spark: SparkSession, rows: DataFrame, files: int = 4) -> DataFrame:
    """A stream of a panel's rows (id, t, value), in as many micro-batches, in order of t."""
    path = f"{shared_dir(spark)}/tidemark-points-{uuid.uuid4().hex}"
    rows = rows.select("id", F.col("t").cast("long").alias("t"), F.col("value").cast("double").alias("value"))
    cuts = rows.approxQuantile("t", [i / files for i in range(1, files)], 0.01) if files > 1 else []
    low = 0.0
    for high in [*cuts, float("inf")]:
        rows.filter((F.col("t") > low) & (F.col("t") <= high)).coalesce(1).write.mode("append").parquet(path)
        low = high
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)
