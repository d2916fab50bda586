"""The folder that the driver and all executors share, where lineage is cut and intermediate tables are written."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset, a temporary one on a local master, as in tests; an error on a cluster, whose executors don't see each other's folders."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(at)
    return at


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with files in the shared folder, so that a lost executor costs no recomputation. The shuffle files of frames that are out of use by then are let go."""
    spark = df.sparkSession
    shared_dir(spark)
    done = df.checkpoint(eager=True)
    # executors delete a shuffle's files when the driver's collector has found it unreachable; many short jobs would fill their disks before that
    spark.sparkContext._jvm.java.lang.System.gc()
    return done


def staged(df: DataFrame, name: str, fmt: str = "parquet", **options: str) -> tuple[DataFrame, str]:
    """Write df to a new folder under the shared one and read it back; columnar, so smaller than a checkpoint."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    df.write.format(fmt).options(**options).save(path)
    return spark.read.format(fmt).schema(df.schema).load(path), path
