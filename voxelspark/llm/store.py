"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import gc
import os
import time
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used only where spark.checkpoint.dir is unset, as in tests.
OWN_DIR = "/tmp/checkpoints/voxelspark"


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, or OWN_DIR where it is unset."""
    return (spark.conf.get("spark.checkpoint.dir", "") or OWN_DIR).rstrip("/")


#: Rows of an Arrow batch: some MB of texts, so that a Python worker beside the JVM stays small.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Let no Arrow batch of this session have more than BATCH_ROWS rows, and let workers find this package.

    On one machine workers start in the driver's folder, which need not be the package's.
    """
    root, env = str(Path(__file__).resolve().parents[2]), spark.sparkContext.environment
    if root not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (root, env.get("PYTHONPATH", "")) if x)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name, "10000")) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


#: Bytes of an Arrow batch, for rows that may be long.
BATCH_BYTES = 1 << 25


def bounded_batches(spark: SparkSession) -> None:
    """small_batches(), and let no batch take another row when it has BATCH_BYTES."""
    small_batches(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back: lineage ends there.

    The table outlives executors; each call gets a folder of its own.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that nothing refers to any more.

    It does so when the driver's garbage is collected, which may be long after a kept table
    has made them useless; on large inputs they are most of the disk in use. References held
    from Python end a moment after Python's, so it takes a second round to reach what they held.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
