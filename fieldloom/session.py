"""Session settings the operators rely on, and the durable folder they cut lineage into."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results; safe to set on a running session.
RESULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    # the size of a null is null, and bad casts are errors
    "spark.sql.ansi.enabled": "true",
    "spark.sql.legacy.sizeOfNull": "false",
    # a JSON object that repeats a key keeps the last value
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed.
SPEED_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # checkpoints go when nothing refers to them any more
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    # no Python call site recorded for every column expression
    "spark.python.sql.dataFrameDebugging.enabled": "false",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings results depend on to a session made elsewhere."""
    for key, value in RESULT_CONF.items():
        spark.conf.set(key, value)
    return spark


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A single-machine session for tests and the benchmark."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fieldloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
    )
    for key, value in {**RESULT_CONF, **SPEED_CONF}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def durable_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints, state tables and stream sinks.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session, where
    every task sees the same disk, gets a folder of its own when none is named.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        folder = sc.getCheckpointDir()
    if folder is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder under the durable one."""
    return os.path.join(durable_dir(spark), f"{label}-{uuid.uuid4().hex}")


def durable(df: DataFrame) -> DataFrame:
    """Materialise df reliably, so that every later use sees the same rows."""
    durable_dir(df.sparkSession)
    return df.checkpoint(eager=True)
