"""Session helpers."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


#: Rows of an Arrow batch: with long texts Spark's 10,000 would be tens of MB on both sides.
BATCH_ROWS = 2000
#: Workers give memory of large arrays back at once, so that it isn't held beside the JVM's heap.
WORKER_ENV = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": "1048576", "MALLOC_ARENA_MAX": "2"}


def importable(spark: SparkSession) -> SparkSession:
    """Prepares Python workers: they can import this package where they see the same folder (local
    mode, a shared file system; elsewhere ship it with --py-files), get batches of BATCH_ROWS rows
    unless the session says otherwise, and keep little memory."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
    for key, value in WORKER_ENV.items():
        env.setdefault(key, value)
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def local_session(cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the bench use."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("newsprism")
    defaults = {
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.driver.memory": "6g",
        "spark.ui.showConsoleProgress": "false",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return importable(builder.getOrCreate())
