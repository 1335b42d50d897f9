"""The folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextvars import ContextVar, Token

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset and the session is local, as in tests, a temporary
    folder that is also set as the session's checkpoint folder."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not where and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if not where:
        where = "file://" + tempfile.mkdtemp(prefix="newsprism-")
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{folder(spark)}/{name}-{uuid.uuid4().hex}"


#: The innermost open Scratch of this thread (or task of an event loop): others don't see it.
_SCRATCH: ContextVar[Scratch | None] = ContextVar("scratch", default=None)


class Scratch:
    """What its own thread stores inside this context, but for tables to keep, is deleted at its end:
    steps of an operator that its result doesn't read."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []
        self._before: Token | None = None

    def __enter__(self) -> Scratch:
        self._before = _SCRATCH.set(self)
        return self

    def __exit__(self, *_: object) -> None:
        _SCRATCH.reset(self._before)
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in self.paths:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths.clear()


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """The rows, written to the shared folder and read back: cuts the lineage, and no executor
    holds the only copy."""
    path = new_path(df.sparkSession, name)
    scratch = _SCRATCH.get()
    if scratch and not keep:
        scratch.paths.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
