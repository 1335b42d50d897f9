"""Incremental runs on Structured Streaming.

A stage that polls and leases rows becomes a stream with a checkpoint: each run takes what is new
(trigger availableNow), and a batch that is repeated after a failure overwrites its own folder, so
results hold each row once."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from newsprism.storage import new_path

EVENTS = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def event_stream(spark: SparkSession, sf_dir: str, files: int = 1) -> DataFrame:
    """The events table as a stream of files."""
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet").option("maxFilesPerTrigger", files).parquet(sf_dir)


def run_available(stream: DataFrame, stage: Callable[[DataFrame], DataFrame], name: str, path: str | None = None, checkpoint: str | None = None) -> DataFrame:
    """Runs a batch stage over all that is available; gives the rows written so far.

    Each micro-batch writes to a folder of its number with overwrite: replays change nothing."""
    spark = stream.sparkSession
    path, checkpoint = path or new_path(spark, name), checkpoint or new_path(spark, f"{name}-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        stage(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(path).drop("batch")


def _append(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    spark = stream.sparkSession
    path, checkpoint = new_path(spark, name), new_path(spark, f"{name}-checkpoint")
    if mode == "append":
        query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
        return spark.read.schema(stream.schema).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    query = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def windowed_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 day") -> DataFrame:
    """Events and values a window and type; closed windows, and at the end all, are in the result."""
    window = F.window("ts", length, slide) if slide else F.window("ts", length)
    rows = events.withWatermark("ts", late).groupBy(window.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    flat = rows.select(F.unix_timestamp("w.start").alias("start_s"), "event_type", "n", F.round("total", 4).alias("total"))
    return _append(flat, "windows", "complete")


def sessions(events: DataFrame, gap: str = "2 hours", late: str = "1 day") -> DataFrame:
    rows = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return _append(rows.select("user_id", F.unix_timestamp("w.start").alias("start_s"), F.unix_timestamp("w.end").alias("end_s"), "n"), "sessions", "complete")


def deduplicated(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Each event once, however often it is delivered within the watermark."""
    return _append(events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"]), "deduplicated")


def near_in_time(stream: DataFrame, other: DataFrame, seconds: int) -> DataFrame:
    """Stream-static range join: events of one user within `seconds` of each other, by time bucket."""
    slot = lambda c: F.floor(F.unix_timestamp(c) / seconds)
    a = stream.select("event_id", "user_id", "ts", F.explode(F.array(*(slot("ts") + k for k in (-1, 0, 1)))).alias("slot"))
    b = other.select(F.col("event_id").alias("other_id"), "user_id", F.col("ts").alias("other_ts"), slot("ts").alias("slot"))
    apart = F.abs(F.unix_timestamp("ts") - F.unix_timestamp("other_ts"))
    return _append(a.join(b, ["user_id", "slot"]).where((F.col("event_id") != F.col("other_id")) & (apart <= seconds)).select("event_id", "other_id"), "near")


#: What an outcome does to a state, and the states that a lease goes through.
TRANSITIONS = {"click": "claimed", "view": "claimed", "signup": "succeeded", "purchase": "succeeded", "error": "failed"}


def lease_states(events: DataFrame) -> DataFrame:
    """(user_id, state, attempts, events): claim, success and failure of each key in event order,
    kept in the state store; the newest row of a key is current."""

    def step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        name, attempts, seen = state.get if state.exists else ("pending", 0, 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for kind in rows["event_type"]:
            to = TRANSITIONS.get(kind, name)
            attempts += to == "claimed" and name != "claimed"
            if to == "succeeded" and name != "claimed":
                to = "lease_lost"
            name, seen = to, seen + 1
        state.update((name, attempts, seen))
        yield pd.DataFrame({"user_id": [key[0]], "state": [name], "attempts": [attempts], "events": [seen]})

    out = "user_id bigint, state string, attempts int, events int"
    rows = events.groupBy("user_id").applyInPandasWithState(step, out, "state string, attempts int, events int", "update", GroupStateTimeout.NoTimeout)
    spark = events.sparkSession
    path = new_path(spark, "leases")

    def write(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")

    query = rows.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", new_path(spark, "leases-checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    newest = spark.read.parquet(path).groupBy("user_id").agg(F.max_by(F.struct("state", "attempts", "events"), "batch").alias("s"))
    return newest.select("user_id", "s.*")
