"""Leases on keyed work, as a stream with state and timers, and the log of the runs that they bound.

A key is worked on by one worker at a time.  A claim takes a free key for `lease` seconds; a heartbeat
extends the lease; complete, skip and fail end it, a failure with a pause before the next claim.  A
lease that is not extended ends by itself: its run is logged as lost at the moment it ran out, by a
timer, or before the next action of the key if that comes first, and what its worker says later
changes nothing.  Each run is one row of the log, written once.

Time is the event's own (a replay gives the same log) or, with `processing`, the clock's."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from newsprism.storage import new_path

LEASE, RETRY, LONGEST = 300, 60, 3600
ENDINGS = {"complete": "succeeded", "skip": "skipped", "fail": "failed"}
RUN = "attempt int, worker string, started_us bigint, finished_us bigint, outcome string"
STATE = "attempts int, worker string, started_us bigint, until_us bigint, retry_us bigint, seen_us bigint"


@dataclass(frozen=True)
class Lease:
    """What a key's state holds; no worker: free."""

    attempts: int = 0
    worker: str | None = None
    started: int = 0
    until: int = 0
    retry: int = 0
    seen: int = 0

    def run(self, finished: int, outcome: str) -> tuple:
        return self.attempts, self.worker, self.started, finished, outcome

    def expired(self, now: int) -> tuple[Lease, list[tuple]]:
        """Without a lease that ran out by now, and that lease's run."""
        if self.worker is None or self.until > now:
            return self, []
        return replace(self, worker=None), [self.run(self.until, "lease_lost")]

    def act(self, action: str, worker: str, now: int, length: int, pause: int, longest: int) -> tuple[Lease, list[tuple]]:
        """The lease after an action at `now`, and the runs that ended."""
        own, lost = self.expired(now)
        own = replace(own, seen=max(own.seen, now))
        if action == "claim" and own.worker is None and own.retry <= now:
            return replace(own, attempts=own.attempts + 1, worker=worker, started=now, until=now + length), lost
        if own.worker != worker or worker is None:
            return own, lost  # refused: not free, or the lease is another's or lost
        if action == "heartbeat":
            return replace(own, until=now + length), lost
        if action in ENDINGS:
            retry = now + min(longest, pause * 2 ** min(own.attempts - 1, 40)) if action == "fail" else 0
            return replace(own, worker=None, retry=retry), [*lost, own.run(now, ENDINGS[action])]
        return own, lost


class Leases(StatefulProcessor):
    """State and timers of one key."""

    def __init__(self, length: int, pause: int, longest: int, processing: bool, idle_ms: int | None):
        self.length, self.pause, self.longest, self.processing, self.idle = length, pause, longest, processing, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        ttl = {"ttlDurationMs": self.idle} if self.idle and self.processing else {}
        self.state = handle.getValueState("lease", STATE, **ttl)

    def _load(self) -> Lease:
        kept = self.state.get() if self.state.exists() else None
        return Lease(*kept) if kept else Lease()

    def _keep(self, lease: Lease) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if lease.worker is not None:
            self.handle.registerTimer(-(-lease.until // 1000))  # milliseconds, none too early
        self.state.update((lease.attempts, lease.worker, lease.started, lease.until, lease.retry, lease.seen))

    @staticmethod
    def _rows(key: tuple, runs: list[tuple]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in RUN.split(", ")]
        if runs:
            out = pd.DataFrame(runs, columns=names)
            out.insert(0, "key", key[0])
            yield out

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        lease, runs = self._load(), []
        clock = timerValues.getCurrentProcessingTimeInMs() * 1000
        actions = sorted((r for frame in rows for r in frame[["at_us", "seq", "action", "worker"]].itertuples(index=False)), key=lambda r: (r[0], r[1]))
        for at, _, action, worker in actions:
            # an action that comes late can't be undone: it counts as made when its key was last seen
            lease, ended = lease.act(action, worker, clock if self.processing else max(int(at), lease.seen), self.length, self.pause, self.longest)
            runs += ended
        self._keep(lease)
        yield from self._rows(key, runs)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        lease, runs = self._load().expired(expiredTimerInfo.getExpiryTimeInMs() * 1000)
        if runs:
            self._keep(lease)
        yield from self._rows(key, runs)


def lease_runs(actions: DataFrame, lease: int = LEASE, retry: int = RETRY, longest: int = LONGEST, late: str = "1 hour", processing: bool = False, idle: int | None = None) -> DataFrame:
    """The stream of finished runs (key, attempt, worker, started_us, finished_us, outcome).

    actions: a stream of (key bigint, ts timestamp, seq bigint, action, worker); actions of one time
    go by seq.  Lengths are in seconds; by event time, a lease ends by itself once the watermark
    (`late` behind the newest event) passes its end.  By the clock, keys without an action for `idle` seconds
    are forgotten."""
    spark = actions.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    rows = actions.select("key", "ts", F.unix_micros("ts").alias("at_us"), "seq", "action", F.col("worker").cast("string").alias("worker"))
    rows = rows.withWatermark("ts", late)
    processor = Leases(lease * 1_000_000, retry * 1_000_000, longest * 1_000_000, processing, idle * 1000 if idle else None)
    return rows.groupBy("key").transformWithStateInPandas(processor, f"key bigint, {RUN}", "Append", "ProcessingTime" if processing else "EventTime")


def logged(runs: DataFrame, path: str | None = None, checkpoint: str | None = None, **trigger) -> DataFrame:
    """Runs the stream over all that is available (or with another trigger, until it is stopped), and
    gives the log as written so far: a batch that is repeated replaces its own folder."""
    spark = runs.sparkSession
    path, checkpoint = path or new_path(spark, "runs"), checkpoint or new_path(spark, "runs-checkpoint")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = runs.writeStream.outputMode("append").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    if trigger:
        return query
    query.awaitTermination()
    return spark.read.schema(runs.schema).parquet(path).select(*runs.columns)
