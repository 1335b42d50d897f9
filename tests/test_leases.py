"""Leases replayed: the log of a stream in several batches against the rules applied in order."""

import random
import time
from datetime import datetime, timedelta, timezone

from newsprism.storage import new_path
from newsprism.streaming.leases import Lease, lease_runs, logged

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
SCHEMA = "key bigint, ts timestamp, seq bigint, action string, worker string"


def brute(actions, lease, retry, longest, end_us):
    """The log by plain rules: (key, attempt, worker, started, finished, outcome)."""
    out, held, free = [], {}, {}
    us = lambda t: round((t - START).total_seconds() * 1e6)
    counts = {}
    for key, ts, _, action, worker in sorted(actions, key=lambda a: (a[1], a[2])):
        now = us(ts)
        if key in held and held[key][2] <= now:
            w, begun, until = held.pop(key)
            out.append((key, counts[key], w, begun, until, "lease_lost"))
        if action == "claim":
            if key not in held and free.get(key, 0) <= now:
                counts[key] = counts.get(key, 0) + 1
                held[key] = (worker, now, now + lease * 10**6)
        elif key in held and held[key][0] == worker:
            if action == "heartbeat":
                held[key] = (worker, held[key][1], now + lease * 10**6)
            else:
                out.append((key, counts[key], worker, held[key][1], now, {"complete": "succeeded", "skip": "skipped", "fail": "failed"}[action]))
                free[key] = now + min(longest, retry * 2 ** (counts[key] - 1)) * 10**6 if action == "fail" else 0
                del held[key]
    out += [(key, counts[key], w, begun, until, "lease_lost") for key, (w, begun, until) in held.items() if until <= end_us]
    return sorted(out)


def played(n=400, seed=5):
    rng = random.Random(seed)
    at, out = START, []
    for k in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 20, 90]))
        out.append((rng.randrange(6), at, k, rng.choice(["claim", "claim", "heartbeat", "complete", "skip", "fail"]), rng.choice("AB")))
    return out


def stream(spark, actions, parts):
    """A stream of files that come one a batch, in order."""
    folder = new_path(spark, "actions")
    for k in range(parts):
        own = actions[k * len(actions) // parts : (k + 1) * len(actions) // parts]
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.mode("append").parquet(folder)
        time.sleep(0.05)  # files are taken by their time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)


def test_a_replayed_stream_gives_the_log(spark):
    actions = played()
    base = round(START.timestamp() * 1e6)
    end = max(a[1] for a in actions)
    want = brute(actions, 120, 30, 200, round((end - START - timedelta(seconds=60)).total_seconds() * 1e6))
    assert {w[5] for w in want} == {"lease_lost", "succeeded", "skipped", "failed"} and len(want) > 60
    for parts in (1, 4):
        log = logged(lease_runs(stream(spark, actions, parts), 120, 30, 200, "60 seconds"))
        got = sorted((r.key, r.attempt, r.worker, r.started_us - base, r.finished_us - base, r.outcome) for r in log.collect())
        assert got == want


def test_a_lost_lease_is_not_won_back():
    lease, none = Lease().act("claim", "A", 0, 100, 10, 1000)
    assert (lease.worker, lease.until, none) == ("A", 100, [])
    taken, runs = lease.act("claim", "B", 100, 100, 10, 1000)
    assert runs == [(1, "A", 0, 100, "lease_lost")] and (taken.worker, taken.attempts) == ("B", 2)
    for action in ("heartbeat", "complete", "fail"):
        assert taken.act(action, "A", 150, 100, 10, 1000)[0].until == 200
    failed, runs = taken.act("fail", "B", 150, 100, 10, 1000)
    assert runs == [(2, "B", 100, 150, "failed")] and failed.retry == 170
    assert failed.act("claim", "C", 169, 100, 10, 1000)[0].worker is None
    assert failed.act("claim", "C", 170, 100, 10, 1000)[0].worker == "C"


def test_the_clock_ends_a_lease(spark):
    """By processing time nothing but a timer can end the lease: no further action comes."""
    path = new_path(spark, "clock")
    actions = stream(spark, [(1, START, 0, "claim", "A"), (2, START, 1, "claim", "A"), (2, START, 2, "complete", "A")], 1)
    query = logged(lease_runs(actions, lease=2, processing=True, idle=3600), path, processingTime="1 second")
    try:
        found, end = [], time.time() + 60
        while time.time() < end and len(found) < 2:
            time.sleep(1)
            try:
                found = sorted((r.key, r.outcome) for r in spark.read.parquet(path).collect())
            except Exception:  # noqa: BLE001 - no batch is written yet
                found = []
    finally:
        query.stop()
    assert found == [(1, "lease_lost"), (2, "succeeded")]
