"""Incremental runs give what a batch gives, also when repeated."""

from pyspark.sql import functions as F

from newsprism.storage import new_path
from newsprism.streaming import pipeline as S

SF = "/root/testdata/sf0.001"


def test_available_now_is_idempotent(spark):
    path, checkpoint = new_path(spark, "t"), new_path(spark, "t-checkpoint")
    batch = spark.read.parquet(f"{SF}/events.parquet")
    for _ in range(2):
        got = S.run_available(S.event_stream(spark, SF), lambda b: b.select("event_id"), "t", path, checkpoint)
        assert got.count() == batch.count()


def test_sliding_windows(spark):
    batch = spark.read.parquet(f"{SF}/events.parquet").groupBy(F.window("ts", "6 hours", "3 hours")).count()
    got = S.windowed_counts(S.event_stream(spark, SF), "6 hours", "3 hours")
    assert got.agg(F.sum("n")).first()[0] == batch.agg(F.sum("count")).first()[0]


def test_leases(spark):
    events = spark.read.parquet(f"{SF}/events.parquet")
    got = {r.user_id: r for r in S.lease_states(S.event_stream(spark, SF)).collect()}
    for r in events.groupBy("user_id").count().collect():
        assert got[r.user_id].events == r["count"]
