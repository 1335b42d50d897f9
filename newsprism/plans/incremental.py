"""Stateful streams as queries, with SQL that replays their rules event by event."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.plans.composite import query
from newsprism.sources import fetch
from newsprism.sources.model import Model
from newsprism.storage import new_path
from newsprism.streaming import leases
from newsprism.streaming import pipeline as streams

_HOURS, _RETRY, _LONGEST = 12, 600, 7200
_ENDS = "('complete', 'skip', 'fail')"


@query(
    "st4_lease_runs",
    f"""WITH RECURSIVE a AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, epoch_us(ts) AS now, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS by_,
        CASE event_type WHEN 'view' THEN 'claim' WHEN 'click' THEN 'heartbeat' WHEN 'signup' THEN 'complete' WHEN 'purchase' THEN 'skip' ELSE 'fail' END AS action FROM {{events}}),
    s(key, k, attempts, w, started, until, retry, lost, lost_w, lost_started, lost_until, done, done_w, done_started, done_at) AS (
      SELECT DISTINCT key, 0::BIGINT, 0, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, NULL::VARCHAR, NULL::VARCHAR, 0::BIGINT, 0::BIGINT FROM a
      UNION ALL SELECT key, k, attempts + claimed::INT, CASE WHEN claimed THEN by_ WHEN ended THEN NULL ELSE w1 END, CASE WHEN claimed THEN now ELSE started END, CASE WHEN claimed OR beat THEN now + {_HOURS * 3600}::BIGINT * 1000000 ELSE until END,
        CASE WHEN NOT ended THEN retry WHEN action = 'fail' THEN now + least({_LONGEST}, {_RETRY} * pow(2, least(attempts - 1, 40)))::BIGINT * 1000000 ELSE 0 END, gone::INT, CASE WHEN gone THEN w END, started, until,
        CASE WHEN ended THEN CASE action WHEN 'complete' THEN 'succeeded' WHEN 'skip' THEN 'skipped' ELSE 'failed' END END, w1, started, now
      FROM (SELECT *, action = 'claim' AND w1 IS NULL AND retry <= now AS claimed, coalesce(w1 = by_, false) AND action = 'heartbeat' AS beat, coalesce(w1 = by_, false) AND action IN {_ENDS} AS ended
        FROM (SELECT a.key, a.k, a.now, a.by_, a.action, s.attempts, s.w, s.started, s.until, s.retry, s.w IS NOT NULL AND s.until <= a.now AS gone, CASE WHEN s.until > a.now THEN s.w END AS w1 FROM s JOIN a ON a.key = s.key AND a.k = s.k + 1))),
    n AS (SELECT *, lag(attempts) OVER (PARTITION BY key ORDER BY k) AS before, max(k) OVER (PARTITION BY key) AS last FROM s)
    SELECT key, before AS attempt, lost_w AS worker, lost_started AS started_us, lost_until AS finished_us, 'lease_lost' AS outcome FROM n WHERE lost = 1
    UNION ALL SELECT key, attempts, done_w, done_started, done_at, done FROM n WHERE done IS NOT NULL
    UNION ALL SELECT key, attempts, w, started, until, 'lease_lost' FROM n WHERE k = last AND w IS NOT NULL AND until <= (SELECT max(now) FROM a) - 3600000000""",
)
def _(m: Model) -> DataFrame:
    """Users' events as claims, heartbeats and endings of two workers: every finished run, also those
    that only a timer ends."""
    events = streams.event_stream(m.spark, m.sf_dir)
    action = F.create_map(*(F.lit(x) for pair in (("view", "claim"), ("click", "heartbeat"), ("signup", "complete"), ("purchase", "skip"), ("error", "fail")) for x in pair))[F.col("event_type")]
    actions = events.select(F.col("user_id").alias("key"), "ts", F.col("event_id").alias("seq"), action.alias("action"), F.when(F.col("event_id") % 2 == 0, "A").otherwise("B").alias("worker"))
    return leases.logged(leases.lease_runs(actions, _HOURS * 3600, _RETRY, _LONGEST, "1 hour"))


# -- feeds from a folder -----------------------------------------------------------------------

#: Longest document that these queries open.
_BOUND = 4000
_PARTS_SQL = """SELECT feed_id, article_id // 100 AS part, sum(28 + octet_length(encode(coalesce(title, '')))) AS bytes FROM {articles} WHERE feed_id IS NOT NULL GROUP BY feed_id, article_id // 100"""


def _folder(m: Model, parts: DataFrame, path: str) -> None:
    parts.select("feed_id", "part", "value").write.mode("append").partitionBy("feed_id", "part").text(path)


def _documents(m: Model) -> DataFrame:
    """Documents of each feed with the titles of 100 ids each, 28 bytes beside each title."""
    item = F.concat(F.lit("<item><title>"), F.coalesce("title", F.lit("")), F.lit("</title></item>"))
    rows = m.articles.where("feed_id is not null").groupBy("feed_id", F.expr("article_id div 100").alias("part"))
    return rows.agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("value"))


@query(
    "src1_unchanged_feeds",
    f"SELECT feed_id, part, CASE WHEN bytes + 1 <= {_BOUND} THEN 'fetched' ELSE 'too_large' END AS outcome, bytes + 1 AS length FROM ({_PARTS_SQL}) WHERE part % 3 = 0",
)
def _(m: Model) -> DataFrame:
    """A second round over a folder of feed documents: those with a known time are not opened nor listed
    again; every third is new.  A document ends with a line feed."""
    path = new_path(m.spark, "feeds")
    documents = _documents(m)
    _folder(m, documents, path)
    none = m.spark.createDataFrame([], "path string, last_modified timestamp")
    first = fetch.folder_feeds(m.spark, path, none, _BOUND)
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part")
    known = first.select("path", "last_modified", part).where("part % 3 <> 0")
    return fetch.folder_feeds(m.spark, path, known, _BOUND).select("feed_id", part, "outcome", "length")


@query("src2_byte_bound", f"SELECT feed_id, part, CASE WHEN bytes + 1 <= {_BOUND} THEN bytes + 1 END AS opened FROM ({_PARTS_SQL})")
def _(m: Model) -> DataFrame:
    """Bytes opened of each document: none beyond the bound."""
    path = new_path(m.spark, "feeds")
    _folder(m, _documents(m), path)
    none = m.spark.createDataFrame([], "path string, last_modified timestamp")
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("bigint").alias("part")
    return fetch.folder_feeds(m.spark, path, none, _BOUND).select("feed_id", part, F.length("content").cast("bigint").alias("opened"))
