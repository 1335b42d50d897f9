"""States of keyed work: what is due, what a gate claims, what a change makes due again.

A state is a row a key: state (pending, claimed, succeeded, skipped, failed), attempts, worker, until_s (end
of a lease, or of the pause after a failure), and the identity of what was processed last.  These
functions read and return rows; :mod:`newsprism.tables` writes them, :mod:`newsprism.streaming.leases`
keeps them as a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.operators import writes

BASE_PAUSE, LONGEST_PAUSE, MOST_ATTEMPTS, LEASE = 60, 3600, 5, 300


def backoff(attempts: Column, base: int = BASE_PAUSE, longest: int = LONGEST_PAUSE) -> Column:
    """Seconds until attempt n may be repeated: base * 2^(n-1) up to `longest`, also for very many attempts."""
    return F.least(F.lit(float(longest)), F.lit(float(base)) * F.pow(F.lit(2.0), F.greatest(attempts, F.lit(1)) - 1)).cast("bigint")


def claimable(now: int, most: int = MOST_ATTEMPTS) -> Column:
    """Pending, or claimed by a lease that ran out, or failed, paused and not tried too often."""
    due, state = F.col("until_s") <= now, F.col("state")
    return F.coalesce((state == "pending") | ((state == "claimed") & due) | ((state == "failed") & due & (F.col("attempts") < most)), F.lit(False))


def claim(states: DataFrame, worker: str, now: int, lease: int = LEASE, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The claimable states as a gate leaves them: claimed by the worker, one attempt more, with a lease."""
    new = {"state": F.lit("claimed"), "worker": F.lit(worker), "attempts": F.col("attempts") + 1, "until_s": F.lit(now + lease).cast("bigint")}
    return states.where(claimable(now, most)).withColumns(new)


def ensured(states: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """States for the wanted keys that have none: pending, never tried."""
    fresh = writes.insert_absent(states, wanted.select(key), [key])
    return fresh.withColumns({"state": F.lit("pending"), "attempts": F.lit(0), "worker": F.lit(None).cast("string"), "until_s": F.lit(None).cast("bigint")})


def leases(states: DataFrame, worker: str, now: int) -> Column:
    """How a worker's lease stands: held, lease_expired, or lease_lost to another."""
    return F.when(~F.col("worker").eqNullSafe(F.lit(worker)), "lease_lost").when(F.coalesce(F.col("until_s") <= now, F.lit(True)), "lease_expired").otherwise("held")


def invalidated(states: DataFrame, inputs: DataFrame, key: str, identity: Sequence[str]) -> DataFrame:
    """States whose processed identity is still their key's input; for others it is gone, so that they are
    due.  Both have the columns of `identity`; a key without an input keeps nothing."""
    now = inputs.select(key, *identity, F.lit(True).alias("_same"))
    rows = states.join(now, [key, *identity], "left")
    return rows.withColumns({c: F.when(F.col("_same"), F.col(c)) for c in identity}).drop("_same").select(*states.columns)


def changed_since(parts: Sequence[tuple[DataFrame, str]], done: DataFrame, key: str, at: str = "done_s") -> DataFrame:
    """Keys of which any part (key, time column) changed after they were processed, or that never were."""
    latest = None
    for rows, when in parts:
        own = rows.select(key, F.col(when).alias("changed_s"))
        latest = own if latest is None else latest.unionByName(own)
    newest = latest.groupBy(key).agg(F.max("changed_s").alias("changed_s"))
    return newest.join(done.select(key, at), key, "left").where(F.col(at).isNull() | (F.col("changed_s") > F.col(at))).select(key)


def unchanged_inputs(before: DataFrame, now: DataFrame, key: str, digest: str = "hash") -> DataFrame:
    """Keys whose inputs still hash to what they did before a run: only their results are stored."""
    return before.select(key, digest).join(now.select(key, digest), [key, digest], "left_semi").select(key)


def renormalized(rows: DataFrame, new: DataFrame, key: str, fields: Sequence[str], derived: Sequence[str]) -> DataFrame:
    """Rows with newly normalized fields; where one differs, what was derived from the old ones is gone."""
    fresh = new.select(key, *(F.col(c).alias(f"_new_{c}") for c in fields), F.lit(True).alias("_has"))
    both = rows.join(fresh, key, "left")
    differs = F.lit(False)
    for c in fields:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"_new_{c}"))
    differs = F.coalesce("_has", F.lit(False)) & differs
    values = {c: F.when(F.col("_has"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in fields} | {c: F.when(~differs, F.col(c)) for c in derived}
    return both.withColumns(values).select(*rows.columns)

