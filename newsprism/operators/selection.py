"""Bounded picks from ranked rows: lanes with quotas, waves, rotating cohorts, threshold sweeps.

A pick is a limit by definition: each task keeps its own first rows, and only these meet to be
numbered.  A cohort needs a place among all rows, which is counted by ranges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.operators.ranks import first, numbered

#: Part of a wave or pick that the newest rows get, in tenths.
LIVE_TENTHS = 8
STRIDE = 997


def two_lanes(hinted: DataFrame, recall: DataFrame, order: Sequence[Column], limit: int, offset: int = 0) -> DataFrame:
    """`limit` rows, the larger half from `hinted`; a lane that can't fill its half leaves the rest to
    the other.  Adds lane and place."""
    slots = (limit + 1) // 2, limit // 2
    begin = (offset + 1) // 2, offset // 2
    lanes = [first(rows, order, b + limit).where(F.col("k") >= b).withColumn("k", F.col("k") - b).withColumn("lane", F.lit(n)) for rows, b, n in ((hinted, begin[0], "hint"), (recall, begin[1], "recall"))]
    both = lanes[0].unionByName(lanes[1])
    have = both.agg(*(F.count(F.when(F.col("lane") == n, 1)).alias(n) for n in ("hint", "recall")))
    quota = F.when(F.col("lane") == "hint", F.greatest(F.lit(slots[0]), F.lit(limit) - F.col("recall"))).otherwise(F.greatest(F.lit(slots[1]), F.lit(limit) - F.col("hint")))
    picked = both.crossJoin(F.broadcast(have)).where(F.col("k") < quota).drop("hint", "recall")  # one row
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("lane", "k"))
    return picked.withColumn("place", place).drop("k")


def waves(live: DataFrame, stale: DataFrame, order: Sequence[Column], wave: int, limit: int) -> DataFrame:
    """The first `limit` rows of both lanes in waves: each takes its share of live rows, then stale
    ones; where a lane runs out the other fills.  Adds lane and place."""
    full, last = divmod(limit, wave)
    share = lambda n: min(n, max(1, n * LIVE_TENTHS // 10))
    quota = {"live": share(wave), "stale": wave - share(wave)}
    tail = {"live": share(last) if last else 0, "stale": last - share(last) if last else 0}
    lanes = []
    for rows, name in ((live, "live"), (stale, "stale")):
        q = quota[name]
        k = F.col("k")
        at = F.floor(k / q) if q else F.lit(limit)
        within = k % q if q else k
        # of the last, smaller wave the lanes' own shares go first
        over = F.when((at == full) & (within >= tail[name]), 1).otherwise(0)
        lanes.append(first(rows, order, limit).withColumn("lane", F.lit(name)).withColumns({"wave": at.cast("long"), "over": over}))
    both = lanes[0].unionByName(lanes[1])
    place = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("wave", "over", "lane", "k"))
    return both.withColumn("place", place).where(F.col("place") <= limit).drop("k", "wave", "over")


def newest_and_oldest(rows: DataFrame, order: Sequence[Column], reverse: Sequence[Column], limit: int) -> DataFrame:
    """All rows if at most `limit`, else the newest 80 % of it and the rest from the oldest; adds place."""
    live = max(1, limit * LIVE_TENTHS // 10)
    total = rows.agg(F.count("*").alias("total"))
    newest, oldest = first(rows, order, limit), first(rows, reverse, limit - live, "back")
    live_part = newest.crossJoin(F.broadcast(total)).where((F.col("k") < live) | (F.col("total") <= limit)).drop("total")
    rest = oldest.crossJoin(F.broadcast(total)).where(F.col("total") > limit).withColumn("k", F.col("back") + live).drop("back", "total")
    return live_part.unionByName(rest).withColumn("place", F.col("k") + 1).drop("k")


def cohort(rows: DataFrame, order: Sequence[Column], newest: int, rotating: int, slot: int) -> DataFrame:
    """The `newest` first rows and `rotating` of the older, from a place that a prime stride moves on
    each slot; adds place."""
    placed = numbered(rows, order, "k")
    older = F.greatest(F.lit(0), F.lit(rows.count() - newest))
    start = F.when(older > 0, F.pmod(F.lit(slot * STRIDE), F.greatest(older, F.lit(1)))).otherwise(0)
    turn = F.pmod(F.col("k") - newest - start, F.greatest(older, F.lit(1)))
    kept = placed.where((F.col("k") < newest) | (turn < rotating))
    return kept.withColumn("place", F.when(F.col("k") < newest, F.col("k")).otherwise(turn + newest) + 1).drop("k")


def threshold_sweep(scored: DataFrame, cuts: Sequence[float]) -> DataFrame:
    """scored: (score, truth boolean).  A row a cut: tp, fp, fn, tn, precision (1 if nothing is
    found) and recall (0 if nothing is true).  One pass, whatever the number of cuts."""
    rows = scored.withColumn("cut", F.explode(F.array(*map(F.lit, cuts))))
    up = F.col("score") >= F.col("cut")
    counts = rows.groupBy("cut").agg(*(F.count(F.when(c, 1)).alias(n) for n, c in (("tp", up & F.col("truth")), ("fp", up & ~F.col("truth")), ("fn", ~up & F.col("truth")), ("tn", ~up & ~F.col("truth")))))
    precision = F.when(F.col("tp") + F.col("fp") > 0, F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(1.0)
    recall = F.when(F.col("tp") + F.col("fn") > 0, F.col("tp") / (F.col("tp") + F.col("fn"))).otherwise(0.0)
    return counts.withColumns({"precision": precision, "recall": recall})


#: Words of the hint, fixed values.
HINT_NEGATIONS = ("no", "not", "never", "without", "neither", "nor", "nicht", "kein", "keine", "keinen", "keinem", "keiner", "nie", "niemals", "ne", "pas", "jamais", "non")
HINT_DISPUTES = ("deny", "denies", "denied", "dispute", "disputes", "disputed", "reject", "rejects", "rejected", "refute", "refutes", "refuted", "bestreitet", "widerspricht", "dementiert", "zurueckweist")


def hint_features(text: Column) -> tuple[Column, Column, Column]:
    """Negated, numbers (sorted, distinct), disputing: what a conflict hint compares."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    numbers = F.array_sort(F.array_distinct(F.regexp_extract_all(low, F.lit(r"[0-9]+(?:[.,][0-9]+)?"), F.lit(0))))
    has = lambda listed: F.arrays_overlap(words, F.array(*map(F.lit, listed)))
    return has(HINT_NEGATIONS), numbers, has(HINT_DISPUTES)


def conflict_hint(left: str, right: str) -> Column:
    """3 if one side is negated, 2 if both have numbers and these differ, 1 for a disputing word; of
    columns {left}_negated, {left}_numbers and {left}_disputes, and the same of the right."""
    x, y = F.col(f"{left}_numbers"), F.col(f"{right}_numbers")
    differ = (F.size(x) > 0) & (F.size(y) > 0) & (x != y)
    return F.when(F.col(f"{left}_negated") != F.col(f"{right}_negated"), 3).otherwise(0) + F.when(differ, 2).otherwise(0) + F.when(F.col(f"{left}_disputes") | F.col(f"{right}_disputes"), 1).otherwise(0)


def conflict_rich(pairs: DataFrame, stories: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Stories whose candidate pairs promise conflicts.  pairs: (story_id, hint, claim_score, score);
    stories: (story_id, recency), 0 the newest.  A story with a hinted pair ranks by its best pair,
    then the numbers of hinted and of all pairs, then recency; the others stand in the recall lane."""
    best = F.max(F.struct("hint", "claim_score", "score")).alias("best")
    one = pairs.groupBy("story_id").agg(best, F.count(F.when(F.col("hint") > 0, 1)).alias("hinted"), F.count("*").alias("pairs")).join(stories, "story_id")
    order = [F.desc("best"), F.desc("hinted"), F.desc("pairs"), F.col("recency")]
    return two_lanes(one.where("best.hint > 0"), one.where("best.hint = 0"), order, limit, offset).select("story_id", "lane", "place")
