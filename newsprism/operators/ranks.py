"""Places in a global order without sending all rows to one task.

Rows are dealt by ranges of the order; a range's rows are counted where they lie, and a row's place
is the number of rows in the ranges before plus its place in its own.  What one task holds is a
range, and what is summed over all ranges is one number each."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.storage import stored

RANGE, PLACE = "_range", "_place"


def ranged(rows: DataFrame, order: Sequence[Column], ranges: int | None = None) -> DataFrame:
    """The rows with the number of their range; stored, since ranges come from a sample that a
    second run may draw anew."""
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return stored(rows.repartitionByRange(n, *order).withColumn(RANGE, F.spark_partition_id()), "ranges")


def running(rows: DataFrame, order: Sequence[Column], value: Column, name: str, ranges: int | None = None) -> DataFrame:
    """The rows with the sum of `value` over the rows before each in the order; rows that tie stand in no
    fixed order, so an order should end with a key."""
    dealt = ranged(rows.withColumn("_value", value), order, ranges)
    sums = dealt.groupBy(RANGE).agg(F.sum("_value").alias("_sum"))
    ahead = Window.orderBy(RANGE).rowsBetween(Window.unboundedPreceding, -1)  # a row a range, whatever the input
    sums = sums.select(RANGE, F.sum("_sum").over(ahead).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy(RANGE).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    both = dealt.withColumn(name, inside).join(F.broadcast(sums), RANGE)
    return both.withColumn(name, F.coalesce(name, F.lit(0)) + F.coalesce("_before", F.lit(0))).drop(RANGE, "_before", "_value")


def numbered(rows: DataFrame, order: Sequence[Column], name: str = PLACE, ranges: int | None = None) -> DataFrame:
    """The rows with their place (from 0) in the order."""
    return running(rows, order, F.lit(1).cast("bigint"), name, ranges)


def first(rows: DataFrame, order: Sequence[Column], limit: int, name: str = "k") -> DataFrame:
    """The first `limit` rows, numbered from 0: each task keeps its own first ones (a sort with limit),
    and only these, `limit` rows in all, are numbered together."""
    few = rows.orderBy(*order).limit(limit)
    return few.withColumn(name, F.row_number().over(Window.orderBy(*order)) - 1)


def ranked_values(rows: DataFrame, key: str, value: str, ranks: Sequence[tuple[str, Column]], ranges: int | None = None) -> DataFrame:
    """(key, n, a column a rank): exact values by rank within each key, for ranks (from 0) given as columns of
    `n`, the key's number of values; nulls take no part.

    Equal values are counted first, then summed over ranges of (key, value): a key may hold any share of
    the rows, and no task holds a key's values together."""
    counts = rows.where(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_key"), F.col(value).alias("_v")).agg(F.count("*").alias("_n"))
    placed = running(counts, [F.col("_key"), F.col("_v")], F.col("_n"), "_at", ranges)
    keys = placed.groupBy("_key").agg(F.sum("_n").alias("n"), F.min("_at").alias("_begin"))
    wanted = keys.select("_key", "n", F.posexplode(F.array(*(c.cast("bigint") for _, c in ranks))).alias("_which", "_rank"), "_begin")
    # a value holds the ranks from its place in the key to the next value's: few values a key are kept
    near = placed.join(wanted, "_key").where((F.col("_at") - F.col("_begin") <= F.col("_rank")) & (F.col("_rank") < F.col("_at") - F.col("_begin") + F.col("_n")))
    picked = [F.max(F.when(F.col("_which") == k, F.col("_v"))).alias(name) for k, (name, _) in enumerate(ranks)]
    return near.groupBy("_key", "n").agg(*picked).withColumnRenamed("_key", key)


def nearest_rank(n: Column, share: float) -> Column:
    """The place (from 0) that a share of n values falls on, halves to the even one."""
    return F.bround((n - 1) * F.lit(share)).cast("bigint")
