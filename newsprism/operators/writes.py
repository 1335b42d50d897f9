"""What a relational store does with upserts and soft deletes, as pure DataFrame operators.

Nothing is updated in place: an operator returns the rows to append, or each row with the action
that applies to it, and readers take the current generation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def insert_absent(existing: DataFrame, incoming: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of `incoming` whose keys `existing` lacks, one a key (the least row)."""
    order = Window.partitionBy(*keys).orderBy(*[c for c in incoming.columns if c not in keys] or keys)
    first = incoming.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")
    return first.join(existing.select(*keys), list(keys), "left_anti")


def hard_replace(existing: DataFrame, incoming: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """`existing` without the rows of the keys that a new run covered, and what the run found; a covered
    key without new rows loses its old ones."""
    return existing.join(covered.select(key).distinct(), key, "left_anti").unionByName(incoming)


def diff_upsert(existing: DataFrame, incoming: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Every key of either side with its action (insert, update, unchanged, keep) and new fields;
    `changed` lists the fields that differ, null-safe."""
    old = existing.select(*keys, *(F.col(c).alias(f"_old_{c}") for c in fields), F.lit(True).alias("_had"))
    new = incoming.select(*keys, *fields, F.lit(True).alias("_has"))
    both = new.join(old, list(keys), "full")
    differs = [F.when(~F.col(c).eqNullSafe(F.col(f"_old_{c}")), F.lit(c)) for c in fields]
    changed = F.filter(F.array(*differs), lambda x: x.isNotNull())
    action = F.when(F.col("_had").isNull(), "insert").when(F.col("_has").isNull(), "keep").when(F.size("_changed") > 0, "update").otherwise("unchanged")
    values = [F.when(F.col("_has"), F.col(c)).otherwise(F.col(f"_old_{c}")).alias(c) for c in fields]
    both = both.withColumn("_changed", changed).withColumn("action", action)
    listed = F.when(F.col("action") == "update", F.array_join("_changed", ",")).otherwise("")
    return both.select(*keys, *values, "action", listed.alias("changed"))


def match_identity(entries: DataFrame, articles: DataFrame) -> DataFrame:
    """Adds to each entry (entry_id, feed_id, guid, link, derived) the article that it is: by guid,
    else by a link that is one article's only and not guid-typed if the entry has a guid, else by
    its derived key.  articles: (article_id, feed_id, identity_type, identity_key, link)."""
    own = lambda kind: articles.where(F.col("identity_type") == kind)
    guid = own("guid").select("feed_id", F.col("identity_key").alias("guid"), F.col("article_id").alias("by_guid"))
    links = articles.where("link is not null").groupBy("feed_id", "link").agg(F.count("*").alias("n"), F.min("article_id").alias("by_link"), F.min("identity_type").alias("link_type")).where("n = 1").drop("n")
    derived = own("derived").select("feed_id", F.col("identity_key").alias("derived"), F.col("article_id").alias("by_key"))
    found = entries.join(guid, ["feed_id", "guid"], "left").join(links, ["feed_id", "link"], "left").join(derived, ["feed_id", "derived"], "left")
    link_ok = F.col("guid").isNull() | (F.col("link_type") != "guid")
    match = F.coalesce("by_guid", F.when(link_ok, F.col("by_link")), "by_key")
    how = F.when(F.col("by_guid").isNotNull(), "guid").when(link_ok & F.col("by_link").isNotNull(), "link").when(F.col("by_key").isNotNull(), "derived").otherwise("new")
    return found.select("entry_id", "feed_id", match.alias("article_id"), how.alias("matched_by"))


def append_generation(history: DataFrame, new: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """History with a newer generation of the keys in `new`; nothing is removed."""
    last = history.groupBy(key).agg(F.max(generation).alias("_last"))
    rows = new.drop(generation).join(last, key, "left").withColumn(generation, F.coalesce(F.col("_last"), F.lit(0)) + 1).drop("_last")
    return history.unionByName(rows)


def current(history: DataFrame, key: str, generation: str = "generation") -> DataFrame:
    """Rows of each key's newest generation."""
    newest = F.max(generation).over(Window.partitionBy(key))
    return history.withColumn("_newest", newest).where(F.col(generation) == F.col("_newest")).drop("_newest")


def orphans(children: DataFrame, parents: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys of children whose parent is gone: what a cascade retires."""
    return children.select(*keys).distinct().join(parents.select(*keys), list(keys), "left_anti")


def duplicates(rows: DataFrame, *keys: Column) -> DataFrame:
    """Key values that a unique constraint forbids."""
    named = [k.alias(f"key{i}") for i, k in enumerate(keys)]
    return rows.select(*named).groupBy(*(f"key{i}" for i in range(len(keys)))).count().where("count > 1")


def patch(rows: DataFrame, patches: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Applies partial updates: patches carry a struct a field (value, present); absent ones keep."""
    p = patches.select(key, *(F.col(c).alias(f"_p_{c}") for c in fields))
    joined = rows.join(p, key, "left")
    new = {c: F.when(F.col(f"_p_{c}.present"), F.col(f"_p_{c}.value")).otherwise(F.col(c)) for c in fields}
    return joined.withColumns(new).select(*rows.columns)


def plan_reconcile(wanted: DataFrame, running: DataFrame, key: str, fields: Sequence[str], fixed: Sequence[str] = ()) -> DataFrame:
    """Catalog against runtime: create, no_change, update, conflict (a fixed field differs) or
    unmanaged, an action a key."""
    both = diff_upsert(running, wanted, [key], list(fields))
    clash = F.lit(False)
    for c in fixed:
        clash = clash | F.array_contains(F.split("changed", ","), c)
    action = F.when(F.col("action") == "insert", "create").when(F.col("action") == "keep", "unmanaged").when(F.col("action") == "unchanged", "no_change").when(clash, "conflict").otherwise("update")
    return both.select(key, action.alias("action"), "changed")
