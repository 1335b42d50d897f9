"""Graph operators: components of keyed edge sets, and provenance followed to its roots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.storage import stored


def components(edges: DataFrame, keys: Sequence[str] = (), left: str = "x", right: str = "y") -> DataFrame:
    """(keys, node, label): the least node that each node reaches, within each key.

    Labels move over edges and jump to their own label's label, so rounds grow with the logarithm of
    a path.  Each round is written to the shared folder: lost executors repeat one round only."""
    keys = list(keys)
    both = edges.select(*keys, F.col(left).alias("x"), F.col(right).alias("y"))
    both = stored(both.union(both.select(*keys, F.col("y"), F.col("x"))).where("x <> y").distinct(), "edges")
    at = stored(both.groupBy(*keys, F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")), "labels")
    while True:
        seen = both.join(at.withColumnsRenamed({"node": "y"}), [*keys, "y"]).groupBy(*keys, F.col("x").alias("node")).agg(F.min("label").alias("near"))
        best = stored(at.join(seen, [*keys, "node"]).select(*keys, "node", F.least("label", "near").alias("best"), F.col("label").alias("old")), "labels")
        jump = best.select(*keys, F.col("node").alias("best"), F.col("best").alias("next"))
        at = stored(best.join(jump, [*keys, "best"], "left").select(*keys, "node", F.coalesce("next", "best").alias("label"), "old"), "labels")
        if at.where("label <> old").isEmpty():
            return at.select(*keys, "node", "label")
        at = at.select(*keys, "node", "label")


def around(edges: DataFrame, seeds: DataFrame, left: str = "x", right: str = "y") -> DataFrame:
    """The edges that lead from a seed (node), over any number of others and in any direction."""
    found = components(edges.select(left, right), left=left, right=right)
    near = found.join(seeds.select("node").distinct(), "node", "left_semi").select("label").distinct()
    inside = found.join(near, "label", "left_semi").select(F.col("node").alias(left))
    return edges.join(inside, left, "left_semi")


#: Relation kinds that make two sources one voice.
COLLAPSING = ("editorial_parent", "shared_newsroom", "joint_editorial_operation")


#: Days of a bin of an interval join.
BIN_DAYS = 31


def during(dates: DataFrame, intervals: DataFrame, at: str = "at", begin: str = "valid_from", end: str = "valid_to", days: int = BIN_DAYS) -> DataFrame:
    """Dates with the intervals that hold then, ends included, null ends open: an equi-join on bins of
    days.  An interval is in each bin that it touches between the least and the greatest date; the
    row of bounds is one."""
    number = lambda c: F.floor(F.unix_date(c) / days)
    reach = dates.agg(F.min(at).alias("_least"), F.max(at).alias("_most"))
    near = intervals.crossJoin(F.broadcast(reach))  # one row
    first, last = F.greatest(F.coalesce(begin, "_least"), F.col("_least")), F.least(F.coalesce(end, "_most"), F.col("_most"))
    near = near.where(first <= last).withColumn("_bin", F.explode(F.sequence(number(first), number(last)))).drop("_least", "_most")
    holds = (F.coalesce(begin, at) <= F.col(at)) & (F.coalesce(end, at) >= F.col(at))
    return dates.withColumn("_bin", number(F.col(at))).join(near, "_bin").where(holds).drop("_bin")


def source_keys(wanted: DataFrame, relations: DataFrame) -> DataFrame:
    """(source_id, at, key): the least source of the component at that date.  wanted: (source_id,
    at); relations: (source_id, related_source_id, valid_from, valid_to), collapsing kinds only.
    A null date sees undated relations only."""
    r = relations.select(F.col("source_id").cast("string").alias("x"), F.col("related_source_id").cast("string").alias("y"), "valid_from", "valid_to")
    dates = wanted.select("at").distinct()
    held = during(dates.where("at is not null"), r).select(F.col("at").cast("string").alias("on"), "x", "y")
    always = dates.where("at is null").limit(1).select(F.lit("-").alias("on")).join(r.where("valid_from is null and valid_to is null").withColumn("on", F.lit("-")), "on")
    dated = held.union(always.select("on", "x", "y"))
    found = components(dated, ["on"])
    asked = wanted.select("source_id", "at").distinct().withColumn("on", F.coalesce(F.col("at").cast("string"), F.lit("-"))).withColumn("node", F.col("source_id").cast("string"))
    return asked.join(found, ["on", "node"], "left").select("source_id", "at", F.coalesce("label", "node").alias("key"))


def provenance_roots(articles: DataFrame, provenance: DataFrame) -> DataFrame:
    """(article_id, source_id): the sources that each article depends on, following verified
    provenance upstream.  articles: (article_id, source_id); provenance: (article_id,
    upstream_source_id, upstream_article_id, co_produced).  A trail breaks
    cycles, so the rounds end with the longest chain."""
    up = provenance.select(F.col("article_id").alias("here"), "upstream_source_id", "upstream_article_id", "co_produced")
    front = articles.select(F.col("article_id").alias("root"), F.col("article_id").alias("here"), "source_id", F.array().cast("array<string>").alias("trail"))
    found: DataFrame | None = None
    while True:
        met = F.array_contains("trail", F.col("here").cast("string"))
        step = stored(front.withColumn("met", met).join(up, "here", "left"), "trail")
        ends = step.where("met or upstream_source_id is null or co_produced").select("root", "source_id")
        outside = step.where("not met and upstream_source_id is not null and upstream_article_id is null").select("root", F.col("upstream_source_id").alias("source_id"))
        found = ends.union(outside) if found is None else found.union(ends).union(outside)
        grown = F.concat("trail", F.array(F.col("here").cast("string")))
        front = step.where("not met and upstream_article_id is not null").select("root", F.col("upstream_article_id").alias("here"), F.col("upstream_source_id").alias("source_id"), grown.alias("trail"))
        if front.isEmpty():
            return found.select(F.col("root").alias("article_id"), "source_id").distinct()


def story_voices(dependencies: DataFrame) -> DataFrame:
    """(story_id, article_id, voice): articles of a story that share a dependency, directly or
    through others, are one voice, named by its least key.  dependencies: (story_id, article_id,
    key)."""
    first = dependencies.groupBy("story_id", "article_id").agg(F.min("key").alias("x"))
    edges = dependencies.join(first, ["story_id", "article_id"]).select("story_id", "x", F.col("key").alias("y"))
    found = components(edges, ["story_id"])
    named = first.join(found.withColumnRenamed("node", "x"), ["story_id", "x"], "left")
    return named.select("story_id", "article_id", F.coalesce("label", "x").alias("voice"))


def families(members: DataFrame) -> DataFrame:
    """Edges parent - member of (parent, members array)."""
    return members.select(F.col("parent").alias("x"), F.explode("members").alias("y")).where("x <> y")
