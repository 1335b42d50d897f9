"""The news model over the driver's tables: sources, feeds, articles, memberships, claims and what
follows from them, as plain DataFrames.  The same derivations in SQL are in plans/oracle.py."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsprism.session import importable

#: Source types in their order.
SOURCE_TYPES = ("NEWS", "AGENCY", "REGIONAL", "ALTERNATIVE", "PRIMARY_SOURCE", "NGO", "INTEREST_GROUP", "COMPANY", "ACADEMIC", "THINK_TANK", "SIGNAL")
INDEPENDENT_ROLES = ("editorial", "expert_analysis")
EPOCH = 1704067200
#: More than a text has lines: ids of claims are an article's id times this, and a line's place.
LINES = 1 << 32


def default_role(source_type):
    """Confirmation role that a source type implies."""
    return (
        F.when(source_type == "PRIMARY_SOURCE", "primary_evidence")
        .when(source_type.isin("NGO", "INTEREST_GROUP", "COMPANY"), "advocacy")
        .when(source_type.isin("ACADEMIC", "THINK_TANK"), "expert_analysis")
        .when(source_type == "SIGNAL", "signal")
        .otherwise("editorial")
    )


class Model:
    """Tables of the news model for one scale factor; each is read and derived when first used."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = importable(spark), sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def sources(self) -> DataFrame:
        names = self.table("documents").where("source is not null").select(F.col("source").alias("source_id")).distinct()
        num = F.expr("try_cast(substr(source_id, 4) as bigint)")
        return names.withColumn("num", num).select(
            "source_id",
            "num",
            F.element_at(F.lit(list(SOURCE_TYPES)), (F.col("num") % 11 + 1).cast("int")).alias("source_type"),
            (F.col("num") % 9 != 4).alias("active"),
            F.expr("CASE num % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'AT' WHEN 2 THEN 'CH' END").alias("country"),
            F.expr("CASE num % 3 WHEN 0 THEN 'NATIONAL' WHEN 1 THEN 'REGIONAL' END").alias("coverage_scope"),
            F.expr("num div 4").alias("family"),
        )

    @cached_property
    def feeds(self) -> DataFrame:
        return self.sources.select(
            F.concat(F.lit("f"), "source_id").alias("feed_id"),
            "source_id",
            (F.col("num") % 13 != 5).alias("active"),
            F.expr("CASE WHEN num % 5 = 0 THEN 'signal' WHEN num % 5 = 1 THEN 'expert_analysis' END").alias("default_role"),
            F.expr("15 * (1 + num % 4)").alias("fetch_interval_minutes"),
            (F.col("num") % 3).alias("priority"),
            F.expr(f"CASE WHEN num % 6 <> 0 THEN {EPOCH} + num * 600 END").alias("last_fetched_s"),
        )

    @cached_property
    def articles(self) -> DataFrame:
        time_s = F.lit(EPOCH) + F.col("doc_id") * 60
        return self.table("documents").select(
            F.col("doc_id").alias("article_id"),
            F.concat(F.lit("f"), "source").alias("feed_id"),
            F.col("lang").alias("language_code"),
            F.split_part("text", F.lit("\n"), F.lit(1)).alias("title"),
            F.col("text").alias("body"),
            (F.col("doc_id") % 41 == 7).alias("deleted"),
            (F.col("text").isNotNull() & (F.col("doc_id") % 37 != 3)).alias("normalized"),
            F.expr("CASE WHEN doc_id % 29 = 0 THEN 'signal' WHEN doc_id % 29 = 1 THEN 'primary_evidence' END").alias("own_role"),
            time_s.alias("time_s"),
            F.when(F.col("doc_id") % 5 != 0, time_s).alias("published_s"),
            F.sha2("text", 256).alias("content_hash"),
        )

    @cached_property
    def eligible(self) -> DataFrame:
        """Articles that every analysis may use, with their source."""
        feeds = self.feeds.where("active").select("feed_id", "source_id", "default_role")
        sources = self.sources.where("active").select("source_id", "source_type", "coverage_scope", "country", "num")
        rows = self.articles.where("not deleted and normalized").join(feeds, "feed_id").join(sources, "source_id")
        role = F.coalesce("own_role", "default_role", default_role(F.col("source_type")))
        return rows.withColumn("role", role)

    @cached_property
    def memberships(self) -> DataFrame:
        return self.articles.select(F.expr("article_id - article_id % 4").alias("story_id"), "article_id", "time_s", (F.col("article_id") % 23 == 9).alias("deleted"))

    @cached_property
    def story_articles(self) -> DataFrame:
        """Active memberships of eligible articles."""
        return self.memberships.where("not deleted").select("story_id", "article_id").join(self.eligible, "article_id")

    @cached_property
    def claims(self) -> DataFrame:
        return self.claims_of(self.articles)

    @staticmethod
    def claims_of(articles: DataFrame) -> DataFrame:
        """A claim a non-blank line of a text."""
        lines = articles.select("article_id", F.posexplode(F.split("body", "\n")).alias("pos", "claim_text"))
        return lines.where("trim(claim_text) <> ''").select(
            F.expr(f"article_id * {LINES} + pos").alias("claim_id"),
            "article_id",
            F.col("pos").cast("bigint").alias("pos"),
            "claim_text",
            F.lower(F.trim("claim_text")).alias("claim_key"),
            F.expr("cast(60 + 5 * (pos % 5) as double) / 100").alias("confidence"),
        )

    @cached_property
    def members(self) -> DataFrame:
        """Claims of stories, in groups of equal keys."""
        rows = self.story_articles.select("story_id", "article_id", "source_id", "role", "time_s", "language_code", "source_type").join(self.claims, "article_id")
        group = F.min("claim_id").over(Window.partitionBy("story_id", "claim_key"))
        return rows.withColumn("group_id", group)

    @cached_property
    def voiced(self) -> DataFrame:
        """Members with what their perspective says, in one pass over the claims."""
        kind = F.element_at(F.lit(["quoted", "reported", "unattributed"]), (F.col("claim_id") % 3 + 1).cast("int"))
        return self.members.withColumns({"kind": kind, "holder": F.expr("CASE WHEN claim_id % 3 <> 2 THEN concat('e', claim_id % 17) END")})

    @cached_property
    def perspectives(self) -> DataFrame:
        return self.voiced.select("story_id", "claim_id", "article_id", "source_id", "group_id", "kind", "holder", "confidence")

    @cached_property
    def entities(self) -> DataFrame:
        """Mentions: capitalised words of titles."""
        words = self.eligible.select("article_id", "language_code", F.explode(F.array_distinct(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{3,}"), F.lit(0)))).alias("entity"))
        return words.select("article_id", "language_code", F.lower("entity").alias("entity"))

    @cached_property
    def embeddings(self) -> DataFrame:
        return self.table("embeddings").select(F.col("vec_id").alias("article_id"), "embedding", "label")

    def named(self) -> dict[str, DataFrame]:
        """The tables that SQL of the plans refers to."""
        names = ("sources", "feeds", "articles", "eligible", "memberships", "story_articles", "claims", "members", "perspectives", "entities", "embeddings")
        return {n: getattr(self, n) for n in names}
