"""Sources, catalogs and provenance: what may be created, what a plan would do, and what conflicts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.operators import writes


def create_sources(existing: DataFrame, wanted: DataFrame) -> DataFrame:
    """(name, slug, outcome): created, or which unique key is taken - by a source that exists or by
    an earlier wanted one.  Both: (name, slug, url); names compare without case and outer blanks."""
    key = F.lower(F.trim("name"))
    taken = {"name": existing.select(key.alias("k")), "slug": existing.select(F.col("slug").alias("k")), "url": existing.select(F.col("url").alias("k"))}
    rows = wanted.withColumn("_name", key)
    for field, column in (("name", "_name"), ("slug", "slug"), ("url", "url")):
        had = taken[field].distinct().select(F.col("k").alias(column), F.lit(True).alias(f"_{field}_taken"))
        first = wanted.withColumn("_name", key).groupBy(column).agg(F.min("slug").alias(f"_{field}_first"))
        rows = rows.join(had, column, "left").join(first, column, "left")
        rows = rows.withColumn(f"_{field}_taken", F.coalesce(f"_{field}_taken", F.lit(False)) | (F.col(f"_{field}_first") < F.col("slug")))
    outcome = F.when(F.col("_name_taken"), "name_taken").when(F.col("_slug_taken"), "slug_taken").when(F.col("_url_taken"), "url_taken").otherwise("created")
    return rows.select("name", "slug", outcome.alias("outcome"))


def family_plan(families: DataFrame, sources: DataFrame, relations: DataFrame) -> DataFrame:
    """(parent, member, action) of families (parent, members): create_relation, no_change where an
    undated one exists, missing where a side is no active source.  relations: (parent, member)."""
    pairs = families.select("parent", F.explode("members").alias("member"))
    active = sources.where("active").select("slug")
    known = pairs.join(active.withColumnRenamed("slug", "parent"), "parent", "left_semi").join(active.withColumnRenamed("slug", "member"), "member", "left_semi").withColumn("known", F.lit(True))
    rows = pairs.join(known, ["parent", "member"], "left").join(relations.distinct().withColumn("had", F.lit(True)), ["parent", "member"], "left")
    action = F.when(F.col("known").isNull(), "missing").when(F.col("had"), "no_change").otherwise("create_relation")
    return rows.select("parent", "member", action.alias("action"))


def merge_plan(specs: DataFrame, sources: DataFrame, outlets: DataFrame) -> DataFrame:
    """(slug, action, detail) that bring legacy sources to their canonical identity.  specs: (slug,
    name, url, outlets array<struct<name, category>>); sources: (slug, name, url); outlets: (slug,
    name, category).  A source that is absent is a conflict; one without actions is no_change."""
    own = sources.select("slug", F.col("name").alias("old_name"), F.col("url").alias("old_url"))
    rows = specs.join(own, "slug", "left")
    there = rows.where("old_name is not null")
    missing = rows.where("old_name is null").select("slug", F.lit("conflict").alias("action"), F.lit("missing").alias("detail"))
    names = there.where("name <> old_name").select("slug", F.lit("canonicalize_source_name").alias("action"), F.concat_ws(" -> ", "old_name", "name").alias("detail"))
    urls = there.where("not (url <=> old_url)").select("slug", F.lit("update_source_url").alias("action"), F.concat_ws(" -> ", "old_url", "url").alias("detail"))
    wanted = there.select("slug", F.explode("outlets").alias("o")).select("slug", F.col("o.name").alias("name"), F.col("o.category").alias("category"), F.lower(F.trim("o.name")).alias("k"))
    have = outlets.select("slug", F.lower(F.trim("name")).alias("k"), "category")
    new = wanted.join(have, ["slug", "k", "category"], "left_anti").select("slug", F.lit("create_outlet").alias("action"), F.col("name").alias("detail"))
    actions = names.union(urls).union(new)
    same = there.join(actions.select("slug").distinct(), "slug", "left_anti").select("slug", F.lit("no_change").alias("action"), F.lit("").alias("detail"))
    return missing.union(actions).union(same)


def catalog_conflicts(entries: DataFrame, sources: DataFrame, feeds: DataFrame) -> DataFrame:
    """(slug, rule, detail): entries (slug, name, source_type, country, feed_url) against what runs;
    any conflict blocks the whole catalog.  sources: (slug, name, source_type, country); feeds:
    (slug, url)."""
    run = sources.select("slug", F.col("name").alias("r_name"), F.col("source_type").alias("r_type"), F.col("country").alias("r_country"))
    both = entries.join(run, "slug")
    owner = feeds.select(F.col("url").alias("feed_url"), F.col("slug").alias("owner"))
    by_name = sources.select(F.lower("name").alias("k"), F.col("slug").alias("other"))
    clash = entries.select("slug", F.lower("name").alias("k")).distinct().join(by_name, "k").where("slug <> other")
    parts = [
        both.where("not (source_type <=> r_type)").select("slug", F.lit("source_type").alias("rule"), F.concat_ws("/", "source_type", "r_type").alias("detail")),
        both.where("not (country <=> r_country)").select("slug", F.lit("country").alias("rule"), F.concat_ws("/", F.coalesce("country", F.lit("-")), F.coalesce("r_country", F.lit("-"))).alias("detail")),
        entries.join(owner, "feed_url").where("slug <> owner").select("slug", F.lit("feed_owner").alias("rule"), F.col("owner").alias("detail")),
        clash.select("slug", F.lit("name").alias("rule"), F.col("other").alias("detail")),
    ]
    return reduce(DataFrame.union, parts).distinct()


def outlets(entries: DataFrame, country: str, category: str) -> DataFrame:
    """A row an outlet of entries (slug, country, category, outlets array<struct<name, country,
    category>>): what an outlet leaves open comes from its entry, then from the catalog; the first
    outlet of a source is its primary one."""
    rows = entries.select("slug", "country", "category", F.posexplode("outlets").alias("place", "o"))
    return rows.select("slug", F.col("o.name").alias("name"), F.coalesce("o.country", "country", F.lit(country)).alias("country"), F.coalesce("o.category", "category", F.lit(category)).alias("category"), (F.col("place") == 0).alias("is_primary"))


def pending_provenance(detected: DataFrame, articles: DataFrame, sources: DataFrame, existing: DataFrame) -> DataFrame:
    """Candidates to store for detected agencies (article_id, source_slug, method, confidence):
    upstream exists, is active and isn't the article's own source; not stored yet.  existing:
    (article_id, upstream_source_id)."""
    up = sources.where("active").select(F.col("slug").alias("source_slug"), F.col("source_id").alias("upstream_source_id"))
    rows = detected.join(up, "source_slug").join(articles.select("article_id", "source_id"), "article_id").where("source_id <> upstream_source_id")
    return writes.insert_absent(existing, rows.select("article_id", "upstream_source_id", "method", "confidence"), ["article_id", "upstream_source_id"])


def provenance_outcomes(wanted: DataFrame, articles: DataFrame, sources: DataFrame) -> DataFrame:
    """(id, outcome) of provenance rows (id, article_id, upstream_source_id, upstream_article_id):
    created, or the rule that forbids it.  articles: active (article_id, source_id)."""
    own = articles.select("article_id", F.lit(True).alias("_there"))
    up = articles.select(F.col("article_id").alias("upstream_article_id"), F.col("source_id").alias("_up_source"))
    active = sources.where("active").select(F.col("source_id").alias("upstream_source_id"), F.lit(True).alias("_active"))
    rows = wanted.join(own, "article_id", "left").join(active, "upstream_source_id", "left").join(up, "upstream_article_id", "left")
    first = F.min("id").over(writes.Window.partitionBy("article_id", "upstream_source_id", "upstream_article_id"))
    linked = F.col("upstream_article_id").isNotNull()
    outcome = (
        F.when(F.col("_there").isNull(), "no_article")
        .when(F.col("_active").isNull(), "no_upstream_source")
        .when(linked & F.col("_up_source").isNull(), "no_upstream_article")
        .when(linked & (F.col("_up_source") != F.col("upstream_source_id")), "wrong_upstream_source")
        .when(linked & (F.col("upstream_article_id") == F.col("article_id")), "own_upstream")
        .when(first < F.col("id"), "exists")
        .otherwise("created")
    )
    return rows.select("id", outcome.alias("outcome"))


def reviewed(rows: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """Rows (id, status, reviewed_s) after decisions (id, new_status): the time moves only if the
    status changes, and pending has none."""
    both = rows.join(decisions, "id", "left")
    changed = F.col("new_status").isNotNull() & (F.col("new_status") != F.col("status"))
    at = F.when(changed, F.when(F.col("new_status") != "pending", now)).otherwise(F.col("reviewed_s"))
    return both.select("id", F.when(changed, F.col("new_status")).otherwise(F.col("status")).alias("status"), at.alias("reviewed_s"))


# -- fixed values: what a reviewed catalog says of itself ---------------------------------------

REVIEWED = "only_verified_relevant_official_content_channels_are_activated"
CLASSES_ONLY = "catalog_review_metadata_only_not_persisted"
ONE_COUNTRY, OWN_COUNTRY = "catalog_required", "per_entry_required"
SOURCE_ONLY, CREATE, EXTEND = "source_only", "create_source", "extend_existing_source"
SCOPES = ("LOCAL", "REGIONAL", "NATIONAL", "INTERNATIONAL", "GLOBAL")


def country_codes(spark: SparkSession) -> list[str]:
    """ISO 3166 codes of two letters, as the JVM knows them."""
    return sorted(spark._jvm.java.util.Locale.getISOCountries())


def activation_violations(catalogs: DataFrame, entries: DataFrame, feeds: DataFrame) -> DataFrame:
    """(catalog, name, rule, detail): everything that forbids to activate a catalog, each offender named.

    catalogs: (catalog, activation_policy, class_policy, source_type, country, country_policy, scope,
    roles map<string,string>); entries: (catalog, name, action, existing, materialization, source_type,
    country, scope, outlets int); feeds: (catalog, name, place, url, feed_class, role, tier, active).
    Null policies of country and action stand for the usual ones.  Entries that a catalog doesn't
    activate (without feeds, or of another action) are held to the rules of materialization only."""
    codes = country_codes(catalogs.sparkSession)
    known = lambda c: F.coalesce(F.col(c).isin(*codes), F.lit(False))
    policy = F.coalesce("country_policy", F.lit(ONE_COUNTRY))
    c = catalogs.withColumn("country_policy", policy)
    single, each = F.col("country_policy") == ONE_COUNTRY, F.col("country_policy") == OWN_COUNTRY
    blank = F.lit(None).cast("string")
    of_catalog = {
        "activation_policy": (~F.col("activation_policy").eqNullSafe(F.lit(REVIEWED)), "activation_policy"),
        "class_policy": (~F.col("class_policy").eqNullSafe(F.lit(CLASSES_ONLY)), "class_policy"),
        "incomplete": (F.coalesce("source_type", F.lit("")) == "", "source_type"),
        "no_roles": (F.coalesce(F.size("roles"), F.lit(0)) <= 0, "catalog"),
        "catalog_country": (single & ~known("country"), "country"),
        "catalog_has_country": (each & F.col("country").isNotNull(), "country"),
        "country_policy": (~single & ~each, "country_policy"),
    }
    parts = [c.where(bad).select("catalog", blank.alias("name"), F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail")) for rule, (bad, detail) in of_catalog.items()]

    counted = feeds.groupBy("catalog", "name").agg(F.count("*").alias("feeds"))
    top = c.select("catalog", F.col("source_type").alias("c_type"), F.col("country").alias("c_country"), "country_policy", F.col("scope").alias("c_scope"), "roles")
    e = entries.join(top, "catalog").join(counted, ["catalog", "name"], "left").withColumns({"feeds": F.coalesce("feeds", F.lit(0)), "action": F.coalesce("action", F.lit(CREATE)), "outlets": F.coalesce("outlets", F.lit(0))})
    only = F.coalesce(F.col("materialization") == SOURCE_ONLY, F.lit(False))
    create, extend = F.col("action") == CREATE, F.col("action") == EXTEND
    active = create & ((F.col("feeds") > 0) | only) | extend & ((F.col("feeds") > 0) | (F.col("outlets") > 0))
    of_entry = {
        "materialization": (F.col("materialization").isNotNull() & ~only, "materialization"),
        "source_only_creates": (only & ~create, "action"),
        "source_only_has_feeds": (only & (F.col("feeds") > 0), "feeds"),
        "extends_nothing": (extend & (F.coalesce("existing", F.lit("")) == ""), "action"),
        "action": (~create & ~extend & ((F.col("feeds") > 0) | F.col("materialization").isNotNull()), "action"),
        "source_type": (active & ~F.coalesce(F.nullif("source_type", F.lit("")), "c_type").eqNullSafe(F.col("c_type")), "source_type"),
        "country": (active & single & F.col("country").isNotNull() & ~F.col("country").eqNullSafe(F.col("c_country")), "country"),
        "entry_country": (active & each & ~known("country"), "country"),
        "scope": (active & ~F.coalesce(F.coalesce(F.nullif("scope", F.lit("")), "c_scope").isin(*SCOPES), F.lit(True)), "scope"),
    }
    parts += [e.where(bad).select("catalog", "name", F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail")) for rule, (bad, detail) in of_entry.items()]

    f = feeds.join(e.where(active).select("catalog", "name", "roles"), ["catalog", "name"]).withColumn("wanted", F.try_element_at("roles", F.col("feed_class")))
    first = F.min("place").over(writes.Window.partitionBy("catalog", "url"))
    f = f.withColumn("first", first)
    url = F.coalesce("url", F.lit(""))
    of_feed = {
        "feed_class": (F.col("wanted").isNull(), "feed_class"),
        "role": (F.col("wanted").isNotNull() & ~F.col("role").eqNullSafe(F.col("wanted")), "role"),
        "tier": (~F.coalesce(F.col("tier").isin(1, 2), F.lit(False)), "tier"),
        "active": (F.coalesce(F.col("tier").isin(1, 2), F.lit(False)) & ~F.col("active").eqNullSafe(F.col("tier") == 1), "active"),
        "no_url": (url == "", "url"),
        "url_again": ((url != "") & (F.col("place") > F.col("first")), "url"),
    }
    parts += [f.where(bad).select("catalog", "name", F.lit(rule).alias("rule"), F.col(detail).cast("string").alias("detail")) for rule, (bad, detail) in of_feed.items()]
    return reduce(DataFrame.union, parts)
