"""Evidence, consensus, coverage and the integrated story view.

Inputs are flat tables keyed by story; each side is aggregated before it is joined, so that
members, evidence and perspectives don't multiply each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# -- fixed values ----------------------------------------------------------------------------

PRESS_RELEASE = ("press release", "pressemitteilung", "news release", "media release")
REPORTING = ("NEWS", "AGENCY", "REGIONAL", "ALTERNATIVE")
NUMBER = r"(?U)\b\d+(?:[.,]\d+)?(?:\s*%)?\b"
INDEPENDENT = ("editorial", "expert_analysis")
MINIMUM = 2


def independent(role: Column) -> Column:
    return F.coalesce(role.isin(*INDEPENDENT), F.lit(False))


def direct_quotes(perspectives: DataFrame) -> DataFrame:
    """(claim_id, quotes): texts of quoted perspectives, in order of their ids."""
    rows = perspectives.where("kind = 'quoted'").groupBy("claim_id").agg(F.array_sort(F.collect_list(F.struct("perspective_id", "evidence_text"))).alias("q"))
    return rows.select("claim_id", F.transform("q", lambda x: x["evidence_text"]).alias("quotes"))


def press_release(title: Column | str, text: Column | str) -> Column:
    """Whether the title or the first 1,000 characters name a press release."""
    head, said = F.lower(F.substring(text, 1, 1000)), F.lit(False)
    for phrase in PRESS_RELEASE:
        said = said | F.coalesce(F.lower(title).contains(phrase), F.lit(False)) | F.coalesce(head.contains(phrase), F.lit(False))
    return said


def kind_of(released: Column, source_type: Column, numbered: Column) -> Column:
    return (
        F.when(released, "press_release")
        .when(source_type == "ACADEMIC", "study")
        .when((source_type == "PRIMARY_SOURCE") & numbered, "official_data")
        .when(source_type == "PRIMARY_SOURCE", "primary_source")
        .when(source_type.isin(*REPORTING), "independent_reporting")
        .otherwise("context")
    )


def evidence_kind(title: Column, text: Column, source_type: Column, claim: Column) -> Column:
    return kind_of(press_release(title, text), source_type, claim.rlike(NUMBER))


def evidence(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """An item a quote of a claim, else one for the claim itself; and how it bears on the group.
    claims: (story_id, group_id, claim_id, article_id, source_id, source_type, claim_text, title,
    body)."""
    return evidence_items(claims.withColumn("own", evidence_kind(F.col("title"), F.col("body"), F.col("source_type"), F.col("claim_text"))), quotes)


def evidence_items(claims: DataFrame, quotes: DataFrame) -> DataFrame:
    """evidence() of claims whose own kind is known (`own`); where they carry no claim_text, the text of an item
    that is no quote is null."""
    rows = claims.join(quotes, "claim_id", "left").withColumn("quote", F.explode_outer("quotes"))
    kind = F.when(F.col("quote").isNotNull(), "direct_quote").otherwise(F.col("own"))
    text = F.coalesce("quote", "claim_text") if "claim_text" in claims.columns else F.col("quote")
    rows = rows.withColumn("kind", kind).withColumn("text", text)
    order = Window.partitionBy("story_id").orderBy(F.col("group_id").cast("string"), F.col("article_id").cast("string"), F.col("claim_id").cast("string"), "text")
    key = F.concat(F.lit("evidence-"), F.lpad(F.row_number().over(order).cast("string"), 5, "0"))
    relation = F.when(F.col("kind") == "context", "context").otherwise("supports")
    return rows.select("story_id", "group_id", "claim_id", "source_id", key.alias("key"), "kind", "text", relation.alias("relation"), F.lit(1.0).alias("confidence"))


def consensus(members: DataFrame, items: DataFrame, perspectives: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    """Six counts and a label a group.  members: (story_id, group_id, claim_id, article_id, role,
    voice); items: evidence(); perspectives: (claim_id, holder)."""
    m = members.groupBy("story_id", "group_id").agg(
        F.countDistinct("claim_id").alias("claims"), F.countDistinct("article_id").alias("articles"), F.countDistinct(F.when(independent(F.col("role")), F.col("voice"))).alias("independent_sources")
    )
    e = items.groupBy("story_id", "group_id").agg(F.count("*").alias("evidence_items"), F.countDistinct("source_id").alias("evidence_sources"))
    said = perspectives.where("holder is not null").groupBy("claim_id").agg(F.count("*").alias("n"))
    p = members.select("story_id", "group_id", "claim_id").distinct().join(said, "claim_id").groupBy("story_id", "group_id").agg(F.sum("n").alias("attributed"))
    rows = m.join(e, ["story_id", "group_id"], "left").join(p, ["story_id", "group_id"], "left").na.fill(0, ["evidence_items", "evidence_sources", "attributed"])
    return rows.withColumn("label", F.when(F.col("independent_sources") >= minimum, "shared").otherwise("single_source"))


def differences(relations: DataFrame, groups: DataFrame) -> DataFrame:
    """Relations with both sides' counts.  relations: (story_id, left_group, right_group, kind)."""
    side = lambda s: groups.select("story_id", F.col("group_id").alias(f"{s}_group"), F.col("independent_sources").alias(f"{s}_independent"), F.col("evidence_sources").alias(f"{s}_evidence"))
    rows = relations.join(side("left"), ["story_id", "left_group"]).join(side("right"), ["story_id", "right_group"])
    return rows.withColumn("difference", F.when(F.col("kind") == "contradicts", "contradiction").otherwise("dispute"))


def both_sides(relations: DataFrame, groups: DataFrame, counts: list[str]) -> DataFrame:
    """Relations (story_id, left_group, right_group, ...) with the counts of both groups as left_<count> and
    right_<count>; relations of a group that is not there have no row.  groups: (story_id, group_id,
    counts)."""
    for side in ("left", "right"):
        own = groups.select("story_id", F.col("group_id").alias(f"{side}_group"), *(F.col(c).alias(f"{side}_{c}") for c in counts))
        relations = relations.join(own, ["story_id", f"{side}_group"])
    return relations


def _counts(sources: DataFrame, column: str, name: str) -> DataFrame:
    """(story_id, map of value -> distinct sources), nulls left out."""
    each = sources.where(F.col(column).isNotNull()).groupBy("story_id", column).agg(F.countDistinct("source_id").cast("int").alias("n"))
    return each.groupBy("story_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(column, "n")))).alias(name))


def counted(sources: DataFrame) -> DataFrame:
    """Five counts a story.  sources: (story_id, article_id, source_id, voice, role)."""
    signal = F.col("role") == "signal"
    return sources.groupBy("story_id").agg(
        F.countDistinct("article_id").alias("articles"),
        F.countDistinct("source_id").alias("sources"),
        F.countDistinct(F.when(~signal, F.col("source_id"))).alias("content_sources"),
        F.countDistinct(F.when(signal, F.col("source_id"))).alias("signal_sources"),
        F.countDistinct(F.when(independent(F.col("role")), F.col("voice"))).alias("independent_sources"),
    )


def coverage(sources: DataFrame, groups: DataFrame, found_differences: DataFrame) -> DataFrame:
    """Nine counts and three distributions a story.  sources: (story_id, article_id, source_id,
    voice, role, source_type, coverage_scope, country); groups: consensus()."""
    base = counted(sources)
    g = groups.groupBy("story_id").agg(F.count("*").alias("groups"), F.count_if(F.col("label") == "shared").alias("shared_groups"), F.count_if(F.col("attributed") > 0).alias("attributed_groups"))
    d = found_differences.groupBy("story_id").agg(F.count("*").alias("differences"))
    rows = base.join(g, "story_id", "left").join(d, "story_id", "left").na.fill(0)
    for column, name in (("source_type", "by_type"), ("coverage_scope", "by_scope"), ("country", "by_country")):
        rows = rows.join(_counts(sources, column, name), "story_id", "left").withColumn(name, F.coalesce(name, F.create_map().cast("map<string,int>")))
    return rows


def gaps(covered: DataFrame, minimum: int = MINIMUM) -> DataFrame:
    few = covered.where(F.col("independent_sources") < minimum).select("story_id", F.lit("limited_independent_content_sources").alias("gap"), F.col("independent_sources").alias("observed"), F.lit(minimum).cast("bigint").alias("expected"))
    only = covered.where("signal_sources > 0 and content_sources = 0").select("story_id", F.lit("signal_without_content_coverage"), "signal_sources", F.lit(None).cast("bigint"))
    return few.union(only)


def missing_perspectives(groups: DataFrame, found: DataFrame) -> DataFrame:
    """Groups that nobody is named for, with the other sides of their contradictions (disputes are
    not listed)."""
    against = found.where("difference = 'contradiction'")
    both = against.select("story_id", F.col("left_group").alias("group_id"), F.col("right_group").alias("other")).union(against.select("story_id", "right_group", "left_group"))
    listed = both.groupBy("story_id", "group_id").agg(F.array_sort(F.collect_set("other")).alias("contradicted_by"))
    rows = groups.where("attributed = 0").select("story_id", "group_id").join(listed, ["story_id", "group_id"], "left")
    return rows.withColumn("contradicted_by", F.coalesce("contradicted_by", F.array().cast("array<bigint>")))


def integrated(members: DataFrame, items: DataFrame, groups: DataFrame, covered: DataFrame, missing: DataFrame) -> DataFrame:
    """One nested document a story, only for stories whose stages agree on their groups."""
    m = members.groupBy("story_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("claim_id", "article_id", "source_id"))).alias("members"))
    e = items.groupBy("story_id", "group_id").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "relation"))).alias("evidence"))
    gone = missing.select("story_id", "group_id", F.lit(True).alias("missing_perspective"))
    rows = groups.join(m, ["story_id", "group_id"], "full").join(e, ["story_id", "group_id"], "full").join(gone, ["story_id", "group_id"], "left")
    whole = F.col("members").isNotNull() & F.col("evidence").isNotNull() & F.col("label").isNotNull()
    entry = F.struct("group_id", "label", "claims", "independent_sources", "members", "evidence", F.coalesce("missing_perspective", F.lit(False)).alias("missing_perspective"))
    docs = rows.groupBy("story_id").agg(F.array_sort(F.collect_list(entry)).alias("entries"), F.every(whole).alias("whole"))
    return docs.where("whole").drop("whole").join(covered, "story_id")


def ready(documents: DataFrame, stories: DataFrame, limit: int = 8) -> DataFrame:
    """The newest complete stories with at least two German-language sources, and a German title.
    stories: (story_id, source_id, language_code, title, time_s)."""
    de = stories.where((F.col("language_code") == "de") | F.col("language_code").startswith("de-"))
    titled = F.when(F.trim("title") != "", F.struct("time_s", "title"))
    ok = de.groupBy("story_id").agg(F.countDistinct("source_id").alias("n"), F.max("time_s").alias("last_s"), F.min(titled)["title"].alias("german_title")).where((F.col("n") >= 2) & F.col("german_title").isNotNull())
    return documents.join(ok, "story_id").orderBy(F.desc("last_s"), "story_id").limit(limit)
