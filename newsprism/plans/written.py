"""Writes as queries: each makes a table on the shared folder, writes to it more than once, and gives the
rows read back; the SQL says what they must be."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism import tables
from newsprism.operators import catalog, search, writes
from newsprism.plans.composite import query
from newsprism.sources.model import Model
from newsprism.storage import new_path


def _table(m: Model, name: str, like: DataFrame, keys: Sequence[str]) -> tables.Table:
    """An empty table for rows of this schema, with as many buckets as a shuffle has partitions."""
    buckets = int(m.spark.conf.get("spark.sql.shuffle.partitions"))
    return tables.Table.create(m.spark, new_path(m.spark, name), like.schema, keys, buckets)


@query(
    "snk1_written",
    """SELECT entity, 'even' AS batch, min(article_id) AS first_article FROM {entities} WHERE article_id % 2 = 0 GROUP BY entity
    UNION ALL SELECT entity, 'odd', min(article_id) FROM {entities} WHERE entity NOT IN (SELECT entity FROM {entities} WHERE article_id % 2 = 0) GROUP BY entity""",
)
def _(m: Model) -> DataFrame:
    """Entities of two batches; the second meets keys that the first has written."""
    first = lambda rows, batch: rows.groupBy("entity").agg(F.lit(batch).alias("batch"), F.min("article_id").alias("first_article"))
    even, odd = first(m.entities.where("article_id % 2 = 0"), "even"), first(m.entities.where("article_id % 2 = 1"), "odd")
    table = _table(m, "entities", even, ["entity"])
    for batch in (even, odd, even.withColumn("batch", F.lit("again"))):
        tables.insert_absent(table, batch)
    return table.read()


@query(
    "snk2_written",
    """WITH o AS (SELECT article_id, title, language_code, content_hash FROM {articles} WHERE article_id % 3 <> 0), n AS (SELECT article_id, CASE WHEN article_id % 7 = 0 THEN 'new' ELSE title END AS title, CASE WHEN article_id % 11 = 0 THEN 'xx' ELSE language_code END AS language_code FROM {articles} WHERE article_id % 5 <> 0)
    SELECT coalesce(n.article_id, o.article_id) AS article_id, CASE WHEN n.article_id IS NULL THEN o.title ELSE n.title END AS title, CASE WHEN n.article_id IS NULL THEN o.language_code ELSE n.language_code END AS language_code,
      CASE WHEN n.article_id IS NULL OR n.title IS NOT DISTINCT FROM o.title THEN o.content_hash END AS normalized_hash FROM n FULL JOIN o ON n.article_id = o.article_id""",
)
def _(m: Model) -> DataFrame:
    """Articles seen again: only fields that differ are written, and where the title changed what was
    normalized from it is gone and due again; another language alone leaves it."""
    old = m.articles.where("article_id % 3 <> 0").select("article_id", "title", "language_code", F.col("content_hash").alias("normalized_hash"))
    new = m.articles.where("article_id % 5 <> 0").select("article_id", F.when(F.col("article_id") % 7 == 0, "new").otherwise(F.col("title")).alias("title"), F.when(F.col("article_id") % 11 == 0, "xx").otherwise(F.col("language_code")).alias("language_code"))
    table = _table(m, "articles", old, ["article_id"])
    table.append(old)
    tables.upsert(table, new, ["title", "language_code"], {"normalized_hash": ["title"]})
    return table.read()


@query("snk2_counters", "SELECT count(*) FILTER (WHERE article_id % 3 = 0) AS inserted, count(*) FILTER (WHERE article_id % 3 <> 0 AND article_id % 7 = 0 AND title IS DISTINCT FROM 'new') AS updated, count(*) FILTER (WHERE article_id % 3 <> 0 AND (article_id % 7 <> 0 OR title IS NOT DISTINCT FROM 'new')) AS unchanged FROM {articles} WHERE article_id % 5 <> 0")
def _(m: Model) -> DataFrame:
    """What the commit of a second load says that it did."""
    old = m.articles.where("article_id % 3 <> 0").select("article_id", "title")
    new = m.articles.where("article_id % 5 <> 0").select("article_id", F.when(F.col("article_id") % 7 == 0, "new").otherwise(F.col("title")).alias("title"))
    table = _table(m, "articles", old, ["article_id"])
    table.append(old)
    done = tables.upsert(table, new, ["title"]).metrics
    return m.spark.createDataFrame([tuple(done.get(k, 0) for k in ("insert", "update", "unchanged"))], "inserted long, updated long, unchanged long")


@query("snk4_written", "SELECT story_id, claim_id, 1 AS generation FROM {members} WHERE story_id % 8 <> 0 OR story_id % 3 = 0 UNION ALL SELECT story_id, claim_id, 2 FROM {members} WHERE story_id % 8 = 0 AND story_id % 3 <> 0 AND claim_id % 2 = 0")
def _(m: Model) -> DataFrame:
    """Claims of stories in generations; readers take each story's newest, writers remove nothing."""
    claims = m.members.select("story_id", "claim_id", F.lit(0).alias("generation"))
    table = _table(m, "generations", claims, ["story_id"])
    tables.new_generation(table, claims)
    tables.new_generation(table, claims.where("story_id % 8 = 0 and story_id % 3 <> 0 and claim_id % 2 = 0"))
    newest = writes.current(table.read(), "story_id")
    # a story whose second run found nothing keeps its first generation
    return newest


@query("snk5_written", "SELECT article_id, entity, 1 AS run FROM {entities} WHERE article_id % 3 <> 0 UNION ALL SELECT article_id, entity, 2 FROM {entities} WHERE article_id % 3 = 0 AND length(entity) > 5")
def _(m: Model) -> DataFrame:
    """Mentions of covered articles replaced on the table, also by fewer or none."""
    first = m.entities.select("article_id", "entity", F.lit(1).alias("run"))
    table = _table(m, "mentions", first, ["article_id"])
    table.append(first)
    tables.replace(table, first.where("article_id % 3 = 0 and length(entity) > 5").withColumn("run", F.lit(2)), m.entities.where("article_id % 3 = 0"))
    return table.read()


@query("snk6_written", "SELECT e.article_id, e.content_hash FROM {eligible} e WHERE e.content_hash IS NOT NULL")
def _(m: Model) -> DataFrame:
    """Search documents after those of articles that are not eligible were deleted."""
    documents = m.articles.where("content_hash is not null").select("article_id", "content_hash")
    table = _table(m, "documents", documents, ["article_id"])
    table.append(documents)
    tables.delete_absent(table, m.eligible.select("article_id"))
    return table.read()


@query("snk7_written", "SELECT m.story_id, m.article_id FROM {memberships} m WHERE EXISTS (SELECT 1 FROM {story_articles} s WHERE s.story_id = m.story_id AND s.article_id % 2 = 0)")
def _(m: Model) -> DataFrame:
    """A cascade over two tables: stories without a living member go, then the memberships of stories gone."""
    stories = m.memberships.select("story_id").distinct()
    members = m.memberships.select("story_id", "article_id")
    held, children = _table(m, "stories", stories, ["story_id"]), _table(m, "memberships", members, ["story_id"])
    held.append(stories)
    children.append(members)
    tables.delete_absent(held, m.story_articles.where("article_id % 2 = 0").select("story_id"))
    tables.delete_absent(children, held.read())
    return children.read()


@query("snk8_written", "SELECT article_id, coalesce(title, '') AS title, CASE WHEN article_id % 3 <> 0 AND article_id % 7 <> 0 THEN 1 ELSE 2 END AS indexed FROM {eligible}")
def _(m: Model) -> DataFrame:
    """Search documents upserted by hash: what is unchanged is not indexed again."""
    docs = search.documents(m.eligible).select("article_id", "title", "document_hash")
    old = docs.where("article_id % 3 <> 0").withColumns({"title": F.when(F.col("article_id") % 7 == 0, "old").otherwise(F.col("title")), "document_hash": F.when(F.col("article_id") % 7 == 0, "old").otherwise(F.col("document_hash")), "indexed": F.lit(1)})
    table = _table(m, "search", old, ["article_id"])
    table.append(old)
    due = docs.join(table.read().select("article_id", "document_hash"), ["article_id", "document_hash"], "left_anti")
    tables.upsert(table, due.withColumn("indexed", F.lit(2)), ["title", "document_hash", "indexed"])
    return table.read().drop("document_hash")


@query(
    "snk9_written",
    """WITH w AS (SELECT source_id, CASE WHEN num % 5 = 0 THEN ' ' || upper(source_id) || ' ' ELSE 'New ' || num // 2 END AS name, CASE WHEN num % 7 = 0 THEN source_id ELSE 'slug-' || source_id END AS slug, 'https://x' || num % 11 AS url, num FROM {sources} WHERE num IS NOT NULL),
    k AS (SELECT *, lower(trim(name)) AS k FROM w)
    SELECT source_id AS slug, source_id AS name, 'https://' || source_id AS url FROM {sources} WHERE num IS NOT NULL
    UNION ALL SELECT slug, name, url FROM k WHERE NOT (k IN (SELECT source_id FROM {sources}) OR (SELECT min(o.slug) FROM k o WHERE o.k = k.k) < slug OR slug IN (SELECT source_id FROM {sources}) OR (SELECT min(o.slug) FROM k o WHERE o.url = k.url) < slug)""",
)
def _(m: Model) -> DataFrame:
    """Sources created where name, slug and url are free; the others leave no row."""
    s = m.sources.where("num is not null")
    have = s.selectExpr("source_id as slug", "source_id as name", "concat('https://', source_id) as url")
    wanted = s.selectExpr("CASE WHEN num % 7 = 0 THEN source_id ELSE concat('slug-', source_id) END as slug", "CASE WHEN num % 5 = 0 THEN concat(' ', upper(source_id), ' ') ELSE concat('New ', num div 2) END as name", "concat('https://x', num % 11) as url")
    table = _table(m, "sources", have, ["slug"])
    table.append(have)
    free = catalog.create_sources(table.read(), wanted).where("outcome = 'created'").select("name", "slug")
    tables.insert_absent(table, wanted.join(free, ["name", "slug"], "left_semi"))
    return table.read()


@query("snk10_written", "SELECT source_id, source_type, CASE WHEN num % 6 <> 0 AND num % 5 = 0 THEN num % 4 ELSE num % 2 END AS priority FROM {sources} WHERE num % 5 <> 0 OR num % 6 <> 0")
def _(m: Model) -> DataFrame:
    """A catalog applied: what is missing is created, priorities follow, what it lacks stays; a catalog
    with a conflict is turned away whole."""
    running = m.sources.where("num % 6 <> 0").select("source_id", "source_type", (F.col("num") % 4).alias("priority"))
    wanted = m.sources.where("num % 5 <> 0").select("source_id", "source_type", (F.col("num") % 2).alias("priority"))
    table = _table(m, "catalog", running, ["source_id"])
    table.append(running)
    try:
        tables.reconcile(table, wanted.withColumns({"source_type": F.lit("OTHER"), "priority": F.lit(9).cast("bigint")}), ["source_type", "priority"], ["source_type"])
    except tables.Blocked:
        tables.reconcile(table, wanted, ["source_type", "priority"], ["source_type"])
    return table.read()


@query("snk11_written", "SELECT source_id AS slug, CASE WHEN num % 3 = 0 THEN 'Canonical ' || num ELSE source_id END AS name, CASE WHEN num % 5 = 0 THEN 'v' || num ELSE 'u' || num END AS url FROM {sources} WHERE num IS NOT NULL")
def _(m: Model) -> DataFrame:
    """The merge plan of legacy sources applied to the table, its actions as partial updates."""
    s = m.sources.where("num is not null")
    none = "cast(array() as array<struct<name: string, category: string>>)"
    specs = s.selectExpr("source_id as slug", "CASE WHEN num % 3 = 0 THEN concat('Canonical ', num) ELSE source_id END as name", "CASE WHEN num % 5 = 0 THEN concat('v', num) ELSE concat('u', num) END as url", f"{none} as outlets")
    have = s.selectExpr("source_id as slug", "source_id as name", "concat('u', num) as url")
    table = _table(m, "legacy", have, ["slug"])
    table.append(have)
    outlets = m.spark.createDataFrame([], "slug string, name string, category string")
    plan = catalog.merge_plan(specs, table.read(), outlets).groupBy("slug").agg(F.collect_set("action").alias("actions"))
    due = lambda action, c: F.struct(F.col(c).alias("value"), F.array_contains("actions", action).alias("present")).alias(c)
    tables.patch(table, specs.join(plan, "slug").select("slug", due("canonicalize_source_name", "name"), due("update_source_url", "url")), ["name", "url"])
    return table.read()


@query("snk12_written", "SELECT f.source_id AS parent, s.source_id AS member, CASE WHEN s.num % 4 = 1 THEN 'old' ELSE 'new' END AS origin FROM {sources} f JOIN {sources} s ON s.family = f.family AND f.num % 4 = 0 AND s.num <> f.num WHERE s.num % 4 = 1 OR f.active AND s.active")
def _(m: Model) -> DataFrame:
    """Relations of families after the plan: those it creates beside those that were there."""
    families = m.sources.groupBy("family").agg(F.min(F.when(F.col("num") % 4 == 0, F.col("source_id"))).alias("parent"), F.collect_set(F.when(F.col("num") % 4 != 0, F.col("source_id"))).alias("members")).where("parent is not null")
    had = m.sources.where("num % 4 = 1").join(families.select("family", "parent"), "family").select("parent", F.col("source_id").alias("member"), F.lit("old").alias("origin"))
    table = _table(m, "relations", had, ["parent", "member"])
    table.append(had)
    plan = catalog.family_plan(families, m.sources.select(F.col("source_id").alias("slug"), "active"), table.read().select("parent", "member"))
    tables.insert_absent(table, plan.where("action = 'create_relation'").select("parent", "member", F.lit("new").alias("origin")))
    return table.read()


@query("st5_committed", "SELECT story_id, count(*) AS claims FROM {members} GROUP BY story_id HAVING count(CASE WHEN claim_id % 997 = 0 THEN 1 END) = 0")
def _(m: Model) -> DataFrame:
    """Results of a run whose inputs were edited meanwhile: at the commit the inputs are hashed again, and
    results of stories that changed are not written."""
    digest = lambda text: F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "claim_id", text)))), 256)
    results = m.members.groupBy("story_id").agg(digest(F.col("claim_key")).alias("input_hash"), F.count("*").alias("claims"))
    edited = F.when(F.col("claim_id") % 997 == 0, "edited").otherwise(F.col("claim_key"))
    table = _table(m, "results", results, ["story_id"])
    tables.commit_unchanged(table, results, lambda: m.members.groupBy("story_id").agg(digest(edited).alias("input_hash")))
    return table.read().drop("input_hash")
