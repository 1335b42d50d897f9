"""Article stages: normalisation, claims, entities and topics, perspectives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.functions import text as T

# -- fixed values ----------------------------------------------------------------------------

ENTITY_FLOOR, TOPIC_FLOOR, TOPIC_LETTERS, TOPICS = 0.65, 0.6, 4, 10
CLAIM_FLOOR, CLAIMS = 0.6, 30
REPORT_VERB = (
    "says|said|states?|stated|announces?|announced|claims?|claimed|argues?|argued|warns?|warned|confirms?|confirmed|told|"
    "sagt|sagte|erklärt|erklaert|erklärte|erklaerte|kündigt|kuendigt|kündigte|kuendigte|behauptet|behauptete|"
    "argumentiert|argumentierte|warnt|warnte|bestätigt|bestaetigt|bestätigte|bestaetigte"
)
REPORT_PREFIX = r"(according\s+to|laut|zufolge)\s*$"
QUOTES = '["“”„«»]'
BEFORE, AFTER = 48, 80


def normalize(articles: DataFrame) -> DataFrame:
    """Adds text, word_count, reading_minutes and content_hash; content wins over summary unless
    blank.  articles: (title, summary, content, ...)."""
    body = T.first_text(F.col("content"), F.col("summary"))
    out = articles.withColumns({"clean_title": T.column("plain_text", "title"), "text": T.column("plain_text", body)})
    words = T.word_count(F.col("text"))
    digest = F.sha2(F.concat_ws("\n", F.coalesce("clean_title", F.lit("")), F.coalesce("text", F.lit(""))), 256)
    return out.withColumns({"word_count": words, "reading_minutes": T.reading_minutes(words), "content_hash": digest})


def extract_claims(articles: DataFrame, floor: float = CLAIM_FLOOR, limit: int = CLAIMS) -> DataFrame:
    """A row a claim: the `limit` most confident of each article, in order of place."""
    rows = articles.select("article_id", F.explode(T.column("claims", "title", "body", "language_code")).alias("c")).select("article_id", "c.*")
    rows = rows.where(F.col("confidence") >= floor).withColumn("claim_hash", F.sha2("claim_key", 256))
    best = Window.partitionBy("article_id").orderBy(F.desc("confidence"), "text_source", "start_offset")
    place = Window.partitionBy("article_id").orderBy(F.desc("text_source"), "start_offset")  # title before body
    rows = rows.withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= limit).drop("_k")
    return rows.withColumn("place", F.row_number().over(place))


def entity_mentions(articles: DataFrame) -> DataFrame:
    return articles.select("article_id", F.explode(T.column("entity_mentions", "title", "body")).alias("m")).select("article_id", "m.*")


def resolve_entities(mentions: DataFrame) -> DataFrame:
    """Mentions sure enough to keep, with the id of their entity (key and type)."""
    sure = mentions.where((F.col("confidence") >= ENTITY_FLOOR) & (F.col("entity_key") != ""))
    return sure.withColumn("entity_id", F.sha2(F.concat_ws("|", "entity_key", "entity_type"), 256))


def resolve_topics(articles: DataFrame, limit: int = TOPICS) -> DataFrame:
    """(article_id, topic_key, slug, relevance, confidence): the best topics of each article, after
    resolution.  Keys that share a slug: the least keeps it, the others add a hash."""
    rows = articles.select("article_id", F.explode(T.column("topics", "title", "body")).alias("t")).select("article_id", "t.*")
    rows = rows.withColumn("topic_key", T.column("topic_key", "name")).where((F.col("confidence") >= TOPIC_FLOOR) & (F.length("topic_key") >= TOPIC_LETTERS) & ~F.col("topic_key").isin(*T.GENERIC_TOPICS))
    one = Window.partitionBy("article_id", "topic_key").orderBy(F.desc("relevance"), "name")
    best = Window.partitionBy("article_id").orderBy(F.desc("relevance"), "topic_key")
    rows = rows.withColumn("_n", F.row_number().over(one)).where("_n = 1").withColumn("_k", F.row_number().over(best)).where(F.col("_k") <= limit)
    keys = rows.select("topic_key").distinct().withColumn("base", T.column("topic_slug", "topic_key"))
    first = keys.groupBy("base").agg(F.min("topic_key").alias("first_key"))
    slugs = keys.join(first, "base").select("topic_key", F.when(F.col("topic_key") == F.col("first_key"), F.col("base")).otherwise(F.concat_ws("--", "base", F.substring(F.sha2("topic_key", 256), 1, 10))).alias("slug"))
    return rows.join(slugs, "topic_key").select("article_id", "topic_key", "slug", "relevance", "confidence")


def evidence_spans(claims: DataFrame, articles: DataFrame) -> DataFrame:
    """Claims with the sentence around them: evidence_start, evidence_end, evidence_text.

    Sentences here end at . ! ? or a line end; where the sentence of the claim's number doesn't
    hold the claim, its own span stands."""
    fields = [articles.select("article_id", F.lit(f).alias("text_source"), F.coalesce(c, F.lit("")).alias("_text")) for f, c in (("title", "title"), ("body", "body"))]
    texts = fields[0].union(fields[1]).withColumn("_sentences", T.column("evidence_sentences", "_text"))
    rows = claims.join(texts, ["article_id", "text_source"]).withColumn("_s", F.try_element_at("_sentences", F.col("sentence_index") + 1))
    head, tail = F.col("_s.start"), F.col("_s.end")
    holds = F.coalesce((head <= F.col("start_offset")) & (F.col("end_offset") <= tail), F.lit(False))
    rows = rows.withColumns({"evidence_start": F.when(holds, head).otherwise(F.col("start_offset")), "evidence_end": F.when(holds, tail).otherwise(F.col("end_offset"))})
    cut = F.substring("_text", F.col("evidence_start") + 1, F.col("evidence_end") - F.col("evidence_start"))
    return rows.withColumn("evidence_text", cut).drop("_text", "_sentences", "_s")


def attribute(claims: DataFrame, mentions: DataFrame, articles: DataFrame) -> DataFrame:
    """One row a claim: who says it, if a mention in its sentence is followed by a reporting verb or
    preceded by a reporting phrase; the nearest mention holds it.  claims: (claim_id, article_id,
    text_source, start_offset, end_offset, sentence_index); mentions: (mention_id, article_id,
    entity_id, text_source, start_offset, end_offset)."""
    spans = evidence_spans(claims, articles)
    m = mentions.select("article_id", "text_source", "mention_id", "entity_id", F.col("start_offset").alias("m_start"), F.col("end_offset").alias("m_end"))
    inside = spans.join(m, ["article_id", "text_source"]).where((F.col("m_start") >= F.col("evidence_start")) & (F.col("m_end") <= F.col("evidence_end")))
    at, end = F.col("m_start") - F.col("evidence_start"), F.col("m_end") - F.col("evidence_start")
    before = F.substring("evidence_text", F.greatest(F.lit(0), at - BEFORE) + 1, F.least(at, F.lit(BEFORE)))
    after = F.regexp_replace(F.substring("evidence_text", end + 1, F.lit(AFTER)), r"^[ \t,:;\-–—]+", "")
    says = after.rlike(rf"(?iU)^(?:{REPORT_VERB})\b") | before.rlike(rf"(?iU){REPORT_PREFIX}")
    distance = F.least(F.abs(F.col("m_start") - F.col("start_offset")), F.abs(F.col("m_end") - F.col("end_offset")))
    near = F.struct(distance.alias("d"), "m_start", F.col("entity_id").cast("string").alias("e"), F.col("mention_id").cast("string").alias("i"))
    holder = inside.where(says).groupBy("claim_id").agg(F.min(near).alias("h"))
    rows = spans.join(holder, "claim_id", "left")
    kind = F.when(F.col("h").isNull(), "unattributed").when(F.col("evidence_text").rlike(QUOTES), "quoted").otherwise("reported")
    sure = F.when(F.col("kind") == "quoted", 0.88).when(F.col("kind") == "reported", 0.82).otherwise(0.68)
    return rows.withColumn("kind", kind).select("claim_id", "article_id", "kind", F.col("h.i").alias("holder_mention_id"), F.col("h.e").alias("holder_entity_id"), "evidence_text", "text_source", "evidence_start", "evidence_end", sure.alias("confidence"))


def agency_provenance(articles: DataFrame) -> DataFrame:
    """Upstream agency that provider metadata or, failing that, the byline names; none if they
    disagree.  articles: (article_id, author, provider)."""
    rows = articles.withColumns({"_p": T.column("agency", "provider"), "_a": T.column("agency", "author")})
    rows = rows.where((F.col("_p").isNotNull() | F.col("_a").isNotNull()) & F.coalesce(F.col("_p") == F.col("_a"), F.lit(True)))
    own = F.col("_p").isNotNull()
    return rows.select("article_id", F.coalesce("_p", "_a").alias("source_slug"), F.when(own, "provider_metadata").otherwise("byline").alias("method"), F.when(own, 0.95).otherwise(0.90).alias("confidence"), F.when(own, F.col("provider")).otherwise(F.col("author")).alias("evidence"))


def stale_embeddings(articles: DataFrame, vectors: DataFrame, model: str, dimension: int) -> DataFrame:
    """Articles whose vector is missing or of another model, text or size."""
    rows = articles.join(vectors, "article_id", "left")
    fresh = F.col("embedding").isNotNull() & (F.col("model") == model) & (F.col("embedded_hash") == F.col("content_hash")) & (F.size("embedding") == dimension)
    return rows.where(~F.coalesce(fresh, F.lit(False))).select("article_id")


def role_decided_by(own: Column, of_feed: Column) -> Column:
    """What decides the effective role: the article's own one, else its feed's, else its source's."""
    return F.when(own.isNotNull(), "article").when(of_feed.isNotNull(), "feed").otherwise("source")
