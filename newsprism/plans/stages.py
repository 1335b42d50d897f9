"""Language, providers, and views over the stages of a debate, as queries with SQL of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.operators import language, providers
from newsprism.plans.composite import DENIAL, _DIFFER_SQL, _GROUPS_SQL, _SAID_SQL, _Stages, query
from newsprism.sources.model import Model
from newsprism.storage import stored

# -- language --------------------------------------------------------------------------------


@query(
    "str11_language",
    r"""WITH w AS (SELECT id, word, count(*) AS n FROM (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{M}]+')) AS word FROM documents WHERE text IS NOT NULL) GROUP BY id, word),
    lw AS (SELECT lang AS language, word, sum(n) AS n FROM w JOIN documents d ON d.doc_id = w.id WHERE lang IS NOT NULL GROUP BY lang, word),
    wg AS (SELECT word, unnest(list_transform(range(1, length(word) + 1), lambda i: substr(' ' || word || ' ', i, 3))) AS gram FROM (SELECT DISTINCT word FROM w)),
    g AS (SELECT language, gram, sum(n) AS n FROM lw JOIN wg ON wg.word = lw.word GROUP BY language, gram),
    t AS (SELECT language, sum(n) + 0.5 * ((SELECT count(DISTINCT gram) FROM g) + 1) AS low FROM g GROUP BY language),
    s AS (SELECT wg.word, t.language, sum(ln((coalesce(g.n, 0) + 0.5) / low)) AS score FROM wg CROSS JOIN t LEFT JOIN g ON g.language = t.language AND g.gram = wg.gram GROUP BY wg.word, t.language),
    b AS (SELECT w.id, s.language, row_number() OVER (PARTITION BY w.id ORDER BY sum(w.n * s.score) DESC, s.language) AS k FROM w JOIN s ON s.word = w.word GROUP BY w.id, s.language)
    SELECT doc_id AS id, language FROM documents LEFT JOIN b ON b.id = doc_id AND k = 1 AND length(text) >= 20""",
)
def _(m: Model) -> DataFrame:
    docs = m.table("documents").selectExpr("doc_id as id", "text", "lang as language")
    return language.detect(docs.select("id", "text"), language.train(docs))


# -- providers -------------------------------------------------------------------------------

_VECTOR_FAULTS = ("ok", "indexes", "not_finite", "empty_vector", "dimensions", "failed: ValueError", "ok")


def _vectors(texts: list[str]) -> list[dict]:
    """Stands for a provider of vectors; a text's length says how it fails."""
    (text,) = texts
    fault = _VECTOR_FAULTS[len(text) % len(_VECTOR_FAULTS)]
    if fault.startswith("failed"):
        raise ValueError("no answer")
    item = {"index": 1 if fault == "indexes" else 0, "embedding": [float(len(text)), 1.0]}
    item["embedding"] = {"not_finite": [float("nan"), 1.0], "empty_vector": [], "dimensions": [1.0]}.get(fault, item["embedding"])
    return [item]


@query("src15_vectors", f"SELECT article_id, list_extract([{', '.join(repr(x) for x in _VECTOR_FAULTS)}], (n % {len(_VECTOR_FAULTS)})::INT + 1) AS outcome, CASE WHEN n % {len(_VECTOR_FAULTS)} IN (0, 6) THEN n::DOUBLE END AS first FROM (SELECT article_id, length(coalesce(title, '')) AS n FROM {{eligible}})")
def _(m: Model) -> DataFrame:
    """Vectors of titles from a provider with planted faults: each fault is a row's outcome."""
    out = providers.embed(m.eligible.select(F.col("article_id").alias("id"), F.col("title").alias("text")), _vectors, dimensions=2, batch=1)
    return out.select(F.col("id").alias("article_id"), "outcome", F.get("embedding", F.lit(0)).alias("first"))


_DECISION_FAULTS = ("ok", "relation", "confidence", "pairs", "malformed")


def _decisions(pairs: list[dict]) -> dict:
    (pair,) = pairs
    fault = _DECISION_FAULTS[(int(pair["left_group"]) + int(pair["right_group"])) % len(_DECISION_FAULTS)]
    one = {"left_group": pair["right_group"], "right_group": pair["left_group"], "relation": "disputes", "confidence": 0.875, "reason": " by rule "}
    one |= {"relation": {"relation": "likes"}, "confidence": {"confidence": 2}, "pairs": {"left_group": "other"}, "malformed": {"confidence": True}}.get(fault, {})
    return {"decisions": [one]}


@query("src16_decisions", f"WITH {_SAID_SQL}, {_DIFFER_SQL} SELECT story_id, left_group, right_group, list_extract([{', '.join(repr(x) for x in _DECISION_FAULTS)}], ((left_group + right_group) % {len(_DECISION_FAULTS)})::INT + 1) AS outcome, CASE WHEN (left_group + right_group) % {len(_DECISION_FAULTS)} = 0 THEN 0.875 END::DOUBLE AS confidence FROM against")
def _(m: Model) -> DataFrame:
    """Contradictions put to a classifier with planted faults."""
    pairs = _Stages(m).relations.select("story_id", F.col("left_group").cast("string").alias("left_group"), F.col("right_group").cast("string").alias("right_group"))
    out = providers.classify(pairs, _decisions, ["disputes", "unrelated"], batch=1)
    return out.select("story_id", F.col("left_group").cast("bigint").alias("left_group"), F.col("right_group").cast("bigint").alias("right_group"), "outcome", "confidence")


# -- views of a debate -----------------------------------------------------------------------


@query(
    "rd8_relations",
    f"""WITH RECURSIVE {_GROUPS_SQL}, {_DIFFER_SQL}, both_ AS (SELECT story_id, left_group AS group_id, right_group AS other FROM against UNION SELECT story_id, right_group, left_group FROM against)
    SELECT g.story_id, g.group_id, g.claims, g.evidence_sources, any_value(x.claim_text) AS head, count(DISTINCT b.other) AS against, min(b.other) AS first_other FROM g JOIN both_ b ON b.story_id = g.story_id AND b.group_id = g.group_id
    JOIN said x ON x.story_id = g.story_id AND x.claim_id = g.group_id GROUP BY g.story_id, g.group_id, g.claims, g.evidence_sources""",
)
def _(m: Model) -> DataFrame:
    """Groups that others contradict: the text of their first claim, their counts, and who is against."""
    t = _Stages(m)
    found = t.differences.select("story_id", F.explode(F.array(F.struct(F.col("left_group").alias("group_id"), F.col("right_group").alias("other")), F.struct(F.col("right_group").alias("group_id"), F.col("left_group").alias("other")))).alias("r")).select("story_id", "r.*")
    sides = found.groupBy("story_id", "group_id").agg(F.countDistinct("other").alias("against"), F.min("other").alias("first_other"))
    sides = stored(t.groups.select("story_id", "group_id", "claims", "evidence_sources").join(sides, ["story_id", "group_id"]), "sides")
    # the text of their first claim, which a denial has with a word before it
    head = F.when(F.col("group_id") >= DENIAL, F.concat(F.lit("Not "), "claim_text")).otherwise(F.col("claim_text"))
    texts = sides.withColumn("claim_id", F.pmod("group_id", F.lit(DENIAL))).join(m.claims.select("claim_id", "claim_text"), "claim_id")
    return texts.withColumn("head", head).drop("claim_id", "claim_text")


@query(
    "rd9_by_kind",
    f"""WITH {_SAID_SQL}, k AS (SELECT m.*, CASE WHEN claim_id % 3 = 0 THEN 'direct_quote' WHEN regexp_matches(lower(coalesce(a.title, '') || chr(10) || left(a.body, 1000)), 'press release|pressemitteilung|news release|media release') THEN 'press_release' WHEN source_type = 'ACADEMIC' THEN 'study'
      WHEN source_type = 'PRIMARY_SOURCE' THEN CASE WHEN regexp_matches(claim_text, '(^|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}])[0-9]+($|[^\\p{{L}}\\p{{M}}\\p{{Nd}}\\p{{Nl}}\\p{{Pc}}])') THEN 'official_data' ELSE 'primary_source' END WHEN source_type IN ('NEWS', 'AGENCY', 'REGIONAL', 'ALTERNATIVE') THEN 'independent_reporting' ELSE 'context' END AS kind FROM said m JOIN {{articles}} a ON a.article_id = m.article_id)
    SELECT story_id, kind, count(*) AS items, count(DISTINCT source_id) AS sources, count(DISTINCT group_id) AS groups FROM k GROUP BY story_id, kind""",
)
def _(m: Model) -> DataFrame:
    """Evidence of a story by its kinds: quotes, releases, studies, data, reporting, context."""
    items = _Stages(m).items
    return items.groupBy("story_id", "kind").agg(F.count("*").alias("items"), F.countDistinct("source_id").alias("sources"), F.countDistinct("group_id").alias("groups"))


@query(
    "rd11_missing",
    f"""WITH RECURSIVE {_GROUPS_SQL}, {_DIFFER_SQL}, both_ AS (SELECT story_id, left_group AS group_id FROM against UNION SELECT story_id, right_group FROM against)
    SELECT g.story_id, count(*) AS missing, count(b.group_id) AS contradicted FROM g LEFT JOIN both_ b ON b.story_id = g.story_id AND b.group_id = g.group_id WHERE attributed = 0 GROUP BY g.story_id""",
)
def _(m: Model) -> DataFrame:
    """Groups of a story that nobody is named for, and how many of them others contradict."""
    gone = _Stages(m).missing
    return gone.groupBy("story_id").agg(F.count("*").alias("missing"), F.count(F.when(F.size("contradicted_by") > 0, 1)).alias("contradicted"))
