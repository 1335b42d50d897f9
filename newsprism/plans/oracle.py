"""The news model's derivations in ANSI SQL, for the comparison with another engine."""

from __future__ import annotations

PARTS = {
    "sources": """SELECT source_id, num,
      list_extract(['NEWS','AGENCY','REGIONAL','ALTERNATIVE','PRIMARY_SOURCE','NGO','INTEREST_GROUP','COMPANY','ACADEMIC','THINK_TANK','SIGNAL'], (num % 11 + 1)::INT) AS source_type,
      num % 9 <> 4 AS active, CASE num % 4 WHEN 0 THEN 'DE' WHEN 1 THEN 'AT' WHEN 2 THEN 'CH' END AS country,
      CASE num % 3 WHEN 0 THEN 'NATIONAL' WHEN 1 THEN 'REGIONAL' END AS coverage_scope, num // 4 AS family
    FROM (SELECT DISTINCT source AS source_id, try_cast(substr(source, 4) AS BIGINT) AS num FROM documents WHERE source IS NOT NULL)""",
    "feeds": """SELECT 'f' || source_id AS feed_id, source_id, num % 13 <> 5 AS active,
      CASE WHEN num % 5 = 0 THEN 'signal' WHEN num % 5 = 1 THEN 'expert_analysis' END AS default_role,
      15 * (1 + num % 4) AS fetch_interval_minutes, num % 3 AS priority,
      CASE WHEN num % 6 <> 0 THEN 1704067200 + num * 600 END AS last_fetched_s FROM sources""",
    "articles": """SELECT doc_id AS article_id, 'f' || source AS feed_id, lang AS language_code, split_part(text, chr(10), 1) AS title, text AS body,
      doc_id % 41 = 7 AS deleted, text IS NOT NULL AND doc_id % 37 <> 3 AS normalized,
      CASE WHEN doc_id % 29 = 0 THEN 'signal' WHEN doc_id % 29 = 1 THEN 'primary_evidence' END AS own_role,
      1704067200 + doc_id * 60 AS time_s, CASE WHEN doc_id % 5 <> 0 THEN 1704067200 + doc_id * 60 END AS published_s, sha256(text) AS content_hash
    FROM documents""",
    "eligible": """SELECT a.*, f.source_id, f.default_role, s.source_type, s.coverage_scope, s.country, s.num,
      coalesce(a.own_role, f.default_role, CASE WHEN s.source_type = 'PRIMARY_SOURCE' THEN 'primary_evidence' WHEN s.source_type IN ('NGO', 'INTEREST_GROUP', 'COMPANY') THEN 'advocacy'
        WHEN s.source_type IN ('ACADEMIC', 'THINK_TANK') THEN 'expert_analysis' WHEN s.source_type = 'SIGNAL' THEN 'signal' ELSE 'editorial' END) AS role
    FROM articles a JOIN feeds f USING (feed_id) JOIN sources s ON s.source_id = f.source_id
    WHERE NOT a.deleted AND a.normalized AND f.active AND s.active""",
    "memberships": "SELECT article_id - article_id % 4 AS story_id, article_id, time_s, article_id % 23 = 9 AS deleted FROM articles",
    "story_articles": "SELECT m.story_id, e.* FROM memberships m JOIN eligible e USING (article_id) WHERE NOT m.deleted",
    "claims": """SELECT article_id * 4294967296 + pos AS claim_id, article_id, pos, claim_text, lower(trim(claim_text)) AS claim_key, (60 + 5 * (pos % 5))::DOUBLE / 100 AS confidence
    FROM (SELECT article_id, unnest(string_split(body, chr(10))) AS claim_text, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM articles WHERE body IS NOT NULL)
    WHERE trim(claim_text) <> ''""",
    "members": """SELECT s.story_id, s.article_id, s.source_id, s.role, s.time_s, s.language_code, s.source_type, c.claim_id, c.pos, c.claim_text, c.claim_key, c.confidence,
      min(c.claim_id) OVER (PARTITION BY s.story_id, c.claim_key) AS group_id FROM story_articles s JOIN claims c USING (article_id)""",
    "perspectives": """SELECT story_id, claim_id, article_id, source_id, group_id, list_extract(['quoted', 'reported', 'unattributed'], (claim_id % 3 + 1)::INT) AS kind,
      CASE WHEN claim_id % 3 <> 2 THEN 'e' || (claim_id % 17) END AS holder, confidence FROM members""",
    "entities": "SELECT article_id, language_code, lower(entity) AS entity FROM (SELECT article_id, language_code, unnest(list_distinct(regexp_extract_all(title, '[A-Z][a-z]{3,}'))) AS entity FROM eligible)",
}
NEEDS = {"feeds": ["sources"], "eligible": ["sources", "feeds", "articles"], "memberships": ["articles"], "story_articles": ["memberships", "eligible"], "claims": ["articles"], "members": ["story_articles", "claims"], "perspectives": ["members"], "entities": ["eligible"]}


def prelude(names: set[str]) -> str:
    """CTEs for these tables and what they need, in order."""
    need = set(names) & set(PARTS)
    while True:
        more = need | {x for n in need for x in NEEDS.get(n, ())}
        if more == need:
            break
        need = more
    return ", ".join(f"{n} AS ({PARTS[n]})" for n in PARTS if n in need)
