"""Relational query shapes over the news model, as templates that Catalyst plans as a whole.

Keys are the inventory's ids.  Every aggregate carries a name; times are seconds since the epoch
and "now" is a literal, so results don't depend on when they are asked for."""

from __future__ import annotations

NOW = 1704067200 + 30 * 86400

SQL: dict[str, str] = {
    # -- filters and projections
    "flt1_eligible": "SELECT source_id, language_code, count(*) AS n FROM {eligible} GROUP BY source_id, language_code",
    "flt2_search_eligible": "SELECT a.article_id, f.source_id FROM {articles} a JOIN {feeds} f ON a.feed_id = f.feed_id WHERE NOT a.deleted AND f.active AND a.content_hash IS NOT NULL",
    "flt3_language": "SELECT language_code, count(*) AS n FROM {eligible} WHERE language_code = 'de' OR language_code LIKE 'de-%' GROUP BY language_code",
    "flt4_trimmed_language": "SELECT article_id FROM {eligible} WHERE lower(trim(language_code)) = 'fr'",
    "flt5_date_range": "SELECT article_id, time_s FROM {eligible} WHERE time_s BETWEEN 1704067200 + 3600 AND 1704067200 + 36000",
    "flt6_substring": "SELECT DISTINCT entity FROM {entities} WHERE entity ILIKE '%th%'",
    "flt7_distinct_from": "SELECT article_id FROM {articles} WHERE own_role IS DISTINCT FROM 'signal' AND published_s IS DISTINCT FROM time_s",
    "flt8_due_feeds": f"SELECT feed_id, priority FROM {{feeds}} WHERE active AND (last_fetched_s IS NULL OR last_fetched_s + fetch_interval_minutes * 60 <= {1704067200 + 7200})",
    "flt10_stale": """SELECT a.article_id, CASE WHEN p.article_id IS NULL THEN 'unprocessed' WHEN p.content_hash <> a.content_hash THEN 'identity' WHEN p.done_s < a.time_s THEN 'freshness' END AS reason
        FROM {articles} a LEFT JOIN (SELECT article_id, CASE WHEN article_id % 7 = 0 THEN 'x' ELSE content_hash END AS content_hash, time_s + 60 * (article_id % 3 - 1) AS done_s FROM {articles} WHERE article_id % 4 <> 1) p
          ON p.article_id = a.article_id
        WHERE p.article_id IS NULL OR p.content_hash IS DISTINCT FROM a.content_hash OR p.done_s < a.time_s""",
    "flt12_keyset": "SELECT story_id, article_id FROM {story_articles} WHERE time_s > 1704067200 + 6000 OR (time_s = 1704067200 + 6000 AND article_id > 100) ORDER BY time_s, article_id LIMIT 50",
    "flt13_confidence": "SELECT claim_id, group_id FROM {members} WHERE confidence >= 0.7 AND confidence <= 0.75",
    "flt14_current_generation": """SELECT DISTINCT c.story_id FROM {memberships} c
        WHERE EXISTS (SELECT 1 FROM {memberships} g WHERE g.story_id = c.story_id AND g.article_id % 3 = 0)
          AND NOT EXISTS (SELECT 1 FROM {memberships} o WHERE o.story_id = c.story_id AND o.deleted)""",
    "flt15_eligible_groups": """SELECT g.story_id, g.group_id, count(*) AS n FROM {members} g
        WHERE EXISTS (SELECT 1 FROM {members} r WHERE r.claim_id = g.group_id AND r.confidence >= 0.6)
          AND NOT EXISTS (SELECT 1 FROM {members} b WHERE b.group_id = g.group_id AND b.role = 'advocacy') GROUP BY g.story_id, g.group_id""",
    "flt16_read_model": "SELECT claim_id AS id, article_id AS article, source_id AS publisher, claim_text AS text, confidence AS score FROM {members}",
    # -- joins
    "j1_star": "SELECT m.story_id, a.article_id, f.feed_id, s.source_id, s.source_type FROM {memberships} m JOIN {articles} a ON a.article_id = m.article_id JOIN {feeds} f ON f.feed_id = a.feed_id JOIN {sources} s ON s.source_id = f.source_id WHERE NOT m.deleted",
    "j2_chain": """SELECT g.group_id, c.claim_id, a.article_id, s.source_id FROM (SELECT DISTINCT story_id, group_id FROM {members}) g
        JOIN {members} c ON c.group_id = g.group_id AND c.story_id = g.story_id JOIN {articles} a ON a.article_id = c.article_id JOIN {feeds} f ON f.feed_id = a.feed_id
        JOIN {sources} s ON s.source_id = f.source_id JOIN {memberships} m ON m.story_id = g.story_id AND m.article_id = a.article_id WHERE NOT m.deleted""",
    "j3_left_residual": "SELECT a.article_id, p.kind FROM {eligible} a LEFT JOIN (SELECT article_id, min(kind) AS kind FROM {perspectives} WHERE kind <> 'unattributed' GROUP BY article_id) p ON p.article_id = a.article_id AND a.role = 'editorial'",
    "j4_exists": "SELECT e.article_id FROM {eligible} e WHERE EXISTS (SELECT 1 FROM {entities} n WHERE n.article_id = e.article_id AND n.entity LIKE 'th%')",
    "j5_not_exists": "SELECT a.article_id FROM {articles} a WHERE NOT EXISTS (SELECT 1 FROM {eligible} e WHERE e.article_id = a.article_id)",
    "j6_in_distinct": "SELECT story_id, count(*) AS n FROM {story_articles} WHERE story_id IN (SELECT DISTINCT story_id FROM {story_articles} WHERE source_type = 'NEWS') GROUP BY story_id",
    "j8_two_aliases": """SELECT l.story_id, l.claim_id AS left_claim, r.claim_id AS right_claim FROM {members} l JOIN {members} r
        ON l.story_id = r.story_id AND l.claim_key = r.claim_key AND l.claim_id < r.claim_id""",
    "j9_theta_pairs": "SELECT l.story_id, l.group_id AS left_group, r.group_id AS right_group FROM {members} l JOIN {members} r ON l.story_id = r.story_id AND l.group_id < r.group_id WHERE l.claim_id = l.group_id AND r.claim_id = r.group_id",
    "j10_composite": "SELECT a.story_id, a.article_id, b.n FROM {story_articles} a JOIN (SELECT story_id, language_code, count(*) AS n FROM {story_articles} GROUP BY story_id, language_code) b ON a.story_id = b.story_id AND a.language_code = b.language_code",
    "j11_two_roles": "SELECT e.article_id, p.source_type AS publisher_type, u.source_type AS upstream_type FROM {eligible} e JOIN {sources} p ON p.source_id = e.source_id JOIN {sources} u ON u.num = (e.num + 3) % 20",
    "j12_scalar": "SELECT e.article_id, (SELECT max(m.story_id) FROM {memberships} m WHERE m.article_id = e.article_id AND NOT m.deleted) AS story_id FROM {eligible} e",
    "j13_validity": """SELECT e.article_id, r.family FROM {eligible} e JOIN (SELECT num, family, CASE WHEN num % 2 = 0 THEN 1704067200 + num * 1000 END AS from_s, CASE WHEN num % 3 = 0 THEN 1704067200 + num * 3000 END AS to_s FROM {sources}) r ON r.num = e.num
        WHERE (e.published_s IS NOT NULL AND coalesce(r.from_s, e.published_s) <= e.published_s AND coalesce(r.to_s, e.published_s) >= e.published_s)
           OR (e.published_s IS NULL AND r.from_s IS NULL AND r.to_s IS NULL)""",
    "j16_alias_lookup": """WITH canon AS (SELECT entity, min(article_id) AS id FROM {entities} GROUP BY entity),
        alias AS (SELECT substr(entity, 1, 6) AS alias, min(id) AS id FROM canon GROUP BY substr(entity, 1, 6) HAVING count(DISTINCT id) = 1)
        SELECT DISTINCT w.word, coalesce(c.id, a.id) AS id FROM (SELECT DISTINCT CASE WHEN article_id % 2 = 0 THEN entity ELSE substr(entity, 1, 6) END AS word FROM {entities}) w
        LEFT JOIN canon c ON c.entity = w.word LEFT JOIN alias a ON a.alias = w.word""",
    "j18_lookup": "SELECT m.claim_id, s.country, p.holder FROM {members} m JOIN {sources} s ON s.source_id = m.source_id LEFT JOIN {perspectives} p ON p.claim_id = m.claim_id",
    # -- aggregation
    "agg1_story_summary": "SELECT story_id, language_code, count(*) AS articles, count(DISTINCT source_id) AS sources, min(time_s) AS first_s, max(time_s) AS last_s FROM {story_articles} GROUP BY story_id, language_code HAVING count(*) >= 2",
    "agg2_group_summary": "SELECT group_id, count(*) AS claims, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS sources FROM {members} GROUP BY group_id",
    "agg3_having_sources": "SELECT story_id, count(DISTINCT source_id) AS sources FROM {story_articles} GROUP BY story_id HAVING count(DISTINCT source_id) >= 3",
    "agg4_having_age": f"SELECT story_id FROM {{story_articles}} GROUP BY story_id HAVING max(time_s) < {1704067200 + 40000} - 7200 AND count(DISTINCT source_id) >= 2",
    "agg5_story_parts": """SELECT story_id, 'source' AS part, source_id AS name, count(*) AS n FROM {story_articles} GROUP BY story_id, source_id
        UNION ALL SELECT s.story_id, 'entity', e.entity, count(DISTINCT s.article_id) FROM {story_articles} s JOIN {entities} e ON e.article_id = s.article_id GROUP BY s.story_id, e.entity""",
    "agg6_entity_articles": "SELECT entity, count(DISTINCT article_id) AS articles, max(article_id) AS latest FROM {entities} GROUP BY entity",
    "agg7_total": "SELECT count(*) AS total FROM (SELECT article_id FROM {eligible} WHERE language_code = 'en') t",
    "agg9_consensus_label": """SELECT group_id, CASE WHEN count(DISTINCT CASE WHEN role IN ('editorial', 'expert_analysis') THEN source_id END) >= 2 THEN 'shared' ELSE 'single_source' END AS label FROM {members} GROUP BY group_id""",
    "agg11_coverage": """SELECT story_id, count(DISTINCT article_id) AS articles, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN role <> 'signal' THEN source_id END) AS content_sources,
        count(DISTINCT CASE WHEN role = 'signal' THEN source_id END) AS signal_sources, count(DISTINCT CASE WHEN role IN ('editorial', 'expert_analysis') THEN num END) AS independent FROM {story_articles} GROUP BY story_id""",
    "agg12_distributions": """SELECT story_id, source_type, count(DISTINCT source_id) AS n FROM {story_articles} GROUP BY story_id, source_type
        UNION ALL SELECT story_id, coverage_scope, count(DISTINCT source_id) FROM {story_articles} WHERE coverage_scope IS NOT NULL GROUP BY story_id, coverage_scope
        UNION ALL SELECT story_id, country, count(DISTINCT source_id) FROM {story_articles} WHERE country IS NOT NULL GROUP BY story_id, country""",
    "agg13_gaps": """WITH c AS (SELECT story_id, count(DISTINCT CASE WHEN role <> 'signal' THEN source_id END) AS content, count(DISTINCT CASE WHEN role = 'signal' THEN source_id END) AS signals,
          count(DISTINCT CASE WHEN role IN ('editorial', 'expert_analysis') THEN source_id END) AS independent FROM {story_articles} GROUP BY story_id)
        SELECT story_id, 'limited_independent_content_sources' AS gap, independent AS observed FROM c WHERE independent < 2
        UNION ALL SELECT story_id, 'signal_without_content_coverage', signals FROM c WHERE signals > 0 AND content = 0""",
    "agg14_missing": "SELECT story_id, group_id FROM {perspectives} GROUP BY story_id, group_id HAVING count(holder) = 0",
    "agg16_group_confidence": "SELECT group_id, min(confidence) AS confidence FROM {members} GROUP BY group_id",
    "agg17_story_language": "SELECT story_id, CASE WHEN count(DISTINCT coalesce(language_code, '-')) = 0 THEN NULL WHEN count(DISTINCT coalesce(language_code, '-')) = 1 THEN min(language_code) ELSE 'mul' END AS language FROM {story_articles} GROUP BY story_id",
    "agg18_quality_report": """SELECT 'articles' AS metric, count(*) AS n FROM {articles} UNION ALL SELECT 'eligible', count(*) FROM {eligible}
        UNION ALL SELECT 'deleted', count(*) FROM {articles} WHERE deleted UNION ALL SELECT 'blank_titles', count(*) FROM {articles} WHERE nullif(trim(title), '') IS NULL
        UNION ALL SELECT 'sources', count(DISTINCT source_id) FROM {eligible} UNION ALL SELECT 'stories', count(DISTINCT story_id) FROM {story_articles}
        UNION ALL SELECT 'claims', count(*) FROM {members} UNION ALL SELECT 'groups', count(DISTINCT group_id) FROM {members}
        UNION ALL SELECT 'attributed', count(holder) FROM {perspectives} UNION ALL SELECT 'embedded', count(*) FROM {embeddings}""",
    "agg21_outcomes": "SELECT user_id, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS succeeded, count(CASE WHEN event_type = 'error' THEN 1 END) AS failed, count(*) AS total FROM {events} GROUP BY user_id",
    "agg22_histogram": "SELECT label, count(*) AS n FROM {embeddings} GROUP BY label",
    "agg23_backfill": """SELECT count(CASE WHEN kind <> 'unattributed' THEN 1 END) AS detected, count(CASE WHEN kind = 'quoted' AND confidence > 0.7 THEN 1 END) AS changed,
        count(CASE WHEN holder IS NULL THEN 1 END) AS missing, count(CASE WHEN holder = 'e3' THEN 1 END) AS self_skipped FROM {perspectives}""",
    # -- windows
    "win1_story_rank": "SELECT story_id, article_id, @int(row_number() OVER (PARTITION BY story_id ORDER BY time_s DESC, article_id)) AS place FROM {story_articles}",
    "win2_newest_title": "SELECT story_id, title FROM (SELECT story_id, title, row_number() OVER (PARTITION BY story_id ORDER BY time_s DESC, article_id) AS k FROM {story_articles}) t WHERE k = 1",
    "win5_first_claim": "SELECT article_id, claim_key, claim_id FROM (SELECT article_id, claim_key, claim_id, row_number() OVER (PARTITION BY article_id, claim_key ORDER BY pos) AS k FROM {members}) t WHERE k = 1",
    "win6_top_claims": """SELECT article_id, claim_id, @int(row_number() OVER (PARTITION BY article_id ORDER BY pos)) AS place FROM
        (SELECT article_id, claim_id, pos, row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, pos) AS k FROM {members}) t WHERE k <= 30""",
    "win8_best_attribution": "SELECT group_id, holder, claim_id FROM (SELECT group_id, holder, claim_id, row_number() OVER (PARTITION BY group_id, holder, kind ORDER BY confidence DESC, claim_id) AS k FROM {perspectives} WHERE holder IS NOT NULL) t WHERE k = 1",
    "win11_german_title": "SELECT story_id, title FROM (SELECT story_id, title, row_number() OVER (PARTITION BY story_id ORDER BY time_s, article_id) AS k FROM {story_articles} WHERE trim(title) <> '' AND (language_code = 'de' OR language_code LIKE 'de-%')) t WHERE k = 1",
    # -- sorts, pages, sets
    "srt2_oldest": "SELECT article_id, title FROM {eligible} ORDER BY published_s ASC NULLS LAST, article_id LIMIT 20",
    "srt3_largest": "SELECT story_id, count(*) AS n FROM {story_articles} GROUP BY story_id ORDER BY n DESC, story_id LIMIT 25",
    "srt4_page": "SELECT article_id, t.pages FROM {eligible}, (SELECT @int(ceil(count(*) / 20.0)) AS pages FROM {eligible}) t ORDER BY time_s, article_id LIMIT 20 OFFSET 40",
    "srt5_round_robin": """SELECT story_id, article_id, place FROM (SELECT story_id, article_id, time_s, @int(row_number() OVER (PARTITION BY story_id ORDER BY time_s DESC, article_id)) AS place FROM {story_articles}) t
        ORDER BY place, time_s DESC, article_id LIMIT 250""",
    "srt11_budget": "SELECT article_id, total FROM (SELECT article_id, @int(sum(size) OVER (PARTITION BY lane ORDER BY article_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS total, row_number() OVER (PARTITION BY lane ORDER BY article_id) AS k FROM (SELECT article_id, length(body) AS size, source_id AS lane FROM {eligible}) s) t WHERE total <= 24000 OR k = 1",
    "set1_union_all": "SELECT 'article' AS kind, language_code, count(*) AS n FROM {articles} GROUP BY language_code UNION ALL SELECT 'claim', language_code, count(*) FROM {members} GROUP BY language_code",
    "set2_union": "SELECT source_id FROM {eligible} WHERE language_code = 'de' UNION SELECT source_id FROM {eligible} WHERE language_code = 'fr'",
    "set3_distinct": "SELECT DISTINCT language_code, role FROM {eligible}",
    "set4_difference": "SELECT article_id FROM {articles} EXCEPT SELECT article_id FROM {eligible}",
    # -- scalars
    "c1_article_time": "SELECT article_id, coalesce(published_s, time_s) AS at_s FROM {articles}",
    "c3_slot": "SELECT article_id, @floor(time_s / 900) AS slot FROM {articles}",
    "c10_roles": "SELECT article_id, role FROM {eligible}",
    "c11_independent": "SELECT article_id, role IN ('editorial', 'expert_analysis') AS independent FROM {eligible}",
    "c12_enum_order": "SELECT claim_id, kind, CASE kind WHEN 'quoted' THEN 0 WHEN 'reported' THEN 1 ELSE 2 END AS place FROM {perspectives}",
    "c13_sorted_ids": "SELECT story_id, @set(source_id) AS sources, @set(language_code) AS languages FROM {story_articles} GROUP BY story_id",
    "c20_country_check": "SELECT source_id, country IN ('DE', 'AT', 'CH') AS known FROM {sources} WHERE country IS NOT NULL",
    "str10_first_text": "SELECT article_id, coalesce(nullif(trim(title), ''), nullif(trim(body), '')) AS text FROM {articles}",
    "str22_quotes": "SELECT claim_id FROM {members} WHERE @matches(claim_text, '[\"“”„«»]')",
    "str25_identity": "SELECT article_id, @sha(concat('guid', coalesce(title, ''))) AS identity, content_hash FROM {articles}",
    # -- writes, as the rows they would write
    "snk6_delete_ineligible": "SELECT a.article_id FROM {articles} a WHERE a.content_hash IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {eligible} e WHERE e.article_id = a.article_id)",
    "snk7_orphans": "SELECT m.story_id FROM {memberships} m GROUP BY m.story_id HAVING count(CASE WHEN NOT m.deleted THEN 1 END) = 0 UNION SELECT m.story_id FROM {memberships} m LEFT JOIN {eligible} e ON e.article_id = m.article_id GROUP BY m.story_id HAVING count(e.article_id) <= 1",
    "snk14_backfill": "SELECT a.article_id, CASE WHEN s.source_type = 'SIGNAL' THEN 'signal' WHEN s.source_type = 'PRIMARY_SOURCE' THEN 'primary_evidence' ELSE coalesce(f.default_role, 'editorial') END AS role FROM {articles} a JOIN {feeds} f ON f.feed_id = a.feed_id JOIN {sources} s ON s.source_id = f.source_id WHERE a.own_role IS NULL",
    # -- read views
    "rd2_stories": "SELECT s.story_id, s.articles, s.sources, t.title FROM (SELECT story_id, count(*) AS articles, count(DISTINCT source_id) AS sources, max(time_s) AS last_s FROM {story_articles} GROUP BY story_id ORDER BY last_s DESC, story_id LIMIT 20) s JOIN (SELECT story_id, title, row_number() OVER (PARTITION BY story_id ORDER BY time_s DESC, article_id) AS k FROM {story_articles}) t ON t.story_id = s.story_id AND t.k = 1",
    "rd4_article_entities": "SELECT article_id, @set(entity) AS entities FROM {entities} GROUP BY article_id",
    "rd7_perspectives": "SELECT story_id, claim_id, kind, holder, source_id FROM {perspectives} WHERE kind = 'quoted' AND holder IN ('e1', 'e2', 'e3')",
    "rd7_by_article": "SELECT article_id, claim_id, kind, holder, @int(row_number() OVER (PARTITION BY article_id ORDER BY confidence DESC, claim_id)) AS place FROM {perspectives} WHERE holder IS NOT NULL",
    "rd7_by_claim": "SELECT claim_id, kind, holder, source_id, confidence FROM {perspectives} WHERE confidence >= 0.7 AND kind <> 'unattributed'",
    "rd7_by_story": "SELECT story_id, kind, holder, count(*) AS n, count(DISTINCT source_id) AS sources, max(confidence) AS best FROM {perspectives} WHERE holder IS NOT NULL GROUP BY story_id, kind, holder",
    "rd14_source_detail": "SELECT s.source_id, s.source_type, s.country, count(DISTINCT f.feed_id) AS feeds, count(DISTINCT a.article_id) AS articles, max(a.time_s) AS last_s FROM {sources} s LEFT JOIN {feeds} f ON f.source_id = s.source_id AND f.active LEFT JOIN {articles} a ON a.feed_id = f.feed_id AND NOT a.deleted GROUP BY s.source_id, s.source_type, s.country",
    "rd8_groups": "SELECT story_id, group_id, count(*) AS claims, count(DISTINCT source_id) AS sources, min(confidence) AS confidence FROM {members} GROUP BY story_id, group_id HAVING count(*) >= 2",
    "rd11_coverage": "SELECT story_id, count(DISTINCT source_id) AS sources, count(DISTINCT country) AS countries, count(DISTINCT coverage_scope) AS scopes FROM {story_articles} GROUP BY story_id",
    "rd14_sources": "SELECT s.source_id, s.source_type, count(f.feed_id) AS feeds FROM {sources} s LEFT JOIN {feeds} f ON f.source_id = s.source_id AND f.active GROUP BY s.source_id, s.source_type",
    "sup1_story_exists": "SELECT DISTINCT m.story_id FROM {memberships} m WHERE NOT m.deleted AND EXISTS (SELECT 1 FROM {eligible} e WHERE e.article_id = m.article_id)",
    "sup2_representatives": "SELECT DISTINCT g.group_id FROM {members} g WHERE EXISTS (SELECT 1 FROM {members} r WHERE r.claim_id = g.group_id AND r.role <> 'signal')",
    "sup3_membership_order": "SELECT story_id, article_id, source_id, @int(row_number() OVER (PARTITION BY story_id ORDER BY time_s, article_id)) AS place FROM {story_articles}",
    "sup12_pair_order": "SELECT story_id, least(a, b) AS left_group, greatest(a, b) AS right_group FROM (SELECT l.story_id, l.group_id AS a, r.group_id AS b FROM {members} l JOIN {members} r ON l.story_id = r.story_id AND l.group_id <> r.group_id WHERE l.claim_id = l.group_id AND r.claim_id = r.group_id) t GROUP BY story_id, least(a, b), greatest(a, b)",
    "sup24_duplicates": "SELECT lower(title) AS name, count(*) AS n FROM {articles} WHERE title IS NOT NULL GROUP BY lower(title) HAVING count(*) > 1",
    "sup28_by_feed": "SELECT feed_id, article_id FROM (SELECT feed_id, article_id, row_number() OVER (PARTITION BY feed_id ORDER BY time_s DESC, article_id) AS k FROM {articles} WHERE NOT deleted) t WHERE k <= 10",
}
# generic shapes over the order tables
SQL |= {
    "tpch_q1": """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
        round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM {lineitem} WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus""",
    "tpch_q3": """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' GROUP BY l_orderkey ORDER BY revenue DESC, l_orderkey LIMIT 10""",
    "tpch_q5": """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM {customer} JOIN {orders} ON c_custkey = o_custkey JOIN {lineitem} ON l_orderkey = o_orderkey
        JOIN {supplier} ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey GROUP BY n_name""",
    "tpch_q6": "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM {lineitem} WHERE l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24",
    "rollup_orders": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "cube_events": "SELECT event_type, user_id % 3 AS shard, count(*) AS n FROM {events} GROUP BY CUBE (event_type, user_id % 3)",
}
