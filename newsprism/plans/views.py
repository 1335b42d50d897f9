"""Gates, plans, picks and paged views as queries, each with SQL of its own for the comparison.

Spark runs the operators; the SQL says what the rows must be, written apart from them.  Rules that
the model's tables satisfy by construction are shown on tables with planted faults."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.functions import text as T
from newsprism.operators import analysis, articles, catalog, gates, ranks, search, selection, states, terms, writes
from newsprism.plans.composite import query
from newsprism.sources.model import LINES, Model

NOW = 1704067200 + 30 * 86400
TOKEN = r"[\p{L}\p{N}](?:[\p{L}\p{N}_''’-]*[\p{L}\p{N}_])?"
_IN = lambda words: ", ".join(f"'{w}'" for w in sorted(words))

# -- text rules ------------------------------------------------------------------------------


@query("str13_negation", f"SELECT claim_id, len(list_filter(regexp_extract_all(lower(claim_text), '{TOKEN}'), lambda t: t IN ({_IN(T.NEGATIONS)}) OR ends_with(t, 'n''t'))) > 0 AS negative FROM {{claims}}")
def _(m: Model) -> DataFrame:
    return m.claims.select("claim_id", T.column("claim_features", "claim_text")["negative"].alias("negative"))


_MARKERS = ("(today|heute)", "(yesterday|gestern)", "(tomorrow|morgen)", r"(this\s+week|diese[rns]?\s+woche)", r"(next\s+week|nächste[nrsm]?\s+woche|naechste[nrsm]?\s+woche)", r"(last\s+week|letzte[nrsm]?\s+woche)")
_PLANTED = "CASE WHEN claim_id % 6 = 0 THEN 'Heute ' WHEN claim_id % 6 = 1 THEN 'said last  week: ' WHEN claim_id % 6 = 2 THEN 'next week, nächster Woche ' ELSE '' END || claim_text"


@query("str14_time_markers", "SELECT claim_id, " + " + ".join(f"CASE WHEN regexp_matches(t, '(?i)(^|[^\\p{{L}}\\p{{N}}_]){p}($|[^\\p{{L}}\\p{{N}}_])') THEN {1 << k} ELSE 0 END" for k, p in enumerate(_MARKERS)) + f" AS markers FROM (SELECT claim_id, {_PLANTED} AS t FROM {{claims}})")
def _(m: Model) -> DataFrame:
    return m.claims.withColumn("t", F.expr(_PLANTED)).select("claim_id", T.column("time_markers", "t").alias("markers"))


@query(
    "agg15_terms",
    """WITH w AS (SELECT article_id, regexp_extract_all(lower(title), '[\\p{L}\\p{M}]+') AS w FROM {eligible})
    SELECT article_id, term, count(*) AS n FROM (SELECT article_id, unnest(w) AS term FROM w UNION ALL
      SELECT article_id, w[i] || ' ' || w[i + 1] FROM (SELECT article_id, w, unnest(range(1, len(w))) AS i FROM w)) GROUP BY article_id, term""",
)
def _(m: Model) -> DataFrame:
    return terms.term_counts(m.eligible, "article_id", "title")


@query("str26_context", """SELECT claim_id, CASE WHEN body = '' THEN nullif(title, '') WHEN title <> '' AND x <> '' THEN title || chr(10) || chr(10) || x ELSE coalesce(nullif(title, ''), nullif(x, '')) END AS context
    FROM (SELECT c.claim_id, coalesce(a.title, '') AS title, a.body, trim(substr(a.body, greatest(c.pos * 7 - 280, 0) + 1, least(length(a.body), c.pos * 7 + length(c.claim_text) + 280) - greatest(c.pos * 7 - 280, 0)), ' ' || chr(9) || chr(10)) AS x
      FROM {claims} c JOIN {articles} a ON a.article_id = c.article_id WHERE c.pos * 7 < length(a.body))""")
def _(m: Model) -> DataFrame:
    rows = m.claims.withColumns({"start_offset": F.col("pos") * 7, "end_offset": F.col("pos") * 7 + F.length("claim_text")}).drop("claim_key", "confidence")
    rows = rows.join(m.articles.select("article_id", "title", "body"), "article_id").where("start_offset < length(body)")
    return rows.select("claim_id", context_excerpt("title", "body").alias("context"))


def context_excerpt(title: str, body: str, around: int = 280):
    """The text around a claim's span, after the title."""
    begin = F.greatest(F.lit(0), F.col("start_offset") - around)
    end = F.least(F.length(body), F.greatest("end_offset", "start_offset") + around)
    text = F.regexp_replace(F.substring(F.col(body), (begin + 1).cast("int"), (end - begin).cast("int")), r"^[ \t\n]+|[ \t\n]+$", "")
    head = F.coalesce(title, F.lit(""))
    both = F.when((head != "") & (text != ""), F.concat(head, F.lit("\n\n"), text)).otherwise(F.coalesce(F.nullif(head, F.lit("")), F.nullif(text, F.lit(""))))
    return F.when(F.coalesce(body, F.lit("")) == "", F.nullif(head, F.lit(""))).otherwise(both)


def _hinted(m: Model) -> DataFrame:
    names = ("negated", "numbers", "disputes")
    return m.members.select("story_id", "claim_id", "source_id", "confidence", *(c.alias(n) for n, c in zip(names, selection.hint_features(F.col("claim_text")), strict=True)))


def _hint_pairs(m: Model) -> DataFrame:
    names = ("claim_id", "source_id", "confidence", "negated", "numbers", "disputes")
    rows = _hinted(m)
    left, right = (rows.select("story_id", *(F.col(n).alias(f"{s}_{n}") for n in names)) for s in "ab")
    pairs = left.join(right, "story_id").where("a_claim_id < b_claim_id and a_source_id <> b_source_id")
    return pairs.select("story_id", "a_claim_id", "b_claim_id", selection.conflict_hint("a", "b").alias("hint"), F.greatest("a_confidence", "b_confidence").alias("score"))


_HINT_SQL = f"""WITH h AS (SELECT story_id, claim_id, source_id, confidence, len(list_intersect(w, [{_IN(selection.HINT_NEGATIONS)}])) > 0 AS neg, len(list_intersect(w, [{_IN(selection.HINT_DISPUTES)}])) > 0 AS disp, num
      FROM (SELECT *, regexp_extract_all(lower(claim_text), '[\\p{{L}}\\p{{N}}]+') AS w, list_sort(list_distinct(regexp_extract_all(lower(claim_text), '[0-9]+(?:[.,][0-9]+)?'))) AS num FROM {{members}})),
    p AS (SELECT a.story_id, a.claim_id AS a_claim_id, b.claim_id AS b_claim_id, CASE WHEN a.neg <> b.neg THEN 3 ELSE 0 END + CASE WHEN len(a.num) > 0 AND len(b.num) > 0 AND a.num <> b.num THEN 2 ELSE 0 END + CASE WHEN a.disp OR b.disp THEN 1 ELSE 0 END AS hint,
      greatest(a.confidence, b.confidence) AS score FROM h a JOIN h b ON a.story_id = b.story_id AND a.claim_id < b.claim_id AND a.source_id <> b.source_id)"""


@query("str27_hint", f"{_HINT_SQL} SELECT story_id, hint, count(*) AS pairs FROM p GROUP BY story_id, hint")
def _(m: Model) -> DataFrame:
    return _hint_pairs(m).groupBy("story_id", "hint").agg(F.count("*").alias("pairs"))


@query(
    "clu11_conflict_rich",
    f"""{_HINT_SQL}, r AS (SELECT story_id, row_number() OVER (ORDER BY max(time_s) DESC, story_id) - 1 AS recency FROM {{story_articles}} GROUP BY story_id),
    b AS (SELECT p.*, row_number() OVER (PARTITION BY p.story_id ORDER BY hint DESC, score DESC) AS k, count(*) FILTER (WHERE hint > 0) OVER (PARTITION BY p.story_id) AS hinted, count(*) OVER (PARTITION BY p.story_id) AS pairs FROM p),
    o AS (SELECT b.story_id, hint > 0 AS lane, row_number() OVER (PARTITION BY hint > 0 ORDER BY hint DESC, score DESC, hinted DESC, pairs DESC, recency) AS k FROM b JOIN r ON r.story_id = b.story_id WHERE b.k = 1),
    n AS (SELECT count(*) FILTER (WHERE lane) AS h, count(*) FILTER (WHERE NOT lane) AS r FROM o WHERE k <= 21)
    SELECT story_id, CASE WHEN lane THEN 'hint' ELSE 'recall' END AS lane, row_number() OVER (ORDER BY lane DESC, k)::INT AS place FROM o, n WHERE k <= CASE WHEN lane THEN greatest(11, 21 - least(n.r, 21)) ELSE greatest(10, 21 - least(n.h, 21)) END""",
)
def _(m: Model) -> DataFrame:
    newest = m.story_articles.groupBy("story_id").agg(F.max("time_s").alias("t"))
    stories = ranks.numbered(newest, [F.desc("t"), F.col("story_id")], "recency").select("story_id", "recency")
    return selection.conflict_rich(_hint_pairs(m).withColumn("claim_score", F.col("score")), stories, 21)


@query("srt1_nulls", "SELECT article_id, published_s, row_number() OVER (ORDER BY published_s DESC NULLS LAST, article_id) AS place FROM {eligible} ORDER BY published_s DESC NULLS LAST, article_id LIMIT 100")
def _(m: Model) -> DataFrame:
    rows = ranks.first(m.eligible.select("article_id", "published_s"), [F.desc_nulls_last("published_s"), F.col("article_id")], 100)
    return rows.select("article_id", "published_s", (F.col("k") + 1).cast("bigint").alias("place"))


# -- picks -----------------------------------------------------------------------------------

_LANES_SQL = """WITH x AS (SELECT claim_id, claim_id % 997 = 0 AS hint, row_number() OVER (PARTITION BY claim_id % 997 = 0 ORDER BY confidence DESC, claim_id) AS k FROM {members}), n AS (SELECT least(count(*) FILTER (WHERE hint), 101) AS h, least(count(*) FILTER (WHERE NOT hint), 101) AS r FROM x)
    SELECT claim_id, CASE WHEN hint THEN 'hint' ELSE 'recall' END AS lane, row_number() OVER (ORDER BY hint DESC, k)::INT AS place FROM x, n WHERE k <= CASE WHEN hint THEN greatest(51, 101 - n.r) ELSE greatest(50, 101 - n.h) END"""


@query("srt8_two_lanes", _LANES_SQL)
def _(m: Model) -> DataFrame:
    rows = m.members.select("claim_id", "confidence")
    return selection.two_lanes(rows.where("claim_id % 997 = 0"), rows.where("claim_id % 997 <> 0"), [F.desc("confidence"), F.col("claim_id")], 101).select("claim_id", "lane", "place")


@query(
    "srt9_waves",
    """WITH x AS (SELECT article_id, article_id % 3 = 0 AS live, row_number() OVER (PARTITION BY article_id % 3 = 0 ORDER BY time_s, article_id) - 1 AS k FROM {eligible}),
    w AS (SELECT *, CASE WHEN live THEN k // 8 ELSE k // 2 END AS wave, CASE WHEN live THEN k % 8 ELSE k % 2 END AS i FROM x WHERE k < 97),
    o AS (SELECT *, row_number() OVER (ORDER BY wave, CASE WHEN wave = 9 AND i >= CASE WHEN live THEN 5 ELSE 2 END THEN 1 ELSE 0 END, live DESC, k) AS place FROM w)
    SELECT article_id, CASE WHEN live THEN 'live' ELSE 'stale' END AS lane, place::INT AS place FROM o WHERE place <= 97""",
)
def _(m: Model) -> DataFrame:
    rows = m.eligible.select("article_id", "time_s")
    return selection.waves(rows.where("article_id % 3 = 0"), rows.where("article_id % 3 <> 0"), [F.col("time_s"), F.col("article_id")], 10, 97).select("article_id", "lane", "place")


_STORIES_SQL = "SELECT story_id, max(time_s) AS t FROM {story_articles} GROUP BY story_id"


@query(
    "srt10_targets",
    f"""WITH s AS (SELECT story_id, row_number() OVER (ORDER BY t DESC, story_id) AS k, row_number() OVER (ORDER BY t, story_id DESC) AS b, count(*) OVER () AS n FROM ({_STORIES_SQL}))
    SELECT story_id, k::INT AS place FROM s WHERE k <= 9 OR n <= 12 AND k <= 12 UNION ALL SELECT story_id, (b + 9)::INT FROM s WHERE b <= 3 AND n > 12""",
)
def _(m: Model) -> DataFrame:
    rows = m.story_articles.groupBy("story_id").agg(F.max("time_s").alias("t"))
    return selection.newest_and_oldest(rows, [F.desc("t"), F.col("story_id")], [F.col("t"), F.desc("story_id")], 12).select("story_id", "place")


@query(
    "srt10_cohort",
    f"""WITH s AS (SELECT story_id, row_number() OVER (ORDER BY t DESC, story_id) - 1 AS k, count(*) OVER () - 5 AS older FROM ({_STORIES_SQL})),
    r AS (SELECT *, ((k - 5 - (1893 * 997) % greatest(older, 1)) % greatest(older, 1) + greatest(older, 1)) % greatest(older, 1) AS turn FROM s)
    SELECT story_id, (CASE WHEN k < 5 THEN k ELSE turn + 5 END + 1)::INT AS place FROM r WHERE k < 5 OR turn < 7""",
)
def _(m: Model) -> DataFrame:
    rows = m.story_articles.groupBy("story_id").agg(F.max("time_s").alias("t"))
    return selection.cohort(rows, [F.desc("t"), F.col("story_id")], 5, 7, 1893).select("story_id", F.col("place").cast("int").alias("place"))


_CUTS = (0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85)


@query(
    "agg20_threshold_sweep",
    """WITH v AS (SELECT l.label = r.label AS truth, list_cosine_similarity(l.embedding::DOUBLE[], r.embedding::DOUBLE[]) AS s FROM {memberships} a JOIN {memberships} b ON b.story_id = a.story_id AND a.article_id < b.article_id JOIN {embeddings} l ON l.article_id = a.article_id JOIN {embeddings} r ON r.article_id = b.article_id)
    SELECT cut, tp, fp, fn, tn, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END, 9) AS precision, round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 9) AS recall FROM (
      SELECT cut, count(*) FILTER (WHERE s >= cut AND truth) AS tp, count(*) FILTER (WHERE s >= cut AND NOT truth) AS fp, count(*) FILTER (WHERE s < cut AND truth) AS fn, count(*) FILTER (WHERE s < cut AND NOT truth) AS tn
      FROM v, (SELECT unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85])::DOUBLE AS cut) GROUP BY cut)""",
)
def _(m: Model) -> DataFrame:
    from newsprism.functions.similarity import cosine
    from newsprism.plans.composite import _sided, _story_pairs

    pairs = _story_pairs(m).join(_sided(m.embeddings, "a", va="embedding", la="label"), "a").join(_sided(m.embeddings, "b", vb="embedding", lb="label"), "b")
    rows = selection.threshold_sweep(pairs.select(cosine(F.col("va"), F.col("vb")).alias("score"), (F.col("la") == F.col("lb")).alias("truth")), _CUTS)
    return rows.withColumns({c: F.round(c, 9) for c in ("precision", "recall")})


# -- gates and validators --------------------------------------------------------------------


@query(
    "flt17_generation_gate",
    """WITH k AS (SELECT DISTINCT story_id, claim_id, 1 AS t FROM {members} UNION ALL SELECT DISTINCT story_id, claim_id, 2 FROM {perspectives} WHERE claim_id % 89 <> 0 UNION ALL SELECT DISTINCT story_id, claim_id + CASE WHEN claim_id % 83 = 0 THEN 1000000000000 ELSE 0 END, 3 FROM {members})
    SELECT story_id, count(DISTINCT claim_id) AS keys FROM k GROUP BY story_id HAVING count(*) = 3 * count(DISTINCT claim_id)""",
)
def _(m: Model) -> DataFrame:
    moved = m.members.select("story_id", F.expr("claim_id + CASE WHEN claim_id % 83 = 0 THEN 1000000000000 ELSE 0 END").alias("claim_id"))
    return gates.same_keys({"claims": m.members, "perspectives": m.perspectives.where("claim_id % 89 <> 0"), "evidence": moved}, "story_id", "claim_id")


@query("c15_validators", """SELECT 'confidence' AS rule, claim_id::VARCHAR AS key FROM {members} WHERE claim_id % 77 IN (0, 1, 2) UNION ALL SELECT 'a-b', claim_id::VARCHAR FROM {members} WHERE claim_id % 50 = 0 OR claim_id % 50 = 1""")
def _(m: Model) -> DataFrame:
    faulty = m.members.select("claim_id", F.expr("CASE claim_id % 77 WHEN 0 THEN double('NaN') WHEN 1 THEN 1.5 WHEN 2 THEN null ELSE confidence END").alias("confidence"), F.expr("CASE WHEN claim_id % 50 = 0 THEN -1 ELSE pos END").alias("a"), F.expr("CASE WHEN claim_id % 50 = 1 THEN pos ELSE pos + 3 END").alias("b"))
    return gates.ranges(faulty, "claim_id", ["confidence"], [("a", "b")]).select("rule", "key")


@query(
    "c16_partition",
    """WITH c AS (SELECT DISTINCT claim_id, group_id FROM {members})
    SELECT 'ungrouped' AS rule, claim_id::VARCHAR AS key FROM c WHERE claim_id % 101 = 0
    UNION ALL SELECT 'unknown_claim', (claim_id + 1000000000000)::VARCHAR FROM c WHERE claim_id % 103 = 0 AND claim_id % 101 <> 0
    UNION ALL SELECT 'in_several_groups', claim_id::VARCHAR FROM c WHERE claim_id % 107 = 0 AND claim_id % 101 <> 0
    UNION ALL SELECT 'representative_not_member', group_id::VARCHAR FROM (SELECT DISTINCT group_id FROM c) WHERE group_id % 101 = 0
    UNION ALL SELECT 'related_twice', group_id || '|' || (group_id + 1) FROM (SELECT DISTINCT group_id FROM c) WHERE group_id % 109 = 0
    UNION ALL SELECT 'related_to_itself', group_id || '|' || group_id FROM (SELECT DISTINCT group_id FROM c) WHERE group_id % 113 = 0
    UNION ALL SELECT DISTINCT 'unknown_group', (group_id + 1)::VARCHAR FROM c WHERE group_id % 109 = 0 AND group_id + 1 NOT IN (SELECT group_id FROM c)""",
)
def _(m: Model) -> DataFrame:
    claims = m.members.select("claim_id", "group_id").distinct()
    members = claims.where("claim_id % 101 <> 0")
    members = members.union(members.where("claim_id % 103 = 0").selectExpr("claim_id + 1000000000000", "group_id")).union(members.where("claim_id % 107 = 0").selectExpr("claim_id", "-1 as group_id"))
    groups = claims.select("group_id", F.col("group_id").alias("representative_id")).distinct()
    twice = groups.where("group_id % 109 = 0").selectExpr("group_id as left_group", "group_id + 1 as right_group")
    relations = twice.union(twice.select("right_group", "left_group")).union(groups.where("group_id % 113 = 0").select("group_id", "group_id"))
    return gates.partition(claims, members, groups, relations).select("rule", "key")


@query(
    "c17_perspectives",
    """SELECT 'missing' AS rule, claim_id::VARCHAR AS key FROM {perspectives} WHERE claim_id % 71 = 0
    UNION ALL SELECT 'several', claim_id::VARCHAR FROM {perspectives} WHERE claim_id % 73 = 0 AND claim_id % 71 <> 0
    UNION ALL SELECT 'holder', claim_id::VARCHAR FROM {perspectives}, (SELECT unnest([1, 2]) AS k) WHERE claim_id % 71 <> 0 AND claim_id % 79 = 0 AND kind <> 'unattributed' AND (k = 1 OR claim_id % 73 = 0)
    UNION ALL SELECT 'span', claim_id::VARCHAR FROM {perspectives}, (SELECT unnest([1, 2]) AS k) WHERE claim_id % 71 <> 0 AND claim_id % 83 = 0 AND (k = 1 OR claim_id % 73 = 0)""",
)
def _(m: Model) -> DataFrame:
    claims = m.perspectives.selectExpr("claim_id", "10 as start_offset", "20 as end_offset")
    rows = m.perspectives.where("claim_id % 71 <> 0").selectExpr("claim_id", "kind", "CASE WHEN claim_id % 79 <> 0 THEN holder END as holder", "8 as start_offset", "CASE WHEN claim_id % 83 = 0 THEN 19 ELSE 25 END as end_offset")
    return gates.perspectives(claims, rows.union(rows.where("claim_id % 73 = 0"))).select("rule", "key")


@query(
    "c18_evidence",
    """SELECT 'unlinked' AS rule, claim_id::VARCHAR AS key FROM {members} WHERE claim_id % 61 = 0 UNION ALL SELECT 'linked_twice', claim_id::VARCHAR FROM {members} WHERE claim_id % 67 = 0 AND claim_id % 61 <> 0
    UNION ALL SELECT 'wrong_group', claim_id::VARCHAR FROM {members} WHERE claim_id % 59 = 0 AND claim_id % 61 <> 0 UNION ALL SELECT 'wrong_group', claim_id::VARCHAR FROM {members} WHERE claim_id % 59 = 0 AND claim_id % 67 = 0 AND claim_id % 61 <> 0""",
)
def _(m: Model) -> DataFrame:
    items = m.members.selectExpr("claim_id as item", "claim_id")
    links = m.members.where("claim_id % 61 <> 0").selectExpr("claim_id as item", "CASE WHEN claim_id % 59 = 0 THEN -1 ELSE group_id END as group_id")
    return gates.evidence(items, links.union(links.where("item % 67 = 0")), m.members.select("group_id", "claim_id")).select("rule", "key")


_PAIRS_SQL = "SELECT DISTINCT story_id AS x, story_id + 1 AS y FROM {story_articles}"


@query(
    "c19_decisions",
    f"""WITH p AS ({_PAIRS_SQL}) SELECT 'undecided' AS rule, x || '|' || y AS key FROM p WHERE x % 16 = 0 UNION ALL SELECT 'unknown', (x - 9000000000) || '|' || y FROM p WHERE x % 24 = 4
    UNION ALL SELECT 'decided_twice', x || '|' || y FROM p WHERE x % 40 = 8 AND x % 16 <> 0 UNION ALL SELECT 'relation', x || '|' || y FROM p WHERE x % 28 = 12 AND x % 16 <> 0 UNION ALL SELECT 'relation', x || '|' || y FROM p WHERE x % 28 = 12 AND x % 16 <> 0 AND x % 40 = 8
    UNION ALL SELECT 'confidence', x || '|' || y FROM p WHERE x % 20 = 0 AND x % 16 <> 0""",
)
def _(m: Model) -> DataFrame:
    pairs = m.story_articles.selectExpr("story_id as left_group", "story_id + 1 as right_group").distinct()
    said = pairs.where("left_group % 16 <> 0").selectExpr("right_group as left_group", "left_group as right_group", "CASE WHEN left_group % 28 = 12 THEN 'maybe' ELSE 'disputes' END as relation", "CASE WHEN left_group % 20 = 0 THEN 1.5D ELSE 0.9D END as confidence")
    extra = pairs.where("left_group % 24 = 4").selectExpr("left_group - 9000000000", "right_group", "'disputes'", "0.9D")
    return gates.decisions(pairs, said.union(said.where("right_group % 40 = 8")).union(extra), ["disputes", "equivalent", "unrelated", "insufficient"]).select("rule", "key")


@query(
    "sup11_spans",
    """WITH l AS (SELECT article_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) - 1 AS pos FROM {articles} WHERE body IS NOT NULL),
    s AS (SELECT *, coalesce(sum(length(line) + 1) OVER (PARTITION BY article_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ FROM l)
    SELECT s.article_id * 4294967296 + pos AS claim_id, s.article_id FROM s JOIN {articles} a ON a.article_id = s.article_id WHERE trim(line) <> '' AND s.article_id % 7 = 0 AND substr('x' || body, start_ + 1, length(line)) <> line""",
)
def _(m: Model) -> DataFrame:
    """Claims with the spans of their lines, against texts of which every seventh was edited since."""
    lines = m.articles.select("article_id", F.posexplode(F.split("body", "\n")).alias("pos", "claim_text"))
    before = writes.Window.partitionBy("article_id").orderBy("pos").rowsBetween(writes.Window.unboundedPreceding, -1)
    spans = lines.withColumn("start_offset", F.coalesce(F.sum(F.length("claim_text") + 1).over(before), F.lit(0)).cast("int"))
    rows = spans.where("trim(claim_text) <> ''").withColumns({"claim_id": F.expr(f"article_id * {LINES} + pos"), "end_offset": F.col("start_offset") + F.length("claim_text")})
    edited = F.when(F.col("article_id") % 7 == 0, F.concat(F.lit("x"), "body")).otherwise(F.col("body"))
    return gates.spans_match(rows, m.articles.select("article_id", edited.alias("text")))


@query(
    "sup13_one_summary",
    """WITH g AS (SELECT DISTINCT group_id AS g FROM {members}) SELECT 'missing' AS rule, g::VARCHAR AS key FROM g WHERE g % 31 = 0 UNION ALL SELECT 'several', g::VARCHAR FROM g WHERE g % 37 = 0 AND g % 31 <> 0 UNION ALL SELECT 'unknown', (-g)::VARCHAR FROM g WHERE g % 41 = 0 AND g % 31 <> 0 AND g <> 0""",
)
def _(m: Model) -> DataFrame:
    groups = m.members.select("group_id").distinct()
    rows = groups.where("group_id % 31 <> 0")
    rows = rows.union(rows.where("group_id % 37 = 0")).union(rows.where("group_id % 41 = 0 and group_id <> 0").selectExpr("-group_id"))
    return gates.one_each(groups, rows, "group_id").select("rule", "key")


@query("c14_canonical_json", """SELECT article_id, '{"active":' || CASE WHEN deleted THEN 'false' ELSE 'true' END || ',"language":' || coalesce('"' || language_code || '"', 'null') || ',"terms":[' || article_id || ',' || time_s || '],"time":' || coalesce(published_s::VARCHAR, 'null') || '}' AS payload FROM {articles}""")
def _(m: Model) -> DataFrame:
    fields = {"time": F.col("published_s"), "language": F.col("language_code"), "active": ~F.col("deleted"), "terms": F.array("article_id", "time_s")}
    return m.articles.select("article_id", gates.canonical_json(fields).alias("payload"))


@query("sup17_input_hash", """SELECT article_id, sha256('{"hash":"' || content_hash || '","language":' || coalesce('"' || language_code || '"', 'null') || ',"version":"claims-v1"}') AS input_hash FROM {articles} WHERE content_hash IS NOT NULL""")
def _(m: Model) -> DataFrame:
    return m.articles.where("content_hash is not null").select("article_id", gates.input_hash("claims-v1", {"language": F.col("language_code"), "hash": F.col("content_hash")}).alias("input_hash"))


# -- catalogs and provenance -----------------------------------------------------------------


@query(
    "snk9_create_sources",
    """WITH w AS (SELECT source_id, num, CASE WHEN num % 5 = 0 THEN ' ' || upper(source_id) || ' ' ELSE 'New ' || num // 2 END AS name, CASE WHEN num % 7 = 0 THEN source_id ELSE 'slug-' || source_id END AS slug, 'https://x' || num % 11 AS url FROM {sources} WHERE num IS NOT NULL),
    k AS (SELECT *, lower(trim(name)) AS k FROM w)
    SELECT name, slug, CASE WHEN k IN (SELECT source_id FROM {sources}) OR (SELECT min(o.slug) FROM k o WHERE o.k = k.k) < slug THEN 'name_taken' WHEN slug IN (SELECT source_id FROM {sources}) THEN 'slug_taken'
      WHEN (SELECT min(o.slug) FROM k o WHERE o.url = k.url) < slug THEN 'url_taken' ELSE 'created' END AS outcome FROM k""",
)
def _(m: Model) -> DataFrame:
    have = m.sources.selectExpr("source_id as name", "source_id as slug", "concat('https://', source_id) as url")
    wanted = m.sources.where("num is not null").selectExpr("CASE WHEN num % 5 = 0 THEN concat(' ', upper(source_id), ' ') ELSE concat('New ', num div 2) END as name", "CASE WHEN num % 7 = 0 THEN source_id ELSE concat('slug-', source_id) END as slug", "concat('https://x', num % 11) as url")
    return catalog.create_sources(have, wanted)


@query(
    "snk12_family_plan",
    """WITH p AS (SELECT f.source_id AS parent, s.source_id AS member, f.active AND s.active AS ok, s.num % 4 = 1 AS had FROM {sources} f JOIN {sources} s ON s.family = f.family AND f.num % 4 = 0 AND s.num <> f.num)
    SELECT parent, member, CASE WHEN NOT ok THEN 'missing' WHEN had THEN 'no_change' ELSE 'create_relation' END AS action FROM p""",
)
def _(m: Model) -> DataFrame:
    families = m.sources.groupBy("family").agg(F.min(F.when(F.col("num") % 4 == 0, F.col("source_id"))).alias("parent"), F.collect_set(F.when(F.col("num") % 4 != 0, F.col("source_id"))).alias("members")).where("parent is not null")
    had = m.sources.where("num % 4 = 1").join(families.select("family", "parent"), "family").select("parent", F.col("source_id").alias("member"))
    return catalog.family_plan(families, m.sources.select(F.col("source_id").alias("slug"), "active"), had)


@query(
    "snk11_merge_plan",
    """WITH s AS (SELECT source_id AS slug, num, num % 3 = 0 AS n, num % 5 = 0 AS u, num % 7 = 0 AS o FROM {sources} WHERE num IS NOT NULL)
    SELECT slug || '-x' AS slug, 'conflict' AS action, 'missing' AS detail FROM s WHERE num % 11 = 0
    UNION ALL SELECT slug, 'canonicalize_source_name', slug || ' -> Canonical ' || num FROM s WHERE n AND num % 11 <> 0 UNION ALL SELECT slug, 'update_source_url', 'u' || num || ' -> v' || num FROM s WHERE u AND num % 11 <> 0
    UNION ALL SELECT slug, 'create_outlet', 'Paper' FROM s WHERE o AND num % 11 <> 0 UNION ALL SELECT slug, 'no_change', '' FROM s WHERE NOT n AND NOT u AND NOT o AND num % 11 <> 0""",
)
def _(m: Model) -> DataFrame:
    s = m.sources.where("num is not null")
    outlet = "array(named_struct('name', 'Site', 'category', 'online'), named_struct('name', 'Paper', 'category', 'print'))"
    specs = s.selectExpr("CASE WHEN num % 11 = 0 THEN concat(source_id, '-x') ELSE source_id END as slug", "CASE WHEN num % 3 = 0 THEN concat('Canonical ', num) ELSE source_id END as name", "CASE WHEN num % 5 = 0 THEN concat('v', num) ELSE concat('u', num) END as url", f"{outlet} as outlets")
    have = s.selectExpr("source_id as slug", "source_id as name", "concat('u', num) as url")
    outlets = s.selectExpr("source_id as slug", "' SITE ' as name", "'online' as category").union(s.where("num % 7 <> 0").selectExpr("source_id", "'paper'", "'print'"))
    return catalog.merge_plan(specs, have, outlets)


@query(
    "sup25_conflicts",
    """WITH e AS (SELECT source_id AS slug, num FROM {sources} WHERE num IS NOT NULL) SELECT slug, 'source_type' AS rule, 'NGO/' || source_type AS detail FROM e JOIN {sources} s ON s.source_id = e.slug WHERE e.num % 3 = 0 AND source_type <> 'NGO'
    UNION ALL SELECT slug, 'country', 'FR/' || coalesce(country, '-') FROM e JOIN {sources} s ON s.source_id = e.slug WHERE e.num % 5 = 0
    UNION ALL SELECT e.slug, 'feed_owner', o.source_id FROM e JOIN {sources} o ON o.num = e.num + 1 WHERE e.num % 7 = 0 UNION ALL SELECT e.slug, 'name', o.source_id FROM e JOIN {sources} o ON o.num = e.num + 2 WHERE e.num % 13 = 0""",
)
def _(m: Model) -> DataFrame:
    s = m.sources.where("num is not null")
    entries = s.selectExpr("source_id as slug", "CASE WHEN num % 13 = 0 THEN concat('SRC', num + 2) ELSE source_id END as name", "CASE WHEN num % 3 = 0 THEN 'NGO' ELSE source_type END as source_type", "CASE WHEN num % 5 = 0 THEN 'FR' ELSE country END as country", "CASE WHEN num % 7 = 0 THEN concat('https://f', num + 1) ELSE concat('https://f', num) END as feed_url")
    return catalog.catalog_conflicts(entries, s.selectExpr("source_id as slug", "source_id as name", "source_type", "country"), s.selectExpr("source_id as slug", "concat('https://f', num) as url"))


_AGENCY_SQL = "SELECT e.article_id, e.source_id, s.source_id AS up, s.active FROM {eligible} e LEFT JOIN {sources} s ON s.num = (e.article_id * 7) % 23"


@query("sup20_pending_provenance", f"SELECT article_id, up AS upstream_source_id, 'byline' AS method, 0.9 AS confidence FROM ({_AGENCY_SQL}) WHERE active AND up <> source_id AND article_id % 10 <> 3")
def _(m: Model) -> DataFrame:
    detected = m.eligible.select("article_id", F.concat(F.lit("src"), (F.col("article_id") * 7) % 23).alias("source_slug"), F.lit("byline").alias("method"), F.lit(0.9).alias("confidence"))
    stored_already = detected.where("article_id % 10 = 3").select("article_id", F.col("source_slug").alias("upstream_source_id"))
    return catalog.pending_provenance(detected, m.eligible, m.sources.withColumn("slug", F.concat(F.lit("src"), "num")), stored_already)


@query(
    "sup21_outcomes",
    """WITH w AS (SELECT doc_id AS id, doc_id AS article_id, 'src' || (doc_id % 25) AS up_source, CASE WHEN doc_id % 3 = 0 THEN doc_id - doc_id % 7 END AS up_article FROM {documents})
    SELECT w.id, CASE WHEN e.article_id IS NULL THEN 'no_article' WHEN s.source_id IS NULL THEN 'no_upstream_source' WHEN up_article IS NOT NULL AND u.article_id IS NULL THEN 'no_upstream_article' WHEN up_article IS NOT NULL AND u.source_id <> up_source THEN 'wrong_upstream_source'
      WHEN up_article = w.article_id THEN 'own_upstream' ELSE 'created' END AS outcome
    FROM w LEFT JOIN {eligible} e ON e.article_id = w.article_id LEFT JOIN {sources} s ON s.source_id = up_source AND s.active LEFT JOIN {eligible} u ON u.article_id = up_article""",
)
def _(m: Model) -> DataFrame:
    wanted = m.articles.selectExpr("article_id as id", "article_id", "concat('src', article_id % 25) as upstream_source_id", "CASE WHEN article_id % 3 = 0 THEN article_id - article_id % 7 END as upstream_article_id")
    return catalog.provenance_outcomes(wanted, m.eligible.select("article_id", "source_id"), m.sources)


def _provenance(m: Model) -> DataFrame:
    return m.eligible.where("article_id % 4 = 1").selectExpr("article_id as id", "article_id", "source_id", "concat('src', (num + 7) % 20) as upstream_source_id", "CASE article_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'rejected' END as status", "CASE WHEN article_id % 3 <> 1 THEN time_s END as reviewed_s", "time_s")


_PROVENANCE_SQL = "SELECT article_id AS id, article_id, source_id, 'src' || ((num + 7) % 20) AS upstream_source_id, CASE article_id % 3 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE 'rejected' END AS status, CASE WHEN article_id % 3 <> 1 THEN time_s END AS reviewed_s, time_s FROM {eligible} WHERE article_id % 4 = 1"


@query("rd15_review_queue", f"SELECT p.id, p.source_id, p.upstream_source_id, u.source_type AS upstream_type, row_number() OVER (ORDER BY p.time_s, p.id)::INT AS place FROM ({_PROVENANCE_SQL}) p JOIN {{sources}} u ON u.source_id = p.upstream_source_id WHERE status = 'pending' ORDER BY p.time_s, p.id LIMIT 50")
def _(m: Model) -> DataFrame:
    up = m.sources.select(F.col("source_id").alias("upstream_source_id"), F.col("source_type").alias("upstream_type"))
    rows = _provenance(m).where("status = 'pending'").join(up, "upstream_source_id").orderBy("time_s", "id").limit(50)
    return rows.select("id", "source_id", "upstream_source_id", "upstream_type", F.row_number().over(writes.Window.partitionBy(F.lit(0)).orderBy("time_s", "id")).alias("place"))


@query("sup21_review", f"SELECT id, CASE id % 5 WHEN 0 THEN 'verified' WHEN 1 THEN 'pending' ELSE status END AS status, CASE WHEN id % 5 = 0 AND status <> 'verified' THEN {NOW} WHEN id % 5 = 1 AND status <> 'pending' THEN NULL ELSE reviewed_s END AS reviewed_s FROM ({_PROVENANCE_SQL})")
def _(m: Model) -> DataFrame:
    rows = _provenance(m)
    decided = rows.where("id % 5 in (0, 1)").select("id", F.when(F.col("id") % 5 == 0, "verified").otherwise("pending").alias("new_status"))
    return catalog.reviewed(rows, decided, F.lit(NOW).cast("bigint"))


@query("sup22_provenance_list", f"SELECT article_id, id, status, row_number() OVER (PARTITION BY upstream_source_id ORDER BY status DESC, id)::INT AS place FROM ({_PROVENANCE_SQL})")
def _(m: Model) -> DataFrame:
    order = writes.Window.partitionBy("upstream_source_id").orderBy(F.desc("status"), "id")
    return _provenance(m).select("article_id", "id", "status", F.row_number().over(order).alias("place"))


@query("rd16_role", "SELECT article_id, own_role AS set_role, role AS effective_role, CASE WHEN own_role IS NOT NULL THEN 'article' WHEN default_role IS NOT NULL THEN 'feed' ELSE 'source' END AS decided_by FROM {eligible}")
def _(m: Model) -> DataFrame:
    by = articles.role_decided_by(F.col("own_role"), F.col("default_role"))
    return m.eligible.select("article_id", F.col("own_role").alias("set_role"), F.col("role").alias("effective_role"), by.alias("decided_by"))


# -- consensus counts ------------------------------------------------------------------------


@query(
    "agg8_consensus_counts",
    """WITH m AS (SELECT story_id, group_id, count(DISTINCT claim_id) AS claims, count(DISTINCT article_id) AS articles,
          count(DISTINCT CASE WHEN role IN ('editorial', 'expert_analysis') THEN source_id END) AS independent FROM {members} GROUP BY story_id, group_id),
        e AS (SELECT group_id, count(*) AS items, count(DISTINCT source_id) AS sources FROM {members} GROUP BY group_id),
        p AS (SELECT group_id, count(holder) AS attributed FROM {perspectives} GROUP BY group_id)
        SELECT m.story_id, m.group_id, m.claims, m.articles, m.independent, e.items AS evidence_items, e.sources AS evidence_sources, coalesce(p.attributed, 0) AS attributed
        FROM m JOIN e ON e.group_id = m.group_id LEFT JOIN p ON p.group_id = m.group_id""",
)
def _(m: Model) -> DataFrame:
    """Members, evidence and perspectives are views of one table here, so one aggregate counts all."""
    independent = F.countDistinct(F.when(F.col("role").isin("editorial", "expert_analysis"), F.col("source_id")))
    counts = {"claims": F.countDistinct("claim_id"), "articles": F.countDistinct("article_id"), "independent": independent, "evidence_items": F.count("*"), "evidence_sources": F.countDistinct("source_id"), "attributed": F.count("holder")}
    return m.voiced.groupBy("story_id", "group_id").agg(*(c.alias(n) for n, c in counts.items()))


# -- paged views -----------------------------------------------------------------------------


@query(
    "rd5_entities",
    """WITH n AS (SELECT entity, count(DISTINCT article_id) AS articles FROM {entities} WHERE entity ILIKE '%an%' GROUP BY entity)
    SELECT entity, articles, (SELECT count(*) FROM n) AS total FROM n ORDER BY articles DESC, entity LIMIT 20 OFFSET 20""",
)
def _(m: Model) -> DataFrame:
    names = m.entities.where("entity ilike '%an%'").groupBy("entity").agg(F.countDistinct("article_id").alias("articles"))
    page = names.orderBy(F.desc("articles"), "entity").offset(20).limit(20)
    return page.crossJoin(F.broadcast(names.agg(F.count("*").alias("total"))))  # one row


@query("agg6_latest", "SELECT entity, article_id, place FROM (SELECT entity, e.article_id, row_number() OVER (PARTITION BY entity ORDER BY time_s DESC, e.article_id)::INT AS place FROM (SELECT DISTINCT entity, article_id FROM {entities}) e JOIN {eligible} a ON a.article_id = e.article_id) WHERE place <= 10")
def _(m: Model) -> DataFrame:
    rows = m.entities.select("entity", "article_id").distinct().join(m.eligible.select("article_id", "time_s"), "article_id")
    return rows.withColumn("place", F.row_number().over(writes.Window.partitionBy("entity").orderBy(F.desc("time_s"), "article_id"))).where("place <= 10").select("entity", "article_id", "place")


_KIND_SQL = "CASE WHEN source_type = 'ACADEMIC' THEN 'study' WHEN source_type = 'PRIMARY_SOURCE' THEN 'primary' WHEN source_type IN ('NEWS', 'AGENCY', 'REGIONAL', 'ALTERNATIVE') THEN 'independent_reporting' ELSE 'context' END"


@query("rd9_evidence", f"SELECT story_id, group_id, claim_id, {_KIND_SQL} AS kind, row_number() OVER (PARTITION BY story_id ORDER BY confidence DESC, group_id, claim_id)::INT AS place FROM {{members}} WHERE confidence >= 0.7 QUALIFY place <= 50")
def _(m: Model) -> DataFrame:
    kind = F.when(F.col("source_type") == "ACADEMIC", "study").when(F.col("source_type") == "PRIMARY_SOURCE", "primary").when(F.col("source_type").isin("NEWS", "AGENCY", "REGIONAL", "ALTERNATIVE"), "independent_reporting").otherwise("context")
    order = writes.Window.partitionBy("story_id").orderBy(F.desc("confidence"), "group_id", "claim_id")
    return m.members.where("confidence >= 0.7").withColumn("place", F.row_number().over(order)).where("place <= 50").select("story_id", "group_id", "claim_id", kind.alias("kind"), "place")


_CONSENSUS_SQL = "SELECT story_id, group_id, count(DISTINCT claim_id) AS claims, count(DISTINCT source_id) AS sources, min(claim_text) AS claim_text, CASE WHEN count(DISTINCT CASE WHEN role IN ('editorial', 'expert_analysis') THEN source_id END) >= 2 THEN 'shared' ELSE 'single_source' END AS label FROM {members} GROUP BY story_id, group_id"


def _consensus(m: Model) -> DataFrame:
    independent = F.countDistinct(F.when(F.col("role").isin("editorial", "expert_analysis"), F.col("source_id")))
    label = F.when(independent >= 2, "shared").otherwise("single_source")
    return m.members.groupBy("story_id", "group_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("source_id").alias("sources"), F.min("claim_text").alias("claim_text"), label.alias("label"))


@query("rd10_consensus", f"SELECT story_id, group_id, claims, sources, claim_text, label, row_number() OVER (PARTITION BY story_id ORDER BY sources DESC, claims DESC, group_id)::INT AS place FROM ({_CONSENSUS_SQL}) QUALIFY place BETWEEN 11 AND 20")
def _(m: Model) -> DataFrame:
    order = writes.Window.partitionBy("story_id").orderBy(F.desc("sources"), F.desc("claims"), "group_id")
    return _consensus(m).withColumn("place", F.row_number().over(order)).where("place between 11 and 20")


@query("rd10_differences", f"WITH c AS ({_CONSENSUS_SQL}) SELECT story_id, group_id AS left_group, -group_id - 1 AS right_group, sources AS left_sources, 1 AS right_sources, claims AS left_claims, CASE WHEN group_id % 14 = 0 THEN 'contradiction' ELSE 'dispute' END AS kind FROM c WHERE group_id % 7 = 0")
def _(m: Model) -> DataFrame:
    """Planted denials of every seventh group: counts of both sides come from joins."""
    groups = _consensus(m).select("story_id", "group_id", "claims", "sources")
    denials = groups.where("group_id % 7 = 0").selectExpr("story_id", "-group_id - 1 as group_id", "1L as claims", "1L as sources")
    related = groups.where("group_id % 7 = 0").selectExpr("story_id", "-group_id - 1 as right_group", "group_id as left_group", "CASE WHEN group_id % 14 = 0 THEN 'contradiction' ELSE 'dispute' END as kind")
    rows = analysis.both_sides(related, groups.union(denials), ["claims", "sources"])
    return rows.select("story_id", "left_group", "right_group", "left_sources", F.col("right_sources").cast("int").alias("right_sources"), "left_claims", "kind")


# -- incremental processing ------------------------------------------------------------------


@query("snk8_search_upsert", "SELECT e.article_id, CASE WHEN e.article_id % 3 = 0 THEN 'insert' WHEN e.article_id % 7 = 0 THEN 'update' ELSE 'unchanged' END AS action FROM {eligible} e")
def _(m: Model) -> DataFrame:
    new = search.documents(m.eligible).select("article_id", "title", "document_hash")
    old = new.where("article_id % 3 <> 0").select("article_id", F.when(F.col("article_id") % 7 == 0, "old").otherwise(F.col("title")).alias("title"), F.when(F.col("article_id") % 7 == 0, "old").otherwise(F.col("document_hash")).alias("document_hash"))
    return writes.diff_upsert(old, new, ["article_id"], ["title", "document_hash"]).select("article_id", "action")


@query("st5_input_unchanged", "SELECT story_id FROM {members} GROUP BY story_id HAVING count(CASE WHEN claim_id % 997 = 0 THEN 1 END) = 0")
def _(m: Model) -> DataFrame:
    """Stories whose inputs still hash to what they did before the run: only their results are stored."""
    digest = lambda text: F.sha2(F.concat_ws("|", F.array_sort(F.collect_list(F.concat_ws(":", "claim_id", text)))), 256)
    before = m.members.groupBy("story_id").agg(digest(F.col("claim_key")).alias("hash"))
    after = m.members.groupBy("story_id").agg(digest(F.when(F.col("claim_id") % 997 == 0, "edited").otherwise(F.col("claim_key"))).alias("hash"))
    return states.unchanged_inputs(before, after, "story_id")


@query("st7_invalidated", "SELECT article_id, CASE WHEN article_id % 3 = 1 THEN NULL ELSE content_hash END AS processed_hash FROM {articles} WHERE content_hash IS NOT NULL")
def _(m: Model) -> DataFrame:
    """Processed identities after their upstream changed: a hash that no current row has is dropped."""
    rows = m.articles.where("content_hash is not null").select("article_id", F.when(F.col("article_id") % 3 == 1, F.sha2(F.lit("old"), 256)).otherwise(F.col("content_hash")).alias("processed_hash"))
    return states.invalidated(rows, m.articles.select("article_id", F.col("content_hash").alias("processed_hash")), "article_id", ["processed_hash"])


@query(
    "st8_changed_stories",
    """WITH t AS (SELECT m.story_id, max(greatest(a.time_s, m.time_s, coalesce(f.last_fetched_s, 0))) AS changed_s FROM {memberships} m JOIN {articles} a ON a.article_id = m.article_id LEFT JOIN {feeds} f ON f.feed_id = a.feed_id GROUP BY m.story_id)
    SELECT story_id FROM t WHERE story_id % 12 = 0 OR changed_s > 1704067200 + story_id * 60 + 100""",
)
def _(m: Model) -> DataFrame:
    """Stories of which a membership, article or feed changed since they were processed, or never were."""
    members = m.memberships.select("story_id", "article_id", F.col("time_s").alias("member_s"))
    articles = members.join(m.articles.select("article_id", "feed_id", "time_s"), "article_id")
    feeds = articles.join(m.feeds.select("feed_id", "last_fetched_s"), "feed_id")
    done = m.memberships.select("story_id").distinct().where("story_id % 12 <> 0").select("story_id", (F.col("story_id") * 60 + 1704067200 + 100).alias("done_s"))
    return states.changed_since([(members, "member_s"), (articles, "time_s"), (feeds, "last_fetched_s")], done, "story_id")


@query("st3_claimed", f"SELECT article_id, attempts + 1 AS attempts, {NOW + 300} AS lease_s FROM (SELECT article_id, article_id % 5 AS attempts, CASE article_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'running' WHEN 2 THEN 'failed' ELSE 'done' END AS state, {NOW} + (article_id % 9 - 4) * 60 AS lease_s FROM {{articles}}) WHERE state = 'pending' OR state = 'running' AND lease_s <= {NOW} OR state = 'failed' AND attempts < 4 AND lease_s <= {NOW}")
def _(m: Model) -> DataFrame:
    """What one gate claims: pending rows, expired leases, and failures that may be tried again."""
    rows = m.articles.selectExpr("article_id", "article_id % 5 as attempts", "CASE article_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'failed' ELSE 'succeeded' END as state", f"{NOW} + (article_id % 9 - 4) * 60 as until_s")
    return states.claim(rows, "w", NOW, 300, most=4).select("article_id", "attempts", F.col("until_s").alias("lease_s"))


@query("sup4_claims_in_order", "SELECT article_id, claim_id, row_number() OVER (PARTITION BY article_id ORDER BY pos, claim_id)::INT AS place FROM {claims}")
def _(m: Model) -> DataFrame:
    return m.claims.select("article_id", "claim_id", F.row_number().over(writes.Window.partitionBy("article_id").orderBy("pos", "claim_id")).alias("place"))


@query("sup5_candidate_stories", "SELECT DISTINCT s.story_id FROM {memberships} s WHERE NOT s.deleted AND s.story_id > 8 AND (EXISTS (SELECT 1 FROM {members} g WHERE g.story_id = s.story_id AND g.confidence >= 0.7) OR EXISTS (SELECT 1 FROM {perspectives} p WHERE p.story_id = s.story_id AND p.holder = 'e1')) ORDER BY s.story_id LIMIT 100")
def _(m: Model) -> DataFrame:
    some = m.members.where("confidence >= 0.7").select("story_id").union(m.perspectives.where("holder = 'e1'").select("story_id"))
    return m.memberships.where("not deleted and story_id > 8").select("story_id").distinct().join(some, "story_id", "left_semi").orderBy("story_id").limit(100)


@query("sup9_active_links", "SELECT m.group_id, m.claim_id, p.kind, p.holder FROM {members} m JOIN {perspectives} p ON p.claim_id = m.claim_id AND p.story_id = m.story_id WHERE m.confidence >= 0.65 AND p.kind <> 'unattributed'")
def _(m: Model) -> DataFrame:
    said = m.perspectives.where("kind <> 'unattributed'").select("story_id", "claim_id", "kind", "holder")
    return m.members.where("confidence >= 0.65").select("story_id", "group_id", "claim_id").join(said, ["story_id", "claim_id"]).select("group_id", "claim_id", "kind", "holder")


@query("sup10_coverage_rows", "SELECT DISTINCT story_id, source_id, source_type, coverage_scope, country, role FROM {story_articles}")
def _(m: Model) -> DataFrame:
    return m.story_articles.select("story_id", "source_id", "source_type", "coverage_scope", "country", "role").distinct()


@query("sup29_other_members", "SELECT article_id, story_id FROM (SELECT article_id, story_id, count(*) OVER (PARTITION BY story_id) AS n FROM {story_articles}) WHERE n > 1")
def _(m: Model) -> DataFrame:
    counted = m.story_articles.select("article_id", "story_id", F.count("*").over(writes.Window.partitionBy("story_id")).alias("n"))
    return counted.where("n > 1").select("article_id", "story_id")


@query("sup19_embedding_batches", """SELECT batch, place, article_id, sha256(left(text, 12000)) AS text_hash FROM (SELECT article_id, coalesce(nullif(title, '') || chr(10) || chr(10), '') || body AS text, (row_number() OVER (PARTITION BY source_id ORDER BY article_id) - 1) // 25 AS b, ((row_number() OVER (PARTITION BY source_id ORDER BY article_id) - 1) % 25)::INT AS place, source_id FROM {eligible}) t, LATERAL (SELECT source_id || '-' || b AS batch)""")
def _(m: Model) -> DataFrame:
    """Texts for an embedding provider, cut at 12,000 characters, in batches of 25 with their places,
    by which the vectors find back."""
    text = F.substring(F.concat(F.coalesce(F.concat(F.nullif("title", F.lit("")), F.lit("\n\n")), F.lit("")), "body"), 1, 12000)
    number = F.row_number().over(writes.Window.partitionBy("source_id").orderBy("article_id")) - 1
    rows = m.eligible.select("article_id", "source_id", F.sha2(text, 256).alias("text_hash"), number.alias("k"))
    return rows.select(F.concat_ws("-", "source_id", F.expr("k div 25")).alias("batch"), (F.col("k") % 25).alias("place"), "article_id", "text_hash")


# -- states, configuration, catalogs ---------------------------------------------------------


@query("sup16_normalized", "SELECT article_id, CASE WHEN article_id % 6 = 0 THEN 'edited' ELSE title END AS title, article_id % 6 = 0 OR embedding IS NULL AS to_embed FROM {articles} LEFT JOIN {embeddings} USING (article_id)")
def _(m: Model) -> DataFrame:
    """Normalized fields applied: where one differs, the vector goes and is due again."""
    rows = m.articles.select("article_id", "title").join(m.embeddings.select("article_id", "embedding"), "article_id", "left")
    new = m.articles.select("article_id", F.when(F.col("article_id") % 6 == 0, "edited").otherwise(F.col("title")).alias("title"))
    return states.renormalized(rows, new, "article_id", ["title"], ["embedding"]).select("article_id", "title", F.col("embedding").isNull().alias("to_embed"))


@query("sup18_config_hash", """SELECT sha256('{"limit":250,"model":"v1","window":172800}') AS version, count(*) AS articles FROM {articles}""")
def _(m: Model) -> DataFrame:
    settings = {"window": F.lit(172800), "limit": F.lit(250), "model": F.lit("v1")}
    return m.articles.agg(F.count("*").alias("articles")).select(F.sha2(gates.canonical_json(settings), 256).alias("version"), "articles")


@query(
    "sup26_outlets",
    """WITH s AS (SELECT source_id AS slug, num FROM {sources} WHERE num IS NOT NULL) SELECT slug, 'Paper ' || num AS name, CASE WHEN num % 2 = 0 THEN 'FR' WHEN num % 3 = 0 THEN 'IT' ELSE 'DE' END AS country, 'print' AS category, true AS is_primary FROM s
    UNION ALL SELECT slug, 'Site ' || num, CASE WHEN num % 3 = 0 THEN 'IT' ELSE 'DE' END, CASE WHEN num % 5 = 0 THEN 'radio' ELSE 'online' END, false FROM s""",
)
def _(m: Model) -> DataFrame:
    both = "array(named_struct('name', concat('Paper ', num), 'country', CASE WHEN num % 2 = 0 THEN 'FR' END, 'category', 'print'), named_struct('name', concat('Site ', num), 'country', cast(null as string), 'category', cast(null as string)))"
    entries = m.sources.where("num is not null").selectExpr("source_id as slug", "CASE WHEN num % 3 = 0 THEN 'IT' END as country", "CASE WHEN num % 5 = 0 THEN 'radio' END as category", f"{both} as outlets")
    return catalog.outlets(entries, "DE", "online")


@query("sup30_states", f"SELECT article_id, CASE WHEN article_id % 3 = 0 THEN 'created' WHEN article_id % 5 = 0 THEN 'lease_lost' WHEN {NOW} + (article_id % 9 - 4) * 60 <= {NOW} THEN 'lease_expired' ELSE 'held' END AS outcome FROM {{articles}}")
def _(m: Model) -> DataFrame:
    """States made sure of, and leases asserted: another run's lease is lost, an old one expired."""
    have = m.articles.where("article_id % 3 <> 0").select("article_id", F.when(F.col("article_id") % 5 == 0, "other").otherwise("mine").alias("worker"), F.expr(f"{NOW} + (article_id % 9 - 4) * 60").alias("until_s"))
    fresh = states.ensured(have, m.articles, "article_id").select("article_id", F.lit("created").alias("outcome"))
    return fresh.union(have.select("article_id", states.leases(have, "mine", NOW).alias("outcome")))


@query(
    "src12_catalog_rules",
    """WITH c AS (SELECT source_id AS name, num, CASE WHEN num % 6 = 0 THEN 'BLOG' ELSE source_type END AS t, CASE WHEN num % 4 = 1 THEN 'xx' ELSE country END AS country, CASE WHEN num % 7 = 0 THEN 'ftp://x' ELSE 'https://u' || num // 2 END AS url FROM {sources} WHERE num IS NOT NULL)
    SELECT 'source_type' AS rule, name FROM c WHERE num % 6 = 0 UNION ALL SELECT 'country', name FROM c WHERE country = 'xx' UNION ALL SELECT 'url', name FROM c WHERE url LIKE 'ftp%'
    UNION ALL SELECT 'unique_url', name FROM c WHERE url IN (SELECT url FROM c GROUP BY url HAVING count(*) > 1)""",
)
def _(m: Model) -> DataFrame:
    from newsprism.sources.feeds import catalog_violations

    rows = m.sources.where("num is not null").selectExpr("source_id as name", "CASE WHEN num % 6 = 0 THEN 'BLOG' ELSE source_type END as source_type", "CASE WHEN num % 4 = 1 THEN 'xx' ELSE country END as country", "CASE WHEN num % 7 = 0 THEN 'ftp://x' ELSE concat('https://u', num div 2) END as url")
    return catalog_violations(rows)


_CODES = "'DE', 'AT', 'CH', 'FR'"


@query(
    "src12_activation",
    f"""WITH c AS (SELECT 'c' || k AS catalog, k, k % 5 = 1 AS unreviewed, k % 2 = 1 AS own FROM (SELECT DISTINCT num % 7 AS k FROM {{sources}} WHERE num IS NOT NULL)),
    e AS (SELECT 'c' || num % 7 AS catalog, source_id AS name, num, num % 9 = 4 AS bare, CASE WHEN num % 7 = 3 THEN 'ftp' WHEN num % 6 = 5 THEN 'extend_existing_source' ELSE 'create_source' END AS action, CASE WHEN num % 4 = 3 THEN 'XX' WHEN num % 2 = 0 THEN 'DE' ELSE 'FR' END AS country FROM {{sources}} WHERE num IS NOT NULL),
    a AS (SELECT e.*, c.own FROM e JOIN c USING (catalog) WHERE NOT bare AND action <> 'ftp')
    SELECT catalog, NULL::VARCHAR AS name, 'activation_policy' AS rule, 'draft' AS detail FROM c WHERE unreviewed
    UNION ALL SELECT catalog, name, 'action', 'ftp' FROM e WHERE action = 'ftp' AND NOT bare
    UNION ALL SELECT catalog, name, 'extends_nothing', action FROM e WHERE action = 'extend_existing_source' AND num % 5 = 0
    UNION ALL SELECT catalog, name, 'country', country FROM a WHERE NOT own AND country <> 'DE'
    UNION ALL SELECT catalog, name, 'entry_country', country FROM a WHERE own AND country NOT IN ({_CODES})
    UNION ALL SELECT catalog, name, 'feed_class', 'blog' FROM a WHERE num % 8 = 7
    UNION ALL SELECT catalog, name, 'role', 'signal' FROM a WHERE num % 8 = 2
    UNION ALL SELECT catalog, name, 'tier', '3' FROM a WHERE num % 11 = 5
    UNION ALL SELECT catalog, name, 'active', 'true' FROM a WHERE num % 11 = 6
    UNION ALL SELECT catalog, name, 'url_again', 'https://u' || num % 3 FROM a WHERE EXISTS (SELECT 1 FROM a b WHERE b.catalog = a.catalog AND b.num % 3 = a.num % 3 AND b.num < a.num)""",
)
def _(m: Model) -> DataFrame:
    """Catalogs of the sources with planted faults, every offender of every rule."""
    s = m.sources.where("num is not null")
    catalogs = s.selectExpr("num % 7 as k").distinct().selectExpr(
        "concat('c', k) as catalog", f"CASE WHEN k % 5 = 1 THEN 'draft' ELSE '{catalog.REVIEWED}' END as activation_policy", f"'{catalog.CLASSES_ONLY}' as class_policy", "'NEWS' as source_type",
        "CASE WHEN k % 2 = 0 THEN 'DE' END as country", f"CASE WHEN k % 2 = 1 THEN '{catalog.OWN_COUNTRY}' END as country_policy", "'NATIONAL' as scope", "map('news', 'editorial', 'press', 'primary_evidence') as roles")
    entries = s.selectExpr(
        "concat('c', num % 7) as catalog", "source_id as name", "CASE WHEN num % 7 = 3 THEN 'ftp' WHEN num % 6 = 5 THEN 'extend_existing_source' END as action", "CASE WHEN num % 5 <> 0 THEN 'key' END as existing",
        "cast(null as string) as materialization", "cast(null as string) as source_type", "CASE WHEN num % 4 = 3 THEN 'XX' WHEN num % 2 = 0 THEN 'DE' ELSE 'FR' END as country", "cast(null as string) as scope", "0 as outlets")
    feeds = s.where("num % 9 <> 4").selectExpr(
        "concat('c', num % 7) as catalog", "source_id as name", "num as place", "concat('https://u', num % 3) as url", "CASE WHEN num % 8 = 7 THEN 'blog' ELSE 'news' END as feed_class",
        "CASE WHEN num % 8 = 2 THEN 'signal' ELSE 'editorial' END as role", "CASE WHEN num % 11 = 5 THEN 3 WHEN num % 11 = 6 THEN 2 ELSE 1 END as tier", "true as active")
    return catalog.activation_violations(catalogs, entries, feeds)


@query(
    "gr5_around_seeds",
    """WITH RECURSIVE e AS (SELECT a.source_id AS x, b.source_id AS y FROM {sources} a JOIN {sources} b ON b.num = a.num + 4 WHERE a.num % 3 <> 0), n(node) AS (SELECT source_id FROM {sources} WHERE num IN (1, 6) UNION SELECT CASE WHEN e.x = n.node THEN e.y ELSE e.x END FROM n JOIN e ON e.x = n.node OR e.y = n.node)
    SELECT x, y FROM e WHERE x IN (SELECT node FROM n)""",
)
def _(m: Model) -> DataFrame:
    from newsprism.operators import graph

    s = m.sources.select("source_id", "num")
    edges = s.where("num % 3 <> 0").select(F.col("source_id").alias("x"), (F.col("num") + 4).alias("k")).join(s.select(F.col("source_id").alias("y"), F.col("num").alias("k")), "k").select("x", "y")
    return graph.around(edges, m.sources.where("num in (1, 6)").select(F.col("source_id").alias("node")))


@query(
    "st10_catch_up",
    f"""WITH s AS (SELECT story_id, row_number() OVER (ORDER BY t DESC, story_id) AS k, row_number() OVER (ORDER BY t, story_id DESC) AS b, count(*) OVER () AS n FROM ({_STORIES_SQL})), p AS (SELECT story_id FROM s WHERE k <= 9 OR n <= 12 OR b <= 3)
    SELECT m.story_id, m.group_id, count(DISTINCT claim_id) AS claims, count(DISTINCT source_id) AS sources, count(DISTINCT CASE WHEN source_type <> 'SIGNAL' THEN article_id END) AS items, max(CASE WHEN kind = 'quoted' THEN 1 ELSE 0 END) AS quoted
    FROM {{members}} m JOIN p ON p.story_id = m.story_id JOIN (SELECT DISTINCT claim_id AS c, story_id AS st, kind FROM {{perspectives}}) v ON v.c = m.claim_id AND v.st = m.story_id GROUP BY m.story_id, m.group_id""",
)
def _(m: Model) -> DataFrame:
    """The stages of all target stories in one plan: groups, evidence and perspectives together."""
    stories = m.story_articles.groupBy("story_id").agg(F.max("time_s").alias("t"))
    targets = selection.newest_and_oldest(stories, [F.desc("t"), F.col("story_id")], [F.col("t"), F.desc("story_id")], 12).select("story_id").distinct()
    rows = m.voiced.join(F.broadcast(targets), "story_id")  # at most 12 rows
    items = F.countDistinct(F.when(F.col("source_type") != "SIGNAL", F.col("article_id")))
    return rows.groupBy("story_id", "group_id").agg(F.countDistinct("claim_id").alias("claims"), F.countDistinct("source_id").alias("sources"), items.alias("items"), F.max(F.when(F.col("kind") == "quoted", 1).otherwise(0)).alias("quoted"))


# -- writes and scores on real keys ------------------------------------------------------------


@query("snk1_insert_absent", "SELECT entity, language_code, first_article FROM (SELECT entity, min(language_code) AS language_code, min(article_id) AS first_article FROM {entities} GROUP BY entity) WHERE entity NOT IN (SELECT entity FROM {entities} WHERE article_id % 2 = 0)")
def _(m: Model) -> DataFrame:
    """New entities of a batch that repeats keys: those that no even article has named before."""
    seen = m.entities.where("article_id % 2 = 0").select("entity").distinct()
    batch = m.entities.groupBy("entity", "article_id").agg(F.min("language_code").alias("language_code"))
    first = batch.groupBy("entity").agg(F.min("language_code").alias("language_code"), F.min("article_id").alias("first_article"))
    return writes.insert_absent(seen, first.union(first), ["entity"])


@query("snk5_hard_replace", "SELECT article_id, entity, 1 AS run FROM {entities} WHERE article_id % 3 <> 0 UNION ALL SELECT article_id, entity, 2 FROM {entities} WHERE article_id % 3 = 0 AND length(entity) > 5")
def _(m: Model) -> DataFrame:
    """Mentions after a second run over every third article: its rows replace all the first had, also
    where it found fewer."""
    first = m.entities.select("article_id", "entity").withColumn("run", F.lit(1))
    again = m.entities.where("article_id % 3 = 0 and length(entity) > 5").select("article_id", "entity").withColumn("run", F.lit(2))
    return writes.hard_replace(first, again, m.entities.where("article_id % 3 = 0"), "article_id")


@query("snk14_feeds", "SELECT 'f-' || source_id AS feed_id, source_id, 'https://' || source_id || '.example.org/rss' AS url FROM {sources} s WHERE active AND NOT EXISTS (SELECT 1 FROM {feeds} f WHERE f.source_id = s.source_id AND f.active)")
def _(m: Model) -> DataFrame:
    """Backfill by insert and filter: a feed for each active source without one."""
    rows = m.sources.where("active").join(m.feeds.where("active").select("source_id"), "source_id", "left_anti")
    return rows.select(F.concat(F.lit("f-"), "source_id").alias("feed_id"), "source_id", F.concat(F.lit("https://"), "source_id", F.lit(".example.org/rss")).alias("url"))


@query("snk14_terms", "SELECT DISTINCT article_id, term FROM (SELECT article_id, unnest(regexp_extract_all(title, '[A-Z][a-z]{3,}')) AS term FROM {articles} UNION ALL SELECT article_id, language_code FROM {articles}) WHERE term IS NOT NULL")
def _(m: Model) -> DataFrame:
    """Backfill by unnesting an array column, united with a scalar one."""
    listed = m.articles.select("article_id", F.explode(F.regexp_extract_all("title", F.lit("[A-Z][a-z]{3,}"), F.lit(0))).alias("term"))
    return listed.union(m.articles.where("language_code is not null").select("article_id", "language_code")).distinct()


_STATE = f"SELECT article_id, CASE article_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'failed' WHEN 3 THEN 'succeeded' ELSE 'skipped' END AS state, CASE WHEN article_id % 5 IN (1, 2) THEN {NOW} + (article_id % 13 - 6) * 30 END AS until_s, article_id % 7 AS attempts"


@query("flt9_claimable", f"SELECT article_id FROM ({_STATE} FROM {{articles}}) WHERE state = 'pending' OR state = 'claimed' AND until_s <= {NOW} OR state = 'failed' AND until_s <= {NOW} AND attempts < 5")
def _(m: Model) -> DataFrame:
    state = F.expr("CASE article_id % 5 WHEN 0 THEN 'pending' WHEN 1 THEN 'claimed' WHEN 2 THEN 'failed' WHEN 3 THEN 'succeeded' ELSE 'skipped' END")
    until = F.expr(f"CASE WHEN article_id % 5 IN (1, 2) THEN {NOW} + (article_id % 13 - 6) * 30 END")
    rows = m.articles.select("article_id", state.alias("state"), until.alias("until_s"), (F.col("article_id") % 7).alias("attempts"))
    return rows.where(states.claimable(NOW)).select("article_id")


@query("c2_backoff", "SELECT article_id, least(3600, 60 * power(2, greatest(attempts, 1) - 1))::BIGINT AS delay_s FROM (SELECT article_id, article_id % 70 AS attempts FROM {articles})")
def _(m: Model) -> DataFrame:
    return m.articles.select("article_id", states.backoff(F.col("article_id") % 70).alias("delay_s"))


@query("j17_mismatch", "SELECT article_id, source_id FROM {eligible} WHERE article_id % 9 = 0 AND source_type <> 'NGO' OR article_id % 11 = 0 AND country IS NOT NULL")
def _(m: Model) -> DataFrame:
    """Search documents whose source columns are no longer the source's."""
    docs = m.eligible.select("article_id", "source_id", F.when(F.col("article_id") % 9 == 0, "NGO").otherwise(F.col("source_type")).alias("doc_type"), F.when(F.col("article_id") % 11 != 0, F.col("country")).alias("doc_country"))
    now = m.sources.select("source_id", "source_type", "country")
    differs = ~F.col("doc_type").eqNullSafe(F.col("source_type")) | ~F.col("doc_country").eqNullSafe(F.col("country"))
    return docs.join(now, "source_id").where(differs).select("article_id", "source_id")


_TITLE_WORDS_SQL = "SELECT article_id, w, i AS pos FROM (SELECT article_id, regexp_extract_all(lower(title), '[a-z]{4,}') AS ws FROM {eligible}), LATERAL (SELECT unnest(ws) AS w, generate_subscripts(ws, 1) AS i)"


def _title_words(m: Model) -> DataFrame:
    return terms.words(m.eligible, "article_id", "title", "[a-z]{4,}").withColumnRenamed("word", "w")


@query("win9_relevance", f"SELECT article_id, w, relevance FROM (SELECT article_id, w, round(n / max(n) OVER (PARTITION BY article_id), 6) AS relevance, row_number() OVER (PARTITION BY article_id ORDER BY n DESC, w) AS k FROM (SELECT article_id, w, count(*) AS n FROM ({_TITLE_WORDS_SQL}) GROUP BY article_id, w)) WHERE k <= 20")
def _(m: Model) -> DataFrame:
    counts = _title_words(m).groupBy("article_id", "w").agg(F.count("*").alias("n"))
    return terms.relevance(counts, "article_id", "w").withColumn("relevance", F.round("relevance", 6))


@query("win10_bigrams", f"SELECT a, b, count(*) AS n FROM (SELECT w AS a, lead(w) OVER (PARTITION BY article_id ORDER BY pos) AS b FROM ({_TITLE_WORDS_SQL})) WHERE b IS NOT NULL GROUP BY a, b")
def _(m: Model) -> DataFrame:
    pairs = terms.bigrams(terms.words(m.eligible, "article_id", "title", "[a-z]{4,}"), "article_id")
    return pairs.groupBy(F.col("word").alias("a"), F.col("after").alias("b")).agg(F.count("*").alias("n"))


@query("win3_argmax", f"WITH p AS (SELECT x.article_id, m.story_id, count(*) AS score, max(m.time_s) AS t FROM (SELECT DISTINCT article_id, w FROM ({_TITLE_WORDS_SQL})) x JOIN (SELECT DISTINCT article_id, w FROM ({_TITLE_WORDS_SQL})) y ON y.w = x.w AND y.article_id <> x.article_id JOIN {{memberships}} m ON m.article_id = y.article_id AND NOT m.deleted GROUP BY x.article_id, m.story_id) SELECT article_id, story_id, score FROM p QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY score DESC, t DESC, story_id) = 1")
def _(m: Model) -> DataFrame:
    """The story that shares most title words with an article; ties go to the newer, then the smaller id."""
    words = _title_words(m).select("article_id", "w").distinct()
    told = words.join(m.memberships.where("not deleted").select("article_id", "story_id", "time_s"), "article_id").select("w", F.col("article_id").alias("other"), "story_id", "time_s")
    scores = words.join(told, "w").where("other <> article_id").groupBy("article_id", "story_id").agg(F.count("*").alias("score"), F.max("time_s").alias("t"))
    best = F.row_number().over(writes.Window.partitionBy("article_id").orderBy(F.desc("score"), F.desc("t"), "story_id"))
    return scores.withColumn("k", best).where("k = 1").select("article_id", "story_id", "score")


_WANTED = (97, 3, 41, 8, 200, 15, 77, 1, 150, 64)


@query("srt6_list_order", f"SELECT article_id, list_position([{', '.join(map(str, _WANTED))}], article_id)::INT AS place FROM {{eligible}} WHERE article_id IN ({', '.join(map(str, _WANTED))}) ORDER BY place")
def _(m: Model) -> DataFrame:
    """Rows in the order of a list of ids."""
    order = m.spark.createDataFrame(list(enumerate(_WANTED, 1)), "place int, article_id long")
    return m.eligible.select("article_id").join(F.broadcast(order), "article_id").orderBy("place")


@query(
    "str23_evidence_kind",
    f"""SELECT claim_id, CASE WHEN claim_id % 10 = 0 OR claim_id % 10 = 1 THEN 'press_release' WHEN source_type = 'ACADEMIC' THEN 'study' WHEN source_type = 'PRIMARY_SOURCE' THEN CASE WHEN claim_id % 10 = 3 OR regexp_matches(claim_text, '(^|[^{chr(92)}p{{L}}{chr(92)}p{{M}}{chr(92)}p{{N}}{chr(92)}p{{Pc}}])[0-9]+($|[^{chr(92)}p{{L}}{chr(92)}p{{M}}{chr(92)}p{{N}}{chr(92)}p{{Pc}}])') THEN 'official_data' ELSE 'primary_source' END
      WHEN source_type IN ('NEWS', 'AGENCY', 'REGIONAL', 'ALTERNATIVE') THEN 'independent_reporting' ELSE 'context' END AS kind FROM {{members}}""",
)
def _(m: Model) -> DataFrame:
    """Press releases named in the title or the first 1,000 characters, not behind; numbers planted."""
    from newsprism.operators.analysis import evidence_kind

    title = F.when(F.col("claim_id") % 10 == 0, "A News Release of today").otherwise("t")
    body = F.when(F.col("claim_id") % 10 == 1, F.concat(F.repeat(F.lit("x"), 980), F.lit(" Pressemitteilung"))).when(F.col("claim_id") % 10 == 2, F.concat(F.repeat(F.lit("x"), 1000), F.lit("press release"))).otherwise("b")
    claim = F.when(F.col("claim_id") % 10 == 3, F.concat("claim_text", F.lit(" 12,5 %"))).otherwise(F.col("claim_text"))
    return m.members.select("claim_id", evidence_kind(title, body, F.col("source_type"), claim).alias("kind"))


@query("c9_scores", "SELECT entity, article_id, n, round(least(1.0, 0.45 + 0.12 * n), 6) AS salience, round(least(0.95, 0.55 + 0.08 * n), 6) AS topic FROM (SELECT e.entity, e.article_id, len(regexp_extract_all(lower(a.title), '[a-z]+')) - len(list_filter(regexp_extract_all(lower(a.title), '[a-z]+'), lambda w: w <> e.entity)) AS n FROM {entities} e JOIN {articles} a ON a.article_id = e.article_id)")
def _(m: Model) -> DataFrame:
    words = F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0))
    rows = m.entities.select("entity", "article_id").join(m.articles.select("article_id", words.alias("ws")), "article_id")
    n = F.size(F.filter("ws", lambda w: w == F.col("entity")))
    return rows.select("entity", "article_id", n.cast("bigint").alias("n"), F.round(terms.salience(n), 6).alias("salience"), F.round(terms.topic_confidence(n), 6).alias("topic"))


@query(
    "rd3_story_detail",
    """SELECT s.story_id, count(DISTINCT s.article_id) AS articles, count(DISTINCT s.source_id) AS sources, (SELECT count(DISTINCT e.entity) FROM {entities} e JOIN {story_articles} x ON x.article_id = e.article_id WHERE x.story_id = s.story_id) AS entities,
      (SELECT string_agg(entity, ',' ORDER BY n DESC, entity) FROM (SELECT e.entity, count(DISTINCT e.article_id) AS n FROM {entities} e JOIN {story_articles} x ON x.article_id = e.article_id WHERE x.story_id = s.story_id GROUP BY e.entity ORDER BY n DESC, e.entity LIMIT 5)) AS top_entities FROM {story_articles} s GROUP BY s.story_id""",
)
def _(m: Model) -> DataFrame:
    base = m.story_articles.groupBy("story_id").agg(F.countDistinct("article_id").alias("articles"), F.countDistinct("source_id").alias("sources"))
    named = m.story_articles.select("story_id", "article_id").join(m.entities.select("article_id", "entity"), "article_id").groupBy("story_id", "entity").agg(F.countDistinct("article_id").alias("n"))
    order = writes.Window.partitionBy("story_id").orderBy(F.desc("n"), "entity")
    each = named.withColumn("k", F.row_number().over(order)).groupBy("story_id").agg(F.count("*").alias("entities"), F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= 5, F.struct("k", "entity")))), lambda x: x["entity"]), ",").alias("top_entities"))
    return base.join(each, "story_id", "left").na.fill(0, ["entities"])


@query("rd6_by_story", "SELECT story_id, claim_id, claim_text, confidence, place FROM (SELECT story_id, claim_id, claim_text, confidence, row_number() OVER (PARTITION BY story_id ORDER BY time_s DESC, article_id, pos)::INT AS place FROM {members} WHERE confidence >= 0.65) WHERE place BETWEEN 11 AND 20")
def _(m: Model) -> DataFrame:
    order = writes.Window.partitionBy("story_id").orderBy(F.desc("time_s"), "article_id", "pos")
    return m.members.where("confidence >= 0.65").withColumn("place", F.row_number().over(order)).where("place between 11 and 20").select("story_id", "claim_id", "claim_text", "confidence", "place")


@query("rd6_by_article", "SELECT article_id, claim_id, claim_text FROM {claims} WHERE article_id IN (SELECT article_id FROM {eligible}) AND pos BETWEEN 20 AND 39")
def _(m: Model) -> DataFrame:
    """The second page of twenty claims of each eligible article."""
    return m.claims.where("pos between 20 and 39").join(m.eligible.select("article_id"), "article_id", "left_semi").select("article_id", "claim_id", "claim_text")


@query("rd6_by_id", "SELECT c.claim_id, c.claim_text, e.source_id, (SELECT min(story_id) FROM {memberships} m WHERE m.article_id = c.article_id AND NOT m.deleted) AS story_id FROM {claims} c JOIN {eligible} e ON e.article_id = c.article_id")
def _(m: Model) -> DataFrame:
    """What a lookup of a claim by its id gives, for all claims: text, source and story."""
    story = m.memberships.where("not deleted").groupBy("article_id").agg(F.min("story_id").alias("story_id"))
    rows = m.claims.join(m.eligible.select("article_id", "source_id"), "article_id").join(story, "article_id", "left")
    return rows.select("claim_id", "claim_text", "source_id", "story_id")

