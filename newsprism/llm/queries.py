"""The registered queries of this subpackage: thin digests over the operators' own outputs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsprism.session import importable
from newsprism.storage import new_path


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = importable(spark).read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where this machine keeps the public vocabulary; every executor has the same package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.topk import top_k

    return top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.substring_dedup import dedup_substrings

    out = dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.decontaminate import find_contamination

    out = find_contamination(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm import toxicity

    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), toxicity.not_held_out())
    return toxicity.score_toxicity(docs, model).select("doc_id", (~toxicity.not_held_out()).alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.bpe import encode_documents

    out = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), vocabulary())
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text")).drop("text_hash")


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.url_filter import filter_urls

    out = filter_urls(table(spark, sf_dir, "pages", "page_id", "url"), table(spark, sf_dir, "labels"))
    return out.select("page_id", "host", "path", "rule", "verdict")


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.html_text import extract_text

    out = extract_text(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm import token_files

    path = new_path(importable(spark), "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), path, vocabulary())
    return token_files.read_tokens(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.suffix_dedup import dedup_suffixes

    out = dedup_suffixes(table(spark, sf_dir, "documents", "doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept_bytes", 256).alias("kept_sha256"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.hard_negatives import hard_negatives

    rows = table(spark, sf_dir, "embeddings", "vec_id", "label", "embedding")
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(rows.withColumn("label", moved))


def op12_whiten(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.whitening import fit_whitening, whiten

    rows = table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    out = whiten(rows, fit_whitening(rows)).withColumn("deviation", F.expr("try_cast(deviation as bigint)"))
    each = out.select("vec_id", "n", "deviation", "identity_error", F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "c"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")


def op13_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    from newsprism.llm.mixing import mixed_sizes

    out = mixed_sizes(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_topk": op1_topk,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_decontaminate": op3_decontaminate,
    "op4_toxicity": op4_toxicity,
    "op5_bpe": op5_bpe,
    "op6_near_dedup": op6_near_dedup,
    "op7_url_filter": op7_url_filter,
    "op8_html_text": op8_html_text,
    "op9_token_files": op9_token_files,
    "op10_suffix_dedup": op10_suffix_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_whiten": op12_whiten,
    "op13_mix_sources": op13_mix_sources,
}

_SUFFIX = "CASE WHEN {h} = 'example.com' OR {h} LIKE '%.example.com' OR {h} = 'example.net' OR {h} LIKE '%.example.net' OR {h} = 'example.org' OR {h} LIKE '%.example.org' THEN array_to_string(string_split({h}, '.')[-2:], '.') ELSE string_split({h}, '.')[-1] END"


def _strength_sql(n: str, bad: str, above: str, source: str) -> str:
    r = f"(sum({n} * pow({bad} / {n} - {above}, 2)) - sum({above} * (1 - {above}))) / nullif(sum({above} * (1 - {above}) * ({n} - 1)), 0)"
    return f"SELECT CASE WHEN {r} > 0 THEN least(greatest(1 / ({r}) - 1, 2.0), 200.0) ELSE 200.0 END AS m FROM {source} WHERE {n} > 0"


_FOLD = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WORD = r"[^\x20\x09-\x0D]+"

ORACLE: dict[str, str] = {
    "op1_topk": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, d.vec_id, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 20""",
    "op2_substring_dedup": f"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
win AS (SELECT doc_id, k, array_to_string(w[k + 1:k + 20], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS k FROM d)),
again AS (SELECT doc_id, k FROM (SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, k + j AS p FROM again, (SELECT unnest(range(0, 20)) AS j)),
kept AS (SELECT a.doc_id, string_agg(a.x, ' ' ORDER BY a.p) AS t, count(*) AS n FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) - 1 AS p FROM d) a ANTI JOIN gone ON gone.doc_id = a.doc_id AND gone.p = a.p GROUP BY a.doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON kept.doc_id = d.doc_id""",
    "op3_decontaminate": f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM documents),
i AS (SELECT item_id::VARCHAR AS item, w, len(w) AS n, least(13, len(w)) AS size FROM (SELECT item_id, regexp_extract_all({_FOLD}, '{_ALNUM}') AS w FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item, size, array_to_string(w[k + 1:k + size], ' ') AS gram FROM (SELECT *, unnest(range(0, n - size + 1)) AS k FROM i)),
win AS (SELECT doc_id, size, k, array_to_string(w[k + 1:k + size], ' ') AS gram FROM (SELECT doc_id, w, size, unnest(range(0, len(w) - size + 1)) AS k FROM d, (SELECT DISTINCT size FROM g))),
m AS (SELECT win.doc_id, win.size, win.k, g.item FROM win JOIN g ON g.size = win.size AND g.gram = win.gram),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, k + unnest(range(0, size)) AS p FROM (SELECT DISTINCT doc_id, size, k FROM m)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM m GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN t ON t.doc_id = d.doc_id""",
    "op6_near_dedup": f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_FOLD}, '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[k + 1:k + least(5, len(w))], ' ') AS g FROM (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 4, 1))) AS k FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * common >= 75 * (u.n + v.n - common)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r(doc_id, seen) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.y FROM r JOIN e ON e.x = r.seen)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(seen) AS component_id, r.doc_id = min(seen) AS kept FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id""",
    "op7_url_filter": f"""
WITH p AS (
  SELECT page_id, url,
    translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
o AS (SELECT doc_id AS page_id, count(*) AS n, sum(1 - quality) AS bad FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
h0 AS (SELECT host, sum(coalesce(n, 0))::DOUBLE AS n, sum(coalesce(bad, 0))::DOUBLE AS bad FROM p LEFT JOIN o USING (page_id) GROUP BY host),
h1 AS (SELECT *, {_SUFFIX.format(h="host")} AS suffix FROM h0),
h AS (SELECT *, array_to_string(string_split(host, '.')[-(len(string_split(suffix, '.')) + 1):], '.') AS domain FROM h1),
d0 AS (SELECT domain, any_value(suffix) AS suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain),
t0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM d0 GROUP BY suffix),
t1 AS (SELECT *, (SELECT (sum(bad) + 0.5) / (sum(n) + 10.0) FROM t0) AS above FROM t0),
t AS (SELECT *, (bad + m * above) / (n + m) AS mean FROM t1, ({_strength_sql("n", "bad", "above", "t1")})),
d1 AS (SELECT d0.*, t.mean AS above FROM d0 JOIN t USING (suffix)),
d AS (SELECT *, (bad + m * above) / (n + m) AS mean FROM d1, ({_strength_sql("n", "bad", "above", "d1")})),
e1 AS (SELECT h.host, h.n, h.bad, d.mean AS above FROM h JOIN d USING (domain)),
e AS (SELECT *, (bad + m * above) / (n + m) AS mean FROM e1, ({_strength_sql("n", "bad", "above", "e1")})),
s AS (SELECT host, mean - 1.64 * sqrt(mean * (1 - mean) / (n + m + 1)) AS lower FROM e),
r AS (SELECT * FROM (VALUES ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'), ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')) v(verdict, rhost, rpath)),
f AS (SELECT p.page_id, p.host, p.path, s.lower, (SELECT max_by(r.rhost || r.rpath, length(r.rhost || r.rpath)) FROM r WHERE (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)) AS rule FROM p JOIN s USING (host))
SELECT f.page_id, f.host, f.path, f.rule, coalesce(r.verdict, CASE WHEN lower >= 0.3 THEN 'block' ELSE 'allow' END) AS verdict
FROM f LEFT JOIN r ON f.rule = r.rhost || r.rpath""",
    "op10_suffix_dedup": """
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, k, substr(h, 2 * k + 1, 100) AS g FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS k FROM b)),
first AS (SELECT g, min(doc_id) AS doc_id FROM win GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT win.doc_id, k, lag(k) OVER (PARTITION BY win.doc_id ORDER BY k) AS before FROM win JOIN first ON first.g = win.g WHERE first.doc_id < win.doc_id),
run AS (SELECT doc_id, min(k) AS a, max(k) + 50 AS z FROM (SELECT doc_id, k, count(*) FILTER (WHERE before IS NULL OR k > before + 50) OVER (PARTITION BY doc_id ORDER BY k) AS island FROM hit) GROUP BY doc_id, island),
cut AS (SELECT run.doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY run.doc_id ORDER BY a), 0) AS from_, h FROM run JOIN b ON b.doc_id = run.doc_id),
t AS (SELECT doc_id, sum(z - a) AS lost, count(*) AS spans, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) || substr(any_value(h), 2 * max(z) + 1) AS kept FROM cut GROUP BY doc_id)
SELECT b.doc_id, n::BIGINT AS n_bytes, coalesce(lost, 0)::BIGINT AS n_removed, coalesce(spans, 0) AS n_spans, sha256(unhex(coalesce(kept, h))) AS kept_sha256 FROM b LEFT JOIN t ON t.doc_id = b.doc_id""",
    "op11_hard_negatives": """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (
  SELECT q.vec_id AS a, d.vec_id AS i, q.label = d.label AS same, list_inner_product(q.e, d.e)::BIGINT AS score
  FROM v q JOIN v d ON q.vec_id <> d.vec_id AND len(q.e) = len(d.e) WHERE q.vec_id % 100 = 0),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY score DESC, i) AS k FROM s WHERE same) WHERE k <= 5),
n AS (
  SELECT p.a, p.i AS pos, p.score AS ps, s.i AS neg, s.score AS ns, row_number() OVER (PARTITION BY p.a, p.i ORDER BY s.score DESC, s.i) AS rank
  FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score)
SELECT a AS anchor_id, pos AS positive_id, rank::INTEGER AS rank, neg AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE rank <= 5""",
    "op13_mix_sources": f"""
WITH d AS (SELECT doc_id, coalesce('=' || source, '') AS k, source, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size, md5('mix:' || coalesce(doc_id::VARCHAR, ''))[1:8] AS h FROM documents),
s0 AS (SELECT k, any_value(source) AS source, sum(size)::HUGEINT AS own FROM d GROUP BY k),
s1 AS (SELECT *, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::HUGEINT AS w, sum(own) OVER () AS total FROM s0),
c AS (SELECT a.k, sum(least(3 * b.w * a.own, 3 * b.own * a.w)) < any_value(a.total * a.w) AS full_ FROM s1 a, s1 b GROUP BY a.k),
s2 AS (SELECT s1.*, full_, total - coalesce(sum(3 * own) FILTER (full_) OVER (), 0) AS rest, sum(w) FILTER (NOT full_) OVER () AS left_ FROM s1 JOIN c USING (k)),
s3 AS (SELECT k, own, CASE WHEN full_ THEN (3 * own)::DOUBLE ELSE rest::DOUBLE * w::DOUBLE / left_::DOUBLE END AS target FROM s2),
a AS (SELECT d.*, own::BIGINT AS own, target, floor(target + 0.5)::BIGINT AS take, coalesce(sum(size) OVER (PARTITION BY k ORDER BY h, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM d JOIN s3 USING (k))
SELECT doc_id, size, own AS source_size, target, (greatest(0, least(start + size, take) - start) + greatest(0, least(own + start + size, take) - own - start) + greatest(0, least(2 * own + start + size, take) - 2 * own - start))::BIGINT AS taken FROM a""",
}
