"""Graph, story, write, search, feed and analysis operators."""

import datetime

import pytest
from pyspark.sql import functions as F

from newsprism.operators import analysis, articles, graph, search, stories, writes
from newsprism.sources import feeds


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 4), (7, 7), *[(k, k + 1) for k in range(100, 130)]], "x long, y long")
    got = {r.node: r.label for r in graph.components(e).collect()}
    assert {got[k] for k in (1, 2, 3)} == {1} and {got[k] for k in (4, 5)} == {4} and {got[k] for k in range(100, 131)} == {100} and 7 not in got
    assert graph.components(e.limit(0)).count() == 0


def test_source_keys_by_date(spark):
    d = datetime.date
    r = spark.createDataFrame([("b", "a", d(2024, 1, 1), None), ("c", "b", None, d(2024, 6, 1)), ("d", "c", None, None)], "source_id string, related_source_id string, valid_from date, valid_to date")
    w = spark.createDataFrame([("d", d(2024, 2, 1)), ("d", d(2023, 1, 1)), ("d", d(2024, 7, 1)), ("d", None), ("x", None)], "source_id string, at date")
    got = {(x.source_id, str(x.at)): x.key for x in graph.source_keys(w, r).collect()}
    assert got == {("d", "2024-02-01"): "a", ("d", "2023-01-01"): "b", ("d", "2024-07-01"): "c", ("d", "None"): "c", ("x", "None"): "x"}


def test_provenance(spark):
    a = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3"), (4, "s4")], "article_id long, source_id string")
    p = spark.createDataFrame([(1, "s2", 2, False), (2, "agency", None, False), (3, "s4", 4, True), (4, "s3", 3, False)], "article_id long, upstream_source_id string, upstream_article_id long, co_produced boolean")
    got = {}
    for r in graph.provenance_roots(a, p).collect():
        got.setdefault(r.article_id, set()).add(r.source_id)
    assert got[1] == got[2] == {"agency"}
    assert got[3] >= {"s3"}
    voices = graph.story_voices(spark.createDataFrame([("s", 1, "k1"), ("s", 1, "k2"), ("s", 2, "k2"), ("s", 3, "k3"), ("t", 3, "k3")], "story_id string, article_id long, key string"))
    assert {(r.story_id, r.article_id): r.voice for r in voices.collect()} == {("s", 1): "k1", ("s", 2): "k1", ("s", 3): "k3", ("t", 3): "k3"}


def features(spark, rows):
    schema = "article_id long, time_s long, language string, terms array<string>, entities array<string>, topics array<string>, embedding array<double>"
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize(
    ("a", "b", "language", "bases"),
    [
        ((["x", "y"], []), (["x", "y"], []), "en", "title"),
        ((["a", "b", "c", "d", "e"], ["p"]), (["a", "f", "g", "h", "i"], ["p"]), "en", None),
        ((["a", "b", "c", "d", "e"], ["p"]), (["a", "b", "c", "f", "g"], ["p"]), "en", "entity_title"),
        ((["a", "b", "c"], ["p", "q"]), (["a", "d", "e"], ["p", "q"]), "en", None),
        ((["police", "man"], []), (["police", "man"], []), "en", None),
        ((["a"], ["p", "q", "r"]), (["b"], ["p", "q", "r"]), "de", "cross_language_entities"),
        ((["a"], ["p"]), (["b"], ["p"]), "de", None),
    ],
)
def test_story_bases(spark, a, b, language, bases):
    f = features(spark, [(1, 0, "en", a[0], a[1], [], None), (2, 10, language, b[0], b[1], [], None)])
    pairs = spark.createDataFrame([(1, 2)], "a_id long, b_id long")
    got = stories.scored_pairs(pairs, f, f).collect()
    assert (got[0].bases if got else None) == bases


def test_semantic_basis_and_order(spark):
    f = features(spark, [(1, 0, "en", ["a"], [], [], [1.0, 0.0, 0.0]), (2, 60, "de", ["b"], [], [], [0.99, 0.05, 0.0]), (3, 120, "en", ["c"], [], [], None)])
    pairs = stories.candidate_pairs(f, f, semantic=True)
    scored = stories.scored_pairs(pairs, f, f)
    assert {(r.a_id, r.b_id, r.bases) for r in scored.collect()} == {(1, 2, "semantic"), (2, 1, "semantic")}
    assert {(r.article_id, r.story_id) for r in stories.assign_in_order(scored, f).collect()} == {(1, 1), (2, 1), (3, 3)}
    got = stories.best_matches(scored, spark.createDataFrame([(1, 9)], "article_id long, story_id long")).collect()
    assert [(r.article_id, r.story_id) for r in got] == [(2, 9)]


def test_writes(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "x")], "id long, t string, u string")
    new = spark.createDataFrame([(1, "a", None), (2, "c", "x"), (3, "d", None), (3, "e", None)], "id long, t string, u string")
    assert [r.t for r in writes.insert_absent(old, new, ["id"]).collect()] == ["d"]
    got = {r.id: (r.action, r.changed) for r in writes.diff_upsert(old, new.where("t <> 'e'"), ["id"], ["t", "u"]).collect()}
    assert got == {1: ("unchanged", ""), 2: ("update", "t"), 3: ("insert", "")}
    history = spark.createDataFrame([("s", 1, 1), ("s", 2, 1), ("r", 1, 1)], "k string, v int, generation int")
    again = writes.append_generation(history, spark.createDataFrame([("s", 5, 0)], "k string, v int, generation int"), "k")
    assert sorted((r.k, r.v) for r in writes.current(again, "k").collect()) == [("r", 1), ("s", 5)] and again.count() == 4
    plan = writes.plan_reconcile(new.where("t <> 'e'"), old, "id", ["t", "u"], fixed=["t"])
    assert {r.id: r.action for r in plan.collect()} == {1: "no_change", 2: "conflict", 3: "create"}
    p = spark.createDataFrame([(1, ("z", True))], "id long, t struct<value:string,present:boolean>")
    assert {r.id: r.t for r in writes.patch(old, p, "id", ["t"]).collect()} == {1: "z", 2: "b"}


def test_identity_cascade(spark):
    have = spark.createDataFrame([(1, "f", "guid", "g1", "u1"), (2, "f", "derived", "d2", "u2"), (3, "f", "derived", "d3", "u3"), (4, "f", "derived", "d4", "u3")], "article_id long, feed_id string, identity_type string, identity_key string, link string")
    new = spark.createDataFrame([(10, "f", "g1", None, "x"), (11, "f", "g9", "u1", "x"), (12, "f", None, "u2", "x"), (13, "f", None, "u3", "d3"), (14, "f", None, "u9", "x")], "entry_id long, feed_id string, guid string, link string, derived string")
    got = {r.entry_id: (r.article_id, r.matched_by) for r in writes.match_identity(new, have).collect()}
    assert got == {10: (1, "guid"), 11: (None, "new"), 12: (2, "link"), 13: (3, "derived"), 14: (None, "new")}


def test_search(spark):
    docs = spark.createDataFrame([(1, "s", "en", "Climate law", "The climate changes. Climate law passed.", 1), (2, "s", "en", "Sports", "No such topic; law only.", 2), (3, "s", "de", "Klima", "Nichts", 3)], "article_id long, source_id string, language_code string, title string, body string, time_s long")
    posted = search.postings(docs)
    find = lambda q: sorted(r.article_id for r in search.search(docs, posted, q).collect())
    assert find("climate") == [1] and find("law") == [1, 2] and find("law -climate") == [2] and find('"climate law"') == [1] and find('"law climate"') == []
    assert find("klima or sports") == [2, 3] and find("-law") == [3] and find("") == [1, 2, 3]
    ranked = {r.article_id: r.rank for r in search.search(docs, posted, "law").collect()}
    assert ranked[1] > ranked[2]
    assert "<mark>" in docs.where("article_id = 1").select(search.headline(F.col("body"), "climate").alias("h")).first().h
    assert [r.article_id for r in search.page(search.search(docs, posted, ""), "newest", 2, 1).collect()] == [2]


def test_perspectives(spark):
    body = "The budget will rise, says Jane Doe. Nobody knows why the budget rises."
    text = "“Taxes will fall soon”, Jane Doe said. "
    arts = spark.createDataFrame([(1, "", body), (2, "", "According to Jane Doe prices will rise."), (3, "", text)], "article_id long, title string, body string")
    claims = spark.createDataFrame([("a", 1, "body", 0, 36, 0), ("b", 1, "body", 37, 71, 1), ("c", 2, "body", 0, 39, 0), ("d", 3, "body", 0, 38, 0)], "claim_id string, article_id long, text_source string, start_offset int, end_offset int, sentence_index int")
    m = spark.createDataFrame([("m1", 1, "e", "body", 27, 35), ("m2", 2, "e", "body", 13, 21), ("m3", 3, "e", "body", text.index("Jane"), text.index("Jane") + 8)], "mention_id string, article_id long, entity_id string, text_source string, start_offset int, end_offset int")
    got = {r.claim_id: (r.kind, r.holder_mention_id) for r in articles.attribute(claims, m, arts).collect()}
    assert got == {"a": ("unattributed", None), "b": ("unattributed", None), "c": ("reported", "m2"), "d": ("quoted", "m3")}


RSS = """<rss version="2.0"><channel><title>T</title><item><guid>g1</guid><title> A </title><link>/x</link><category>p</category><category>p</category><category>q</category>
<enclosure url="/f.mp3" type="audio/mpeg" length="123"/><pubDate>Mon, 01 Jan 2024 00:00:00 +0000</pubDate></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>T</title><entry><id>i</id><title>B</title><link rel="self" href="/s"/><link rel="alternate" href="/a"/><updated>2024-01-01T00:00:00Z</updated><author><name>N</name></author></entry></feed>"""


def test_feeds(spark):
    df = spark.createDataFrame([("r", "https://e.org/rss", RSS), ("a", "https://e.org/atom", ATOM), ("b", "https://e.org/b", "<html></html>"), ("n", None, None)], "feed_id string, url string, content string")
    rows = {r.feed_id: r for r in feeds.identity(feeds.entries(df)).collect()}
    assert set(rows) == {"r", "a"}
    r, a = rows["r"], rows["a"]
    assert (r.external_id, r.title, r.link, r.categories, r.published_s, r.identity_type) == ("g1", "A", "https://e.org/x", ["p", "q"], 1704067200, "guid")
    assert (r.enclosures[0].url, r.enclosures[0].length_bytes) == ("https://e.org/f.mp3", 123)
    assert (a.format, a.link, a.author, a.published_s, a.updated_s) == ("atom", "https://e.org/a", "N", None, 1704067200)


def test_feed_providers():
    item = "<item><id>i</id><guid>g</guid><dc:date xmlns:dc='d'>2024-01-01T00:00:00Z</dc:date>{}</item>"
    entry = lambda x: feeds.parse_feed(f"<rss><channel>{item.format(x)}</channel></rss>")["entries"][0]
    assert entry("<source url='u'>dpa</source>")["provider"] == "dpa" and entry("<source><title>AFP</title></source><publisher>P</publisher>")["provider"] == "AFP"
    assert entry("<publisher>P</publisher>")["provider"] == "P" and entry("")["provider"] is None
    assert (entry("")["external_id"], entry("")["updated_s"], entry("")["published_s"]) == ("i", 1704067200, None)


@pytest.mark.parametrize(("url", "ok"), [("https://a.org/x", True), ("ftp://a.org", False), ("http://u:p@a.org", False), ("http://127.0.0.1/", False), ("http://10.0.0.1/", False), ("http://8.8.8.8/", True), ("http://localhost:80/", False), ("nothing", False), (None, False)])
def test_url_policy(url, ok):
    assert feeds.url_allowed(url) is ok


def test_catalogs(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"catalog":"c","country":"DE","source_type":"NEWS","groups":[{"name":"g","entries":[{"name":"A","feeds":[{"name":"f","url":"https://a.org/f"},{"name":"f2","url":"https://a.org/f"}]},{"name":"B","source_type":"OTHER","country":"de"}]}]}')
    rows = feeds.catalogs(spark, str(tmp_path))
    assert rows.count() == 3 and rows.where("is_primary").count() == 1
    assert {(r.rule, r.name) for r in feeds.catalog_violations(rows).collect()} == {("source_type", "B"), ("country", "B"), ("unique_url", "A")}


def test_consensus_and_coverage(spark):
    members = spark.createDataFrame([("s", 1, 10, 100, "editorial", "v1", "src1"), ("s", 1, 11, 101, "editorial", "v2", "src2"), ("s", 2, 12, 102, "primary_evidence", "v3", "src3")], "story_id string, group_id long, claim_id long, article_id long, role string, voice string, source_id string")
    full = members.select("*", F.lit("NEWS").alias("source_type"), F.lit("It costs 5 euros").alias("claim_text"), F.lit("t").alias("title"), F.lit("b").alias("body"))
    said = spark.createDataFrame([(1, 10, "quoted", "e", "q1"), (2, 10, "quoted", "e", "q2"), (3, 12, "unattributed", None, "")], "perspective_id long, claim_id long, kind string, holder string, evidence_text string")
    items = analysis.evidence(full, analysis.direct_quotes(said))
    assert sorted(r.kind for r in items.collect()) == ["direct_quote", "direct_quote", "independent_reporting", "independent_reporting"]
    groups = analysis.consensus(members, items, said)
    assert {r.group_id: (r.label, r.independent_sources, r.attributed) for r in groups.collect()} == {1: ("shared", 2, 2), 2: ("single_source", 0, 0)}
    rel = spark.createDataFrame([("s", 1, 2, "contradicts")], "story_id string, left_group long, right_group long, kind string")
    found = analysis.differences(rel, groups)
    sources = members.select("story_id", "article_id", "source_id", "voice", "role", F.lit("NEWS").alias("source_type"), F.lit(None).cast("string").alias("coverage_scope"), F.lit("DE").alias("country"))
    covered = analysis.coverage(sources, groups, found)
    row = covered.first()
    assert (row.articles, row.sources, row.independent_sources, row.differences, row.by_scope, row.by_country) == (3, 3, 2, 1, {}, {"DE": 3})
    assert analysis.gaps(covered).count() == 0
    missing = analysis.missing_perspectives(groups, found)
    assert [(r.group_id, r.contradicted_by) for r in missing.collect()] == [(2, [1])]
    assert analysis.integrated(members, items, groups, covered, missing).count() == 1
    assert analysis.integrated(members, items.where("group_id = 1"), groups, covered, missing).count() == 0
    signal = sources.limit(1).withColumn("role", F.lit("signal"))
    assert {r.gap for r in analysis.gaps(analysis.coverage(signal, groups.limit(0), found.limit(0))).collect()} == {"limited_independent_content_sources", "signal_without_content_coverage"}


def test_normalize(spark):
    df = spark.createDataFrame([("<b>T</b>", "sum mary", " "), (None, None, "<p>First <strong>paragraph</strong>.</p><script>x</script><p>Second.</p>"), (None, None, None)], "title string, summary string, content string")
    got = articles.normalize(df).collect()
    assert [(r.clean_title, r.text, r.word_count, r.reading_minutes) for r in got] == [("T", "sum mary", 2, 1), (None, "First paragraph . Second.", 3, 1), (None, None, 0, 0)]
