"""The corpus operators against brute force, and their defined edge cases."""

import os
import random
import re
import sys
from pathlib import Path
from urllib.parse import urlsplit

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))
os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import brute  # noqa: E402

from newsprism.llm import bpe, decontaminate, html_text, near_dedup, queries, substring_dedup, suffix_dedup, token_files, topk, toxicity, url_filter  # noqa: E402
from newsprism.storage import new_path  # noqa: E402


def make_corpus():
    """Texts with exact and near copies, shared passages, one long text, and odd ones."""
    rng = random.Random(5)
    words = ["".join(rng.choice("aeioulnrstdkéß") for _ in range(rng.randint(1, 9))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    texts = [text(rng.randint(1, 120)) for _ in range(40)]
    base, passage = text(150), text(60)
    texts += [base] * 8
    for _ in range(12):
        w = base.split()
        for _ in range(rng.randint(1, 5)):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
    texts += [f"{text(20)} {passage}\n{text(15)}" for _ in range(10)]
    long = text(6000)
    texts += [long, long[:9000] + " " + text(50), "", " \t\n", None, "a", "A b\x0bC", "ÀB àb 中文 emoji 🚀 end", "x" * 3000, "the" * 900, passage + " " + passage]
    rng.shuffle(texts)
    return [(3 * i + 1, t) for i, t in enumerate(texts)]


CORPUS = make_corpus()
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(CORPUS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows, shared and null ids, null and empty texts, and columns of clashing names."""
    rows = [(1, "a b c d e f g", "x", 7), (1, "a b c d e f g", "x", 7), (1, "other words here", "y", None), (None, "a b c d e f g", None, 1), (None, None, None, None), (2, None, "z", 0), (3, "", "z", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, n_words string, score long")


def table(df, *columns):
    return {r[0]: tuple(r[1:]) for r in df.select(*columns).collect()}


def test_substring_dedup(docs):
    out = substring_dedup.dedup_substrings(docs)
    assert table(out.withColumn("s", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "s") == brute.substring_dedup(CORPUS)
    for r in out.collect():
        w = brute.WORD.findall(r.text or "")
        assert sum(s.end - s.start for s in r.spans) == r.n_removed
        gone = {k for s in r.spans for k in range(s.start, s.end)}
        assert " ".join(x for k, x in enumerate(w) if k not in gone) == r.kept_text


def test_substring_dedup_odd(odd):
    out = substring_dedup.dedup_substrings(odd, window=3).collect()
    # null ids come first; rows that share an id are one document, so the second copy repeats the first
    assert sorted((r.doc_id or 0, r.text or "", r.n_removed) for r in out) == [(0, "", 0), (0, "a b c d e f g", 0), (1, "a b c d e f g", 7), (1, "a b c d e f g", 7), (1, "other words here", 0), (2, "", 0), (3, "", 0)]
    assert substring_dedup.dedup_substrings(odd.limit(0)).count() == 0


def test_suffix_dedup(docs):
    out = suffix_dedup.dedup_suffixes(docs)
    assert table(out.withColumn("s", F.sha2("kept_bytes", 256)).withColumn("n", F.size("spans")), "doc_id", "n_bytes", "n_removed", "n", "s") == brute.byte_dedup(CORPUS)


def test_substring_dedup_with_wide_hashes(docs, monkeypatch):
    from newsprism.llm import blocks

    assert blocks.hash_width(1e6, 8) == 6 and blocks.hash_width(1e14, 10**7) > 8 and blocks.hash_width(1e30, 1) == 16
    monkeypatch.setattr(blocks, "hash_width", lambda *_: 12)
    out = substring_dedup.dedup_substrings(docs)
    assert table(out.withColumn("s", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "s") == brute.substring_dedup(CORPUS)


def test_substring_dedup_one_block_a_task(spark, monkeypatch):
    """Blocks of one size give tasks of one size: no task cuts two of them."""
    rng = random.Random(8)
    rows = [(k, " ".join(f"w{rng.randrange(50):02}" for _ in range(50))) for k in range(640)]
    monkeypatch.setattr(substring_dedup.B, "BLOCK_BYTES", 640 * 199 // 64 + 1)
    out = substring_dedup.dedup_substrings(spark.createDataFrame(rows, SCHEMA)).withColumn("task", F.spark_partition_id())
    sizes = [r["count"] for r in out.groupBy("task").count().collect()]
    assert sum(sizes) == 640 and len(sizes) == 64 and max(sizes) <= 12
    assert table(out.withColumn("s", F.sha2("kept_text", 256)), "doc_id", "n_words", "n_removed", "s") == brute.substring_dedup(rows)


def test_equal_hashes_dont_make_pieces_equal():
    data = np.frombuffer(b"abcabdabcabcdabd", np.uint8)
    begin, size = np.array([0, 3, 6, 9, 13]), np.array([3, 3, 3, 4, 3])
    kind = suffix_dedup._alike(np.array([7, 7, 7, 7, 7], np.uint64), data, begin, size)
    assert kind[0] == kind[2] and len({kind[0], kind[1], kind[3]}) == 3 and kind[1] == kind[4]


def test_toxicity_scores_are_noisy_or_of_sentences(spark):
    """Scores against plain Python, from given weights of whole words."""
    from newsprism.llm import vec

    words, bias = {"bad": 3.0, "worse": 1.5, "good": -1.0}, -4.0
    number = {w: int(toxicity.features(vec.Words([w.encode()], vec.NON_ALNUM, fold=True))[0, 0]) for w in words}
    texts = ["bad", "Bad good! worse. Fine", "", None, "worse worse worse", "a\nb\nBAD bad", "x" * 100_000 + " bad"]
    df = spark.createDataFrame([(1, t) for t in texts], SCHEMA)
    got = {r.text: r.score for r in toxicity.score_toxicity(df, (np.array(list(number.values()), np.int32), np.array(list(words.values())), bias)).collect()}
    for t in texts:
        parts = [p for p in re.split("[.!?\n]+", (t or "").lower()) if p.strip()] or [""]
        nothing = 1.0
        for p in parts:
            nothing *= 1 - 1 / (1 + np.exp(-(bias + sum(words.get(w, 0.0) for w in p.split()))))
        assert abs(got[t] - (1 - nothing)) < 1e-9


def test_suffix_dedup_odd(spark, odd):
    assert suffix_dedup.dedup_suffixes(odd).count() == 7
    assert suffix_dedup.dedup_suffixes(odd.limit(0)).count() == 0
    same = spark.createDataFrame([(1, "q" * 80), (1, "q" * 80), (2, "q" * 80)], SCHEMA)
    assert sorted((r.doc_id, r.n_removed) for r in suffix_dedup.dedup_suffixes(same).collect()) == [(1, 0), (1, 0), (2, 80)]


def test_smaller_values():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 50, 400):
        x = rng.integers(0, 20, n)
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(n)]
        assert suffix_dedup.smaller(x).tolist() == want


def test_near_dedup(docs):
    out = near_dedup.near_duplicates(docs)
    assert table(out, "doc_id", "n_shingles", "component_id", "kept") == brute.near_dedup(CORPUS)


def test_near_dedup_odd(odd):
    out = near_dedup.near_duplicates(odd).collect()
    assert len(out) == 7 and sum(r.kept for r in out) == 5
    assert {r.component_id for r in out if r.doc_id is None} == {None}
    assert near_dedup.near_duplicates(odd.limit(0)).count() == 0


def test_near_dedup_links_chains(spark):
    words = [f"w{k}" for k in range(60)]
    rows = [(k + 1, " ".join(words[2 * k : 2 * k + 40])) for k in range(10)]
    assert table(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id", "kept") == brute.near_dedup(rows)


def hub_and_spokes(spokes, words=200, seed=3):
    """A base text, last by id, and copies of it, each near to the base only."""
    rng = random.Random(seed)
    base = [f"b{k}" for k in range(words)]
    rows = []
    for k in range(spokes):
        w = list(base)
        for j in rng.sample(range(0, words, 10), 5):
            w[j + rng.randrange(4)] = f"s{k}x{j}"
        rows.append((k + 1, " ".join(w)))
    return [*rows, (spokes + 1, " ".join(base))]


def test_near_dedup_hub_of_many_spokes(spark):
    rows = hub_and_spokes(600)
    sets = [brute_shingles(t) for _, t in rows]
    near = lambda x, y: 100 * len(x & y) >= 75 * len(x | y)
    assert all(near(s, sets[-1]) for s in sets) and sum(near(sets[i], sets[j]) for i in range(50) for j in range(i)) < 120
    out = table(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "component_id", "kept")
    assert out == {k: (1, k == 1) for k, _ in rows}


def brute_shingles(text):
    w = text.split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_near_dedup_same_links_in_small_and_dense_regions(spark, monkeypatch):
    """Every pair of a whole region is examined, also over several blocks and without the rounds before."""
    rows = hub_and_spokes(120, seed=4)
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    for block in (2000, 16):
        monkeypatch.setattr(near_dedup, "BLOCK", block)
        out = table(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "component_id", "kept")
        assert out == {k: (1, k == 1) for k, _ in rows}


def test_near_dedup_last_pass_alone(spark, docs, monkeypatch):
    """What the first rounds don't link, the last pass does."""
    monkeypatch.setattr(near_dedup, "ROUNDS", 0)
    monkeypatch.setattr(near_dedup, "candidates", lambda live, *_: live.limit(0).selectExpr("c as b", "c as a"))
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    assert table(near_dedup.near_duplicates(docs), "doc_id", "n_shingles", "component_id", "kept") == brute.near_dedup(CORPUS)


def test_near_dedup_crowded_boilerplate(spark):
    """Recall against brute force where half of each text is common to all: one hot region a tree,
    nearly all of whose pairs are no links."""
    rng = random.Random(9)
    common = " ".join(f"c{k}" for k in range(60))
    rows = []
    for k in range(150):
        own = [f"d{k}x{j}" for j in range(50)]
        rows.append((2 * k + 1, f"{common} {' '.join(own)}"))
        if k % 3 == 0:
            own[rng.randrange(10)] = "changed"
            rows.append((2 * k + 2, f"{common} {' '.join(own)}"))
    rng.shuffle(rows)
    assert table(near_dedup.near_duplicates(spark.createDataFrame(rows, SCHEMA)), "doc_id", "n_shingles", "component_id", "kept") == brute.near_dedup(rows)


def test_near_dedup_texts_under_one_id(spark):
    words = [f"w{k}" for k in range(80)]
    text, near, other = " ".join(words[:60]), " ".join(words[:58]), " ".join(reversed(words))
    df = spark.createDataFrame([(1, text), (5, near), (5, other), (5, other), (7, other + " end"), (7, text)], SCHEMA)
    got = sorted((r.doc_id, r.component_id, r.kept, r.n_shingles) for r in near_dedup.near_duplicates(df).collect())
    assert got == [(1, 1, True, 56), (5, 1, False, 54), (5, 5, True, 76), (5, 5, True, 76), (7, 1, False, 56), (7, 5, False, 77)]
    assert sorted(r.text[:6] for r in near_dedup.drop_near_duplicates(df).collect()) == sorted([text[:6], other[:6], other[:6]])


def test_near_dedup_least_equal():
    assert near_dedup.least_equal(75) == 21 and near_dedup.least_equal(100) == near_dedup.K


def test_bitmaps_bound_the_common_part():
    rng = np.random.default_rng(8)
    a = np.unique(rng.integers(0, 1 << 63, 500).astype(np.uint64))
    b = np.unique(np.concatenate([a[:300], rng.integers(0, 1 << 63, 150).astype(np.uint64)]))
    x, y = (np.frombuffer(m, np.uint64) for m in near_dedup.bitmaps([a, b]))
    common = len(np.intersect1d(a, b))
    assert common <= len(a) - np.bitwise_count(x & ~y).sum() and common <= len(b) - np.bitwise_count(y & ~x).sum()


def test_decontamination(spark, docs):
    items = [(1, "one two"), (2, CORPUS[3][1] or "zz"), (3, CORPUS[20][1]), (4, None), (5, "..."), (None, CORPUS[25][1]), (3, "again three")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    out = decontaminate.find_contamination(docs, bench)
    got = table(out.withColumn("n", F.size("items")).withColumn("s", F.sha2(F.array_join("items", ","), 256)), "doc_id", "n_words", "n_hit", "n", "s", "contaminated")
    want = brute.contamination(CORPUS, [x for x in items if x[0] is not None])
    hit = brute.contamination(CORPUS, items)
    assert {k: (v[0], *v[2:4]) for k, v in got.items()} == {k: (v[0], *v[2:4]) for k, v in want.items()}
    assert {k: (v[1], v[4]) for k, v in got.items()} == {k: (v[1], v[4]) for k, v in hit.items()}
    assert decontaminate.find_contamination(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_beyond_the_broadcast(docs, spark, monkeypatch):
    items = [(k, CORPUS[k][1]) for k in range(0, 40, 3)] + [(100, "one"), (None, CORPUS[50][1]), (0, CORPUS[41][1]), (0, CORPUS[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(str, decontaminate.find_contamination(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 0)
    assert sorted(map(str, decontaminate.find_contamination(docs, bench).collect())) == whole
    assert sum("contaminated=True" in r for r in whole) > 10


def test_decontamination_odd(spark, odd):
    bench = spark.createDataFrame([(1, "b c d")], "item_id long, text string")
    out = decontaminate.find_contamination(odd, bench)
    assert out.where("contaminated").count() == 3 and out.count() == 7
    assert decontaminate.decontaminate(odd, bench).columns == odd.columns
    cleaned = {r.text for r in decontaminate.remove_spans(out).where("contaminated").collect()}
    assert cleaned == {"a e f g"}


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(queries.vocabulary())


def test_bpe(docs, tokenizer):
    out = bpe.encode_documents(docs, queries.vocabulary())
    got = table(out.withColumn("i", F.sha2("ids", 256)).withColumn("d", F.sha2("decoded", 256)), "doc_id", "n_tokens", "i", "d")
    assert got == brute.bpe(CORPUS, tokenizer)


@pytest.mark.parametrize("leaf", [3, 16, 512])
def test_tree_concatenation(tokenizer, leaf):
    codec, rng = bpe.Codec(queries.vocabulary(), leaf=leaf), random.Random(leaf)
    for parts in ("ab", "aab", "theringan", ["th", "the", "ing", "er", "é", "1"]):
        for n in (1, leaf, 5 * leaf + 1, 900):
            text = "".join(rng.choice(parts) for _ in range(n))
            assert codec.encode([text.encode()])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_odd(odd):
    out = bpe.encode_documents(odd, queries.vocabulary())
    assert out.count() == 7 and out.where("text is null and n_tokens = 0 and decoded = ''").count() == 2
    assert bpe.encode_documents(odd.limit(0), queries.vocabulary()).count() == 0


def test_token_files(spark, docs, tokenizer):
    path = new_path(spark, "tokens")
    token_files.write_tokens(docs, path, queries.vocabulary())
    out = token_files.read_tokens(spark, path)
    assert table(out.withColumn("c", F.crc32("ids")), "doc_id", "start", "n_tokens", "c") == brute.token_files(CORPUS, tokenizer)


def test_token_files_odd(spark, odd):
    for rows, n in ((odd, 7), (odd.limit(0), 0)):
        path = new_path(spark, "tokens")
        token_files.write_tokens(rows, path, queries.vocabulary())
        out = token_files.read_tokens(spark, path).collect()
        assert len(out) == n and sorted(r.start for r in out)[:1] == [0][:n]


def test_direct_access():
    rng = np.random.default_rng(2)
    for n, top in ((0, 10), (1, 1 << 31), (511, 200), (512, 1 << 16), (5000, 70000), (3000, 1 << 32)):
        ids = rng.integers(0, top, n, dtype=np.uint64).astype(np.uint32)
        seg = token_files.Segment(token_files.encode(ids))
        assert len(seg) == n
        at = rng.integers(0, n, 300) if n else np.empty(0, np.int64)
        assert (seg.get(at) == ids[at]).all()
        for a, b in ((0, n), (n // 3, n // 2), (n, n)):
            assert (seg.slice(a, b) == ids[a:b]).all()


def test_top_k(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), [float(np.float32(x)) for x in rng.normal(0, 0.3, 8)]) for i in range(300)]
    rows += [(i, rows[i - 300][1]) for i in range(300, 340)] + [(340, None), (341, [float("nan")] * 8), (342, [None] * 8), (343, [float("inf")] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(tuple(r) for r in topk.top_k(df).collect())
    assert got == sorted(brute.top_k(rows))
    again = df.union(df.limit(30)).withColumn("score", F.lit("x"))
    assert sorted(tuple(r) for r in topk.top_k(again).collect()) == got
    assert topk.top_k(df.limit(0)).count() == 0
    few = spark.createDataFrame(rows[:4], df.schema)
    assert [r.rank for r in topk.top_k(few).orderBy("rank").collect()] == [1, 2, 3]


def test_tree_prunes_and_stays_exact():
    rng = np.random.default_rng(4)
    centres = rng.integers(-4000, 4000, (40, 3))
    d = np.concatenate([c + rng.integers(-20, 20, (200, 3)) for c in centres])
    q = d[::97]
    s = topk.Search(q, np.arange(len(q)) + 10**6, d, np.arange(len(d)), 5, (4, 50))
    want = -np.sort(-(q @ d.T), axis=1)[:, :5]
    assert (s.scores == want).all() and s.pruned > s.visited
    huge = topk.Search(q * 10**7, np.arange(len(q)) + 10**6, d * 10**7, np.arange(len(d)), 5)
    assert not huge.exact and huge.full.all()
    tree = topk.CoverTree(d.astype(float), 50)
    for k in range(len(tree.centre)):
        own = tree.x[tree.members[k]] - tree.x[tree.centre[k]]
        assert np.sqrt((own * own).sum(1)).max() <= tree.radius[k] + 1e-9


def test_toxicity(spark):
    rng = random.Random(6)
    words = [f"w{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(1200):
        bad = i % 6 == 0
        parts = [" ".join(rng.choice(words) for _ in range(rng.randint(4, 12))) for _ in range(rng.randint(1, 12))]
        if bad:
            parts[rng.randrange(len(parts))] += f" vileword{rng.choice(['s', 'ing', 'ed', ''])} then"
        rows.append((i, ". ".join(parts)))
        labels.append((i, int(bad)))
    df, known = spark.createDataFrame([*rows, (5000, None), (5001, "")], SCHEMA), spark.createDataFrame([*labels, (None, 1), (7, None)], "doc_id long, toxic int")
    model = toxicity.train(df, known, toxicity.not_held_out())
    out = toxicity.score_toxicity(df, model)
    held = out.where(~toxicity.not_held_out() & (F.col("doc_id") < 5000)).collect()
    assert sum(r.predicted == (r.doc_id % 6 == 0) for r in held) >= 0.97 * len(held)
    for r in held:
        if r.predicted and r.doc_id % 6 == 0:
            assert any("vileword" in r.text[s.start : s.end] for s in r.offending)
    blank = {r.doc_id: r.score for r in out.where("doc_id >= 5000").collect()}
    assert blank[5000] == blank[5001] and 0 <= blank[5000] < 0.3
    assert toxicity.score_toxicity(df, toxicity.train(df, known.limit(0))).where("predicted = 1").count() == 0
    assert toxicity.drop_toxic(df.limit(0), known).count() == 0


def test_url_filter(spark):
    rows = [(1, "http://A.B.example.com/en/71?q"), (2, "x://example.com/en/6"), (3, "http://notexample.com/en/x"), (4, "http://s.example.net/de/8"), (5, "http://net/de/9"), (6, None), (7, "no url"), (8, "http://h.org#f/es/"), (9, "http://h.org/es/#"), (9, "http://h.org/es/#"), (10, "http://bad.example.org/")]
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash"))
    labels = spark.createDataFrame([*[(10, 0)] * 40, *[(8, 1)] * 300, (2, 1), (99, 0), (1, None)], "doc_id long, quality int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got[1] == ("a.b.example.com", "/en/71", "example.com/en/7", "allow")
    assert got[2][2:] == ("com/en/", "block") and got[3][2:] == ("com/en/", "block") and got[4][2:] == ("example.net/de/8", "block") and got[5][2:] == ("net/de/", "allow")
    assert got[6][:3] == got[7][:3] == ("", "", None) and got[8] == ("h.org", "", None, "allow") and got[9][2:] == ("org/es/", "block")
    assert got[10] == ("bad.example.org", "/", None, "block")
    assert url_filter.filter_urls(pages, labels).count() == 11
    assert url_filter.filter_urls(pages.limit(0), labels).count() == 0
    assert url_filter.filter_urls(pages, labels.limit(0)).where("rule is null and verdict = 'block'").count() == 0


def test_html_text(spark):
    shell = "<html><head><title>t</title></head><body><div class='top'>Home News Sport Weather Contact Imprint</div>{}<div>Copyright all rights reserved by this site</div></body>"
    rows = [(k, "http://h.org/x", shell.format(f"<p>Text {k} tells its own tale number{k}</p>")) for k in range(6)]
    rows += [(10, None, None), (11, "http://h.org/", "<nav>n</nav><article><h1>A &amp; B</h1><p>one<br>two<p>three <script>x()</script></article><div class='comments'>c</div><footer>f</footer>"), (12, "http://lone.org/", "<p>Only page here</p>"), (13, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = {r.page_id: r.text for r in html_text.extract_text(pages).collect()}
    assert all(got[k] == f"Text {k} tells its own tale number{k}" for k in range(6))
    assert got[11] == "A & B\none two\nthree" and got[12] == "Only page here" and got[10] == got[13] == ""
    assert html_text.extract_text(pages.limit(0)).count() == 0


def test_html_hot_host_against_brute_force(spark):
    """A host of over 1,000 unmarked pages: blocks whose tokens stand in a phrase of six that another page
    has go, whatever the number of pages; copies of one page don't make it boilerplate."""
    rng = random.Random(11)
    words = [f"t{k}" for k in range(4000)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    menus, rare = [text(9) for _ in range(3)], [text(12) for _ in range(20)]
    pages = []
    for k in range(1100):
        parts = [menus[k % 3], text(30), text(rng.randint(1, 8))]
        if k % 50 == 0:
            parts.insert(1, rare[k // 100])  # on two pages of the host only
        if k % 4 == 1:
            parts.append(text(5) + " " + " ".join(menus[0].split()[:6]) + " " + text(4))
        pages.append((k, "http://hot.org/p", parts))
    pages += [(2000, "http://other.org/", [menus[0], text(20)]), (2001, "http://hot.org/p", pages[7][2]), (2002, "http://hot.org/p", pages[7][2])]
    pages.append((3000, "http://hot.org/marked", None))  # its menu counts, though the page needs no judge
    marked = text(8)
    pages.append((3001, "http://hot.org/p", [marked, text(25)]))
    html = lambda p: f"<body><nav>{marked}</nav><article><p>A</p></article></body>" if p is None else "<body>" + "".join(f"<div>{x}</div>" for x in p) + "</body>"
    got = {r.page_id: r.text for r in html_text.extract_text(spark.createDataFrame([(i, u, html(p)) for i, u, p in pages], "page_id long, url string, html string")).collect()}
    seen = {}
    for _, u, p in pages:
        stream = (marked if p is None else " ".join(p)).split()
        for k in range(len(stream) - 5):
            seen.setdefault((urlsplit(u).hostname, tuple(stream[k : k + 6])), set()).add(" ".join(stream) if p else "A")
    for i, u, p in pages:
        if p is None:
            assert got[i] == "A"
            continue
        stream, gone = " ".join(p).split(), set()
        for k in range(len(stream) - 5):
            if len(seen[urlsplit(u).hostname, tuple(stream[k : k + 6])]) > 1:
                gone |= set(range(k, k + 6))
        kept, at = [], 0
        for block in p:
            n = len(block.split())
            lost = len(gone & set(range(at, at + n)))
            at += n
            if lost < 0.5 * n or not lost:
                kept.append(block)
        assert got[i] == "\n".join(kept)
    assert sum(len(got[i].split("\n")) < len(p) for i, _, p in pages if p) > 1000


def test_html_every_page_goes_through_the_array(spark, monkeypatch):
    """Pages that mark their articles as well: the array finds how far their menu repeats, and their
    articles stay whole though they share a passage."""
    seen, runs = [], html_text.repeated_runs
    monkeypatch.setattr(html_text, "repeated_runs", lambda dealt, *a: seen.append((dealt, runs(dealt, *a))) or seen[0][1])
    menu, passage = " ".join(f"m{k}" for k in range(9)), " ".join(f"p{k}" for k in range(12))
    rows = [(k, "http://h.org/", f"<nav>{menu}</nav><article><p>{passage}</p><p>own {k}</p></article><footer>f{k}</footer>") for k in range(30)]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert {r.page_id: r.text for r in out.collect()} == {k: f"{passage}\nown {k}" for k in range(30)}
    (dealt, found), counts = seen[0], {}
    for r in found.collect():
        counts[r.run] = counts.get(r.run, 0) + len(r.places) // 4
    assert dealt.count() == 30 and counts == {9: 30, 8: 30, 7: 30, 6: 30}


def test_html_windows_keep_their_numbers():
    """Whatever the order in which a shuffle gives the pages of a block, copies and shared keys included."""
    rows = [(h, k, " ".join(f"{h}{k}w{j % 7}" for j in range(8 + k))) for h in ("", "a", "b") for k in range(-3, 4)] * 2
    make = lambda r: pa.table(dict(zip(("host", "page", "outside"), map(list, zip(*r)))))
    first = html_text.Streams(make(rows), 6)
    random.Random(4).shuffle(rows)
    again = html_text.Streams(make(rows), 6)
    assert len(first.at) > 50 and np.array_equal(first.hashes, again.hashes) and np.array_equal(first.at, again.at) and again.pages == first.pages


@pytest.mark.parametrize("held", [3, 40, 100_000])
def test_html_common_prefixes_against_brute_force(spark, monkeypatch, held):
    monkeypatch.setattr(html_text, "HELD", held)
    rng = random.Random(3)
    rows = []
    for k in range(600):
        tokens = tuple(rng.choice((1, 1, 2)) for _ in range(rng.randint(3, 8)))
        low = rng.randint(0, 3) if tokens[:3] != (1, 1, 1) or rng.random() < 0.1 else 0
        rows.append((rng.choice("ab"), np.array(tokens, ">u4").tobytes(), low, low + (rng.random() < 0.05), k))
    rows.sort(key=lambda r: r[:2])
    schema = pa.schema([("_block", pa.int32()), ("low", pa.int64()), ("high", pa.int64()), ("host", pa.string()), ("suffix", pa.binary()), ("places", pa.binary())])
    batches = [pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*((r[4], r[2], r[3], r[0], r[1], b"") for r in rows[i : i + 7])), schema)], schema=schema) for i in range(0, 600, 7)]
    marks = pa.schema([("_block", pa.int32()), ("run", pa.int32()), ("places", pa.binary())])
    got = [(r["_block"], r["run"]) for b in html_text._neighbours(3, 8, marks)(iter(batches)) for r in b.to_pylist()]
    want = {}
    for host, a, low, high, k in rows:
        for other, b, l, h, _ in rows:
            if host == other and {low, high, l, h} != {low} or (host == other and low != high):
                n = next((j for j in range(0, min(len(a), len(b)), 4) if a[j : j + 4] != b[j : j + 4]), min(len(a), len(b))) // 4
                want[k] = max(want.get(k, 0), n)
    assert len(got) == len(dict(got)) and dict(got) == {k: n for k, n in want.items() if n >= 3}


def test_html_odd(spark):
    rows = [(1, None, "<div>alone here</div>"), (1, None, "<div>alone here</div>"), (2, None, None), (3, "http://h/", "<p>" + "word " * 200_000), (4, "http://h/", "<b>"), (5, "http://h/", "a < b & c")]
    out = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert got[0] == got[1] == (1, "alone here") and got[2] == (2, "") and len(got[3][1]) == 5 * 200_000 - 1 and got[4] == (4, "") and got[5] == (5, "a < b & c")


AWKWARD = ["my col", "a.b", "`tick`", "N_WORDS", "Score", "N_Tokens", "Kept_Text", "Spans", "N_Bytes", "HOST", "_box", "_id", "_gone", "in_0", "box", "id", "row", "nested"]


@pytest.fixture(scope="module")
def awkward(spark):
    """Names with blanks, dots and quotes, names that differ from results by case, nested types, null and
    shared ids, repeated rows, empty and null texts, and one text of 3 MB."""
    rng = random.Random(12)
    words = [f"word{k}" for k in range(5000)]
    long = " ".join(rng.choice(words) for _ in range(400_000))
    texts = ["one two three four five six", "one two three four five six", "", None, long, "x" * 60, "Toxic words here. And others."]
    ids = [1, 1, 2, None, 3, 4, None]
    rows = [(i, t, *[f"v{k}" for k in range(len(AWKWARD) - 1)], [{"k": n}]) for n, (i, t) in enumerate(zip(ids, texts))]
    schema = "doc_id long, text string, " + ", ".join(f"`{c.replace('`', '``')}` string" for c in AWKWARD[:-1]) + ", nested array<struct<k:int>>"
    df = spark.createDataFrame(rows, schema)
    return df.union(df.limit(1))


def whole_operators(spark):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").withColumn("my col", F.lit(1))
    bench = spark.createDataFrame([(1, "two three four"), (1, "two three four"), (None, None)], "item_id long, text string").withColumn("a.b", F.lit(1))
    none = np.empty(0, np.int32), np.empty(0), -3.0
    return {
        "op2": (lambda d: substring_dedup.dedup_substrings(d), ["n_words", "n_removed", "kept_text", "spans"]),
        "op3": (lambda d: decontaminate.find_contamination(d, bench), ["n_words", "n_hit", "items", "spans", "contaminated"]),
        "op4": (lambda d: toxicity.score_toxicity(d, none), ["score", "predicted", "offending"]),
        "op5": (lambda d: bpe.encode_documents(d, queries.vocabulary()), ["n_tokens", "ids", "decoded"]),
        "op7": (lambda d: url_filter.filter_urls(d.withColumnsRenamed({"doc_id": "page_id", "text": "url"}), labels), ["host", "path", "rule", "reputation", "lower", "verdict"]),
        "op8": (lambda d: html_text.extract_text(d.withColumn("html", F.col("text")).withColumn("url", F.lit("http://x.org/"))), ["text"]),
        "op10": (lambda d: suffix_dedup.dedup_suffixes(d), ["n_bytes", "n_removed", "kept_bytes", "spans"]),
    }


@pytest.mark.parametrize("name", ["op2", "op3", "op4", "op5", "op7", "op8", "op10"])
def test_awkward_columns(spark, awkward, name):
    operator, results = whole_operators(spark)[name]
    out = operator(awkward)
    gone = {r.lower() for r in results}
    assert out.columns[-len(results) :] == results
    assert {c for c in AWKWARD if c.lower() not in gone} <= set(out.columns)
    assert not [c for c in out.columns[: -len(results)] if c.lower() in gone]
    rows = out.collect()
    assert len(rows) == awkward.count() and sorted(r["nested"][0]["k"] for r in rows) == [0, 0, 1, 2, 3, 4, 5, 6]
    assert {r["my col"] for r in rows} == {"v0"} and {r["a.b"] for r in rows} == {"v1"}
    assert operator(awkward.limit(0)).count() == 0


def test_awkward_other_queries(spark, awkward):
    assert near_dedup.near_duplicates(awkward).count() == 8
    path = new_path(spark, "tokens")
    token_files.write_tokens(awkward, path, queries.vocabulary())
    assert token_files.read_tokens(spark, path).count() == 8
    vectors = awkward.selectExpr("doc_id * 20 as vec_id", "array(1.0, cast(doc_id as double)) as embedding", "`my col`", "score")
    assert [tuple(r) for r in topk.top_k(vectors.union(spark.createDataFrame([(7, [1.0], "", ""), (9, [], "", "")], vectors.schema))).where("query_id = 20").orderBy("rank").collect()] == [(20, 1, 80, 64 * 64 * 5), (20, 2, 60, 64 * 64 * 4), (20, 3, 40, 64 * 64 * 3)]


def tables_for_pipeline(spark, tmp_path, rows):
    sf = f"file://{tmp_path}"
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("N_Words", F.lit(1)).withColumn("my col", F.lit("x")).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int("vileword" in (r[1] or ""))) for r in rows], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, CORPUS[2][1] or "zz"), (2, None)], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    return sf


def test_pipeline_against_brute_force(spark, tmp_path, tokenizer):
    """Each stage on its own input; toxicity by the model's own scores."""
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "bpe"]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in CORPUS]
    rows += [(1000 + k, f"{CORPUS[k][1]} vileword", "en", "s", 0) for k in range(0, 60, 2)]
    sf = tables_for_pipeline(spark, tmp_path, rows)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf)
        after = {r.doc_id: r for r in out.collect()}
        pairs = [(i, r.text) for i, r in before.items()]
        if name == "toxicity":
            model = toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"), toxicity.not_held_out())
            assert set(after) == {r.doc_id for r in toxicity.score_toxicity(docs, model).where("predicted = 0").collect()}
            assert set(after) < set(before)
        elif name == "near_dedup":
            assert set(after) == {k for k, v in brute.near_dedup(pairs).items() if v[2]}
        elif name == "substring_dedup":
            want = brute.substring_dedup(pairs)
            assert {i: brute.sha(" ".join(brute.WORD.findall(r.text or ""))) for i, r in after.items()} == {i: v[2] for i, v in want.items()}
            assert all(after[i].text == r.text and after[i].n_chars == r.n_chars for i, r in before.items() if not want[i][1])
        elif name == "decontamination":
            assert set(after) == {k for k, v in brute.contamination(pairs, [(1, CORPUS[2][1] or "zz")]).items() if not v[4]}
        else:
            want = brute.bpe(pairs, tokenizer)
            assert {i: (r.n_tokens, brute.sha(bytes(r.ids)), brute.sha(r.decoded)) for i, r in after.items()} == want
        if name != "bpe":
            assert out.columns == docs.columns and all(after[i]["my col"] == "x" and after[i]["N_Words"] == 1 for i in after)
        path = new_path(spark, name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    whole = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, sf).collect()}
    assert whole == {r.doc_id: r.n_tokens for r in docs.collect()}


def test_pipeline_odd(spark, tmp_path):
    import corpus_pipeline

    text = "p1 p2 p3 p4 p5 p6 p7 p8"
    odd = [(1, text, "en", None, 1), (1, text, "en", "s", 1), (1, "other words altogether", "en", "s", 1), (None, text, None, "s", None), (None, None, None, None, None), (2, "", "en", "s", 0)]
    out = corpus_pipeline.run(spark, tables_for_pipeline(spark, tmp_path / "odd", odd)).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in out) == [(1, "other words altogether"), (1, text), (1, text), (2, "")]
    assert corpus_pipeline.run(spark, tables_for_pipeline(spark, tmp_path / "none", [])).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels"):
        con.execute(f"create view {t} as select * from '/root/testdata/sf0.001/{t}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    columns = [d[0] for d in cur.description]
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").select(*columns)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, cur.fetchall()))
