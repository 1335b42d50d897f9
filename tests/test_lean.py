"""Steps shuffle and store ids and digests, not texts."""

import random
from pathlib import Path

import pytest

from newsprism import storage
from newsprism.plans import composite, stages
from newsprism.sources.model import Model

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder_of(spark, tmp_path, texts):
    rows = [(k, t, "en", f"src{k % 2}", len(t)) for k, t in enumerate(texts, 100)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def written(spark, monkeypatch, run):
    """Bytes that a query stores and shuffles."""
    paths, new_path = [], storage.new_path
    monkeypatch.setattr(storage, "new_path", lambda s, name: paths.append(new_path(s, name)) or paths[-1])
    sc, before = spark.sparkContext, shuffled(spark)
    rows = run().collect()
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return rows, sum(f.stat().st_size for p in paths for f in Path(p.removeprefix("file:")).rglob("*.parquet")) + shuffled(spark) - before


def shuffled(spark):
    sc = spark.sparkContext
    stages_ = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return sum(stages_.apply(k).shuffleWriteBytes() for k in range(stages_.size()))


def noise(n, seed=1):
    r = random.Random(seed)
    return " ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(n))


@pytest.mark.parametrize("name", ["txt6_evidence", "agg8_consensus", "agg13_gap_rows", "rd9_by_kind", "rd12_integrated", "rd13_ready", "src16_decisions"])
def test_stages_of_a_debate_hold_no_texts(spark, monkeypatch, tmp_path, name):
    texts = ["Title\n" + "\n".join(noise(400, 10 * k + j) for j in range(10)) for k in range(12)]
    m = Model(spark, folder_of(spark, tmp_path, texts))
    query = (composite.QUERIES | stages.QUERIES if hasattr(stages, "QUERIES") else composite.QUERIES)[name]
    rows, size = written(spark, monkeypatch, lambda: query(spark, m.sf_dir))
    assert rows or name in ("rd13_ready", "agg13_gap_rows")
    assert size < sum(map(len, texts)) / 3


@pytest.mark.parametrize("name", ["clu4_groups", "agg16_confidence"])
def test_long_claims_are_not_sent_once_a_word(spark, monkeypatch, tmp_path, name):
    texts = [noise(3000, k) for k in range(3)]
    path = folder_of(spark, tmp_path, [*texts, texts[0] + " more"])
    rows, size = written(spark, monkeypatch, lambda: composite.QUERIES[name](spark, path))
    assert len(rows) == {"clu4_groups": 3, "agg16_confidence": 2}[name]  # the second article is not in its story
    assert size < 15 * sum(map(len, texts))


@pytest.mark.parametrize("name", ["clu6_semantic_members", "clu7_contradictions", "clu8_candidates", "clu9_disputes"])
def test_long_claims_of_debates_are_not_sent_once_a_word(spark, monkeypatch, tmp_path, name):
    texts = [noise(3000, k) for k in range(3)]
    path = folder_of(spark, tmp_path, [*texts, texts[0] + " more"])
    rows = [(k, [1.0, 0.5], 0) for k in range(100, 104)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    _, size = written(spark, monkeypatch, lambda: composite.QUERIES[name](spark, path))
    assert size < 60 * sum(map(len, texts))


def test_languages_shuffle_no_word_of_each_text(spark, monkeypatch, tmp_path):
    vocabulary = noise(2000).split()
    r = random.Random(3)
    texts = [" ".join(r.sample(vocabulary, 1500)) for _ in range(20)]
    path = folder_of(spark, tmp_path, texts)
    rows, size = written(spark, monkeypatch, lambda: stages.language.detect(*(lambda d: (d.select("id", "text"), stages.language.train(d)))(Model(spark, path).table("documents").selectExpr("doc_id as id", "text", "lang as language"))))
    assert len(rows) == 20 and {x.language for x in rows} == {"en"}
    assert size < 4 * sum(map(len, texts))


def test_only_likely_pairs_get_features(spark):
    """Of pairs with a shared term those go on that a basis may hold for, and scores stay."""
    r = random.Random(4)
    words, names = [f"w{k}" for k in range(14)], [f"n{k}" for k in range(9)]
    some = lambda of, most: r.sample(of, r.randint(0, most))
    rows = [(k, 3600 * k, some(words, 7), some(names, 3), [], r.choice(["en", "de", None]), [r.random(), r.random() - 0.5]) for k in range(120)]
    f = spark.createDataFrame(rows, "article_id long, time_s long, terms array<string>, entities array<string>, topics array<string>, language string, embedding array<double>")
    stories = composite.stories
    every, likely = stories.candidate_pairs(f, f, semantic=True), stories.likely_pairs(f, f)
    assert likely.count() < 0.9 * every.count()
    times = f.select("article_id", "time_s")
    both = times.toDF("a_id", "a_t").crossJoin(times.toDF("b_id", "b_t")).where("a_id <> b_id and abs(a_t - b_t) <= 172800").select("a_id", "b_id")
    shown = lambda pairs: sorted(map(repr, stories.scored_pairs(pairs, f, f).collect()))
    assert shown(likely) == shown(every) == shown(both) != []
