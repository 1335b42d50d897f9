"""Picks, gates and plans against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from newsprism.operators import catalog, gates, relations, selection


def frame(spark, ids, name="id"):
    return spark.createDataFrame([(i,) for i in ids], f"{name} long")


def lanes(hint, recall, limit, offset=0):
    h, r = (limit + 1) // 2, limit // 2
    hint, recall = hint[(offset + 1) // 2 :], recall[offset // 2 :]
    a, b = hint[:h], recall[:r]
    missing = limit - len(a) - len(b)
    return a + hint[len(a) : len(a) + (missing if len(b) < r else 0)], b + recall[len(b) : len(b) + (missing if len(a) < h else 0)]


@pytest.mark.parametrize(("n", "m", "limit", "offset"), [(30, 30, 11, 0), (3, 30, 11, 0), (30, 2, 11, 0), (2, 2, 11, 0), (0, 9, 4, 0), (30, 30, 6, 3), (5, 30, 6, 3), (0, 0, 3, 0)])
def test_two_lanes(spark, n, m, limit, offset):
    hint, recall = list(range(n)), list(range(100, 100 + m))
    got = selection.two_lanes(frame(spark, hint), frame(spark, recall), [F.col("id")], limit, offset).orderBy("place").collect()
    a, b = lanes(hint, recall, limit, offset)
    assert [r.id for r in got] == a + b and [r.place for r in got] == list(range(1, len(a + b) + 1))


def in_waves(live, stale, wave, limit):
    out, live, stale = [], list(live), list(stale)
    while len(out) < limit and (live or stale):
        size = min(wave, limit - len(out))
        share = min(size, max(1, size * 8 // 10))
        a, b = live[:share], stale[: size - share]
        live, stale = live[len(a) :], stale[len(b) :]
        missing = size - len(a) - len(b)
        more = stale[:missing] if len(a) < share else live[:missing]
        live, stale = [x for x in live if x not in more], [x for x in stale if x not in more]
        out += a + b + more
    return out


@pytest.mark.parametrize(("n", "m", "wave", "limit"), [(40, 40, 10, 30), (40, 40, 10, 27), (5, 40, 10, 23), (40, 3, 10, 33), (0, 7, 5, 6), (9, 0, 5, 7), (20, 20, 1, 6), (3, 9, 1, 8), (40, 40, 7, 24)])
def test_waves(spark, n, m, wave, limit):
    live, stale = list(range(n)), list(range(100, 100 + m))
    got = selection.waves(frame(spark, live), frame(spark, stale), [F.col("id")], wave, limit).orderBy("place").collect()
    assert [r.id for r in got] == in_waves(live, stale, wave, limit)


@pytest.mark.parametrize(("n", "limit"), [(30, 12), (12, 12), (5, 12), (13, 12), (30, 1), (0, 3)])
def test_newest_and_oldest(spark, n, limit):
    ids = list(range(n))
    want = ids if n <= limit else ids[: max(1, int(limit * 0.8))] + ids[::-1][: limit - max(1, int(limit * 0.8))]
    got = selection.newest_and_oldest(frame(spark, ids), [F.col("id")], [F.desc("id")], limit).orderBy("place").collect()
    assert [r.id for r in got] == want


@pytest.mark.parametrize(("n", "newest", "rotating", "slot"), [(30, 5, 7, 3), (30, 5, 40, 9), (4, 5, 2, 1), (30, 0, 3, 11), (6, 5, 3, 2)])
def test_cohort(spark, n, newest, rotating, slot):
    ids = list(range(n))
    older = ids[newest:]
    start = slot * 997 % len(older) if older else 0
    want = ids[:newest] + [older[(start + k) % len(older)] for k in range(min(rotating, len(older)))]
    got = selection.cohort(frame(spark, ids), [F.col("id")], newest, rotating, slot).orderBy("place").collect()
    assert [r.id for r in got] == want


def test_conflict_hint(spark):
    rows = [("It will begin", "It will not begin", 3), ("5 people", "50 people", 2), ("five people", "50 people", 0), ("He denied it", "He said it", 1), ("not 5 denied", "7", 6), ("", "", 0)]
    df = spark.createDataFrame(rows, "l string, r string, want int")
    for side in "lr":
        for name, c in zip(("negated", "numbers", "disputes"), selection.hint_features(F.col(side))):
            df = df.withColumn(f"{side}_{name}", c)
    assert df.where(selection.conflict_hint("l", "r") != F.col("want")).count() == 0


def test_decisions(spark):
    asked = spark.createDataFrame([("a", "b"), ("c", "b")], "left_group string, right_group string")
    good = spark.createDataFrame([("b", "a", "disputes", 0.9), ("b", "c", "unrelated", 0.0)], "left_group string, right_group string, relation string, confidence double")
    assert gates.decisions(asked, good, ["disputes", "unrelated"]).count() == 0
    bad = good.limit(1).union(good.limit(1)).union(spark.createDataFrame([("x", "y", "what", float("nan"))], good.schema))
    assert sorted(r.rule for r in gates.decisions(asked, bad, ["disputes"]).collect()) == ["confidence", "decided_twice", "relation", "undecided", "unknown"]


def test_canonical_json(spark):
    df = spark.createDataFrame([("é\"", None, [2, 1], True)], "s string, n int, a array<int>, b boolean")
    got = df.select(gates.canonical_json({"z": F.col("s"), "n": F.col("n"), "a": F.col("a"), "b": F.col("b")}).alias("j")).first().j
    assert got == '{"a":[2,1],"b":true,"n":null,"z":"é\\""}'


def test_create_sources(spark):
    schema = "name string, slug string, url string"
    have = spark.createDataFrame([("Old", "old", "u0")], schema)
    wanted = spark.createDataFrame([(" OLD ", "a", "u1"), ("New", "old", "u2"), ("Third", "c", "u0"), ("Fourth", "d", "u4"), ("fourth", "e", "u5"), ("Sixth", "f", "u4")], schema)
    got = {r.slug: r.outcome for r in catalog.create_sources(have, wanted).collect()}
    assert got == {"a": "name_taken", "old": "slug_taken", "c": "url_taken", "d": "created", "e": "name_taken", "f": "url_taken"}


def test_dispute_candidates_find_what_all_pairs_find():
    rng = random.Random(2)
    for _ in range(40):
        words = [f"w{k}" for k in range(20)]
        rows = []
        for c in range(25):
            key = " ".join(rng.choice(words) for _ in range(rng.randint(1, 8)))
            rows.append({"story_id": 1, "claim_id": c, "article_id": c % 5, "source_id": c % 3, "claim_text": key, "claim_key": key, "title": rng.choice([None, "", "a b c", "a b c d", key]), "embedding": rng.choice([None, [rng.gauss(0, 1) for _ in range(3)]]), "semantic_model": rng.choice(["m", None])})
        groups = relations.group_claims(rows, "en")
        related = {(i, j) for i, j, _ in relations.contradictions(groups, "en")}
        want = []
        for i, g in enumerate(groups):
            for j in range(i + 1, len(groups)):
                h = groups[j]
                if (i, j) in related or len({m.row["source_id"] for x in (g, h) for m, _, _ in x["members"]}) < 2:
                    continue
                claim = max(relations.text_similarity(g["head"].key, h["head"].key), relations.semantic(g["head"], h["head"]))
                score = max(claim, relations.text_similarity(g["head"].row["title"], h["head"].row["title"]))
                if score >= relations.CANDIDATE:
                    want.append((-score, -claim, i, j))
        assert [(i, j) for i, j, _ in relations.dispute_candidates(groups, related)] == [(i, j) for _, _, i, j in sorted(want)[: relations.CANDIDATES]]


def test_halving():
    asked = []

    def fussy(pairs):
        asked.append(len(pairs))
        if 7 in pairs:
            raise RuntimeError("no")
        return [("unrelated", 0.5)] * len(pairs) if len(pairs) <= 3 else []

    got = relations.halving(fussy)(list(range(10)))
    assert [g[0] for g in got] == ["unrelated"] * 7 + ["insufficient"] + ["unrelated"] * 2 and max(asked) == 10
    assert relations.halving(fussy)([]) == []
