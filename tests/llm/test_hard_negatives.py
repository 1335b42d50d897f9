"""Hard negatives against brute force, and the trees' bounds."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprism.llm import hard_negatives as hn

SCHEMA = "vec_id long, label int, embedding array<double>"


def brute(rows, every=10, positives=5, k=5, scale=256):
    ok = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None and all(c is not None and math.isfinite(c) for c in v)]
    whole = sorted({(i, str(lab), tuple(math.floor(scale * c) for c in v)) for i, lab, v in ok})
    out = []
    for a in sorted({i for i, _, _ in whole if i % every == 0}):
        _, lab, q = min(r for r in whole if r[0] == a)
        scored = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, other) for i, other, v in whole if i != a and len(v) == len(q))
        for ps, p in [(-s, i) for s, i, other in scored if other == lab][:positives]:
            hard = [(-s, i) for s, i, other in scored if other != lab and 80 * ps <= -100 * s <= 100 * ps][:k]
            out += [(a, p, r, i, ps, s) for r, (s, i) in enumerate(hard, 1)]
    return sorted(out)


def mined(df, **how):
    return sorted(tuple(r) for r in hn.hard_negatives(df, every=10, **how).collect())


def clustered(n=400, d=5, seed=3):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(12)]
    return [(k, rng.randrange(4), [c + rng.gauss(0, 0.05) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("blocks,leaf", [(8192, 256), (40, 4)])
def test_hard_negatives(spark, monkeypatch, blocks, leaf):
    monkeypatch.setattr(hn, "BLOCK_ROWS", blocks)
    monkeypatch.setattr(hn, "LEAF", leaf)
    monkeypatch.setattr(hn, "LEAF_SAMPLE", 16)
    rows = clustered()
    rows += [(1000 + k, 1, rows[0][2]) for k in range(60)]  # copies of one vector, one of them an anchor
    want = brute(rows)
    assert len(want) > 150
    assert mined(spark.createDataFrame(rows, SCHEMA).repartition(3)) == want


def test_many_batches(spark, monkeypatch):
    monkeypatch.setattr(hn, "BATCH", 7)
    monkeypatch.setattr(hn, "BLOCK_ROWS", 50)
    rng = random.Random(8)
    rows = [(k, rng.randrange(3), [rng.gauss(0, 1) for _ in range(3)]) for k in range(300)]
    assert mined(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_hard_negatives_odd(spark):
    rows = clustered(60, 3)
    rows += [(100, None, [1.0, 1.0, 1.0]), (None, 1, [1.0, 1.0, 1.0]), (110, 1, None), (120, 1, [None, 1.0, 1.0]), (130, 1, [float("nan"), 1.0, 0.0]), (140, 1, [])]
    rows += [(150, 1, [0.5, 0.5]), (151, 1, [0.5, 0.6]), (152, 2, [0.5, 0.55])]  # another length
    rows += [rows[3], rows[10], (20, 0, [9.0, 9.0, 9.0]), (20, 9, [9.0, 9.0, 9.0])]  # repeats, and ids that repeat
    rows += [(160, 3, [0.0, 0.0, 0.0]), (161, 2, [0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"LABEL2": F.lit("x"), "a b.c": F.lit(1), "rank": F.lit(0), "score": F.lit("s")})
    assert mined(df) == brute(rows)
    assert mined(df.limit(0)) == []
    one = spark.createDataFrame([(0, 1, [1.0])], SCHEMA)
    assert mined(one) == []


def test_products_beyond_longs(spark):
    rows = [(k, k % 2, [1e17 * (k + 1), -3e16]) for k in range(12)]
    got = mined(spark.createDataFrame(rows, SCHEMA))
    assert {r[4] for r in got} == {2**63 - 1} and {r[5] for r in got} == {2**63 - 1}
    assert [r[3] for r in got if r[:2] == (0, 2)] == [1, 3, 5, 7, 9]


def test_a_walk_enters_only_the_annulus():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.01, (200, 4)) for c in range(20)])
    tree = hn.Tree(x, 32)
    leaves = sum(isinstance(n, np.ndarray) for n in tree.nodes)
    q = x[0]
    d = hn.distances(x, q)
    for low, high in ((0.0, 0.05), (2.0, 2.1), (10.0, 12.0)):
        seen, last = [], 0.0
        for bound, rows in tree.nearest(q, low, high):
            assert bound >= last and d[rows].min() >= bound - 1e-9
            last = bound
            seen.append(rows)
        got = np.concatenate(seen)
        assert set(np.flatnonzero((d >= low) & (d <= high))) <= set(got.tolist())
        assert len(seen) < 0.4 * leaves


def test_regions_are_skipped(spark):
    """On clustered rows an annulus meets few regions, and never misses one that has a row in it."""
    rows = clustered(600, 4, 9)
    whole = [[math.floor(256 * c) for c in v] for _, _, v in rows]
    top = max(math.sqrt(sum(c * c for c in v)) for v in whole)
    router = hn.Router(whole, top, 16)
    df = spark.createDataFrame([(r[0], str(r[1]), v, 4) for r, v in zip(rows, whole, strict=True)], "id long, label string, v array<long>, dim int")
    placed, counts = hn.dealt(df, router)
    members = {}
    for r in placed.collect():
        members.setdefault(r.region, []).append(r.v)
    assert len(members) > 10 and {g for _, g in counts} == set(members)
    met = 0
    for v in whole[:40]:
        q = np.array(v)
        high = int((q * q).sum())
        low = high * 9 // 10
        near, far = router.space.annulus(q.astype(float), low, high)
        for g, own in members.items():
            least, most = router.reach(q, g)
            hit = any(low <= int(q @ np.array(x)) <= high for x in own)
            assert not hit or least <= far and most >= near
            met += least <= far and most >= near
    assert met < 0.5 * 40 * len(members)
