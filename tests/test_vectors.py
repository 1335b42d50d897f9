"""The cosine join against all pairs."""

import random

import numpy as np
import pytest

from newsprism.operators import vectors

SCHEMA = "article_id long, time_s long, embedding array<double>"


def brute(a, b, least, window):
    out = set()
    for i, s, v in a:
        for j, t, w in b:
            if i == j or s is None or t is None or abs(s - t) > window or not v or not w or len(v) != len(w) or None in v or None in w:
                continue
            n = np.linalg.norm(v) * np.linalg.norm(w)
            if n and np.dot(v, w) / n >= least:
                out.add((i, j))
    return out


def clustered(n, seed, first=0):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(6)] for _ in range(15)]
    return [(first + k, rng.randrange(5000), [c + rng.gauss(0, 0.3) for c in rng.choice(centres)]) for k in range(n)]


@pytest.mark.parametrize("block", [2048, 10])
def test_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    a, b = clustered(250, 1), clustered(200, 1, 150)
    a += [(900, 10, None), (901, None, a[0][2]), (902, 10, [0.0] * 6), (903, 10, [None, 1.0, 0.0, 0.0, 0.0, 0.0]), (904, 20, [1.0, 2.0]), (905, 20, [])]
    b += [(950, 30, [2.0, 4.0]), (951, 30, [-1.0, -2.0]), (952, 10**7, [1.0, 2.0])]
    got = [(r.a_id, r.b_id) for r in vectors.cosine_pairs(spark.createDataFrame(a, SCHEMA), spark.createDataFrame(b, SCHEMA), 0.9, 1000).collect()]
    want = brute(a, b, 0.9, 1000)
    assert set(got) == want and len(got) == len(want) > 200
    assert vectors.cosine_pairs(spark.createDataFrame([], SCHEMA), spark.createDataFrame(b, SCHEMA), 0.9, 1000).count() == 0


def test_far_blocks_dont_meet(spark, monkeypatch):
    """With clusters apart most blocks are never sent to each other, and no pair below the threshold leaves."""
    met = []
    real = vectors.stored
    monkeypatch.setattr(vectors, "stored", lambda df, name, *a: met.append(df) or real(df, name, *a) if name == "meetings" else real(df, name, *a))
    rng = random.Random(4)
    rows = [(k, k % 900, [c + rng.gauss(0, 0.01) for c in np.eye(8)[k % 8].tolist()]) for k in range(800)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = vectors.cosine_pairs(df, df, 0.9, 1000).count()
    assert got == 8 * 100 * 99
    blocks = met[0].select("a_slot", "a_pivot", "a_part").distinct().count()
    assert met[0].count() < 0.5 * blocks * blocks
