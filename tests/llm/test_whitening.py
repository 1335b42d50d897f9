"""Whitening against exact fractions in plain Python."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsprism.llm import queries, whitening

SF = "/root/testdata/sf0.001"


def brute(vectors, scale=256, components=4):
    """(n, deviation of each vector, whitened, explained) from exact covariances."""
    rows = [[math.floor(scale * c) for c in v] for v in vectors]
    fit = [list(t) for t in {tuple(r) for r in rows}]
    n, d = len(fit), len(fit[0])
    s = [sum(r[j] for r in fit) for j in range(d)]
    mean = [Fraction(x, n) for x in s]
    v = [[float(sum((r[i] - mean[i]) * (r[j] - mean[j]) for r in fit) / n) for j in range(d)] for i in range(d)]
    e, u = np.linalg.eigh(np.array(v))
    best = [k for k in np.argsort(-e) if e[k] > sum(e) * d * 2.3e-16][:components]
    deviation = [sum((n * r[j] - s[j]) ** 2 for j in range(d)) for r in rows]
    z = np.array([[float(r[j] - mean[j]) for j in range(d)] for r in rows]) @ u[:, best] / np.sqrt(e[best])
    return n, deviation, z, e[best] / sum(np.diag(v))


def same_up_to_sign(got, want):
    for k in range(want.shape[1]):
        assert min(np.abs(got[:, k] - want[:, k]).max(), np.abs(got[:, k] + want[:, k]).max()) < 1e-7


@pytest.mark.parametrize("offset", [0.0, 4000.0])
def test_whitening(spark, offset):
    rng = random.Random(2)
    vectors = [[offset + rng.gauss(0, 1 / (j + 1)) for j in range(6)] for _ in range(150)]
    vectors += vectors[:30] + [vectors[0]] * 50
    df = spark.createDataFrame(list(enumerate(vectors)), "vec_id long, embedding array<double>").repartition(5)
    out = sorted(whitening.whiten(df, whitening.fit_whitening(df)).collect(), key=lambda r: r.vec_id)
    n, deviation, z, explained = brute(vectors)
    assert {r.n for r in out} == {n} and [int(r.deviation) for r in out] == deviation
    same_up_to_sign(np.array([r.whitened for r in out]), z)
    assert np.abs(np.array(out[0].explained) - explained).max() < 1e-9 and out[0].identity_error < 1e-8


def test_scatter_is_exact_for_wide_numbers(spark):
    """Numbers of 60 bits need products of some 200: longs and doubles would not hold them."""
    rng = random.Random(4)
    rows = [[rng.randrange(-(1 << 60), 1 << 60) for _ in range(3)] for _ in range(40)]
    fit = spark.createDataFrame([(r,) for r in rows], "x array<long>").repartition(3)
    known = whitening.moments(fit)
    n, s = len(rows), [sum(r[j] for r in rows) for j in range(3)]
    assert known == {3: (n, s, max(abs(c) for r in rows for c in r))}
    want = [[sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in rows) for j in range(3)] for i in range(3)]
    assert whitening.scatter(fit, known)[3].tolist() == want


def test_bands_and_long_gemms(spark, monkeypatch):
    monkeypatch.setattr(whitening, "BAND", 5)
    monkeypatch.setattr(whitening, "GEMM_ROWS", 7)
    rng = np.random.default_rng(1)
    y = rng.integers(0, 2097143, (50, 4))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j], strict=True)) for j in range(4)] for i in range(4)]
    assert whitening.residue_products(y, 2097143).tolist() == [[w % 2097143 for w in row] for row in want]
    fit = spark.createDataFrame([(r,) for r in y.tolist()], "x array<long>").repartition(4)
    known = whitening.moments(fit)
    n, s, _ = known[4]
    exact = [[n * n * want[i][j] - n * s[i] * s[j] for j in range(4)] for i in range(4)]
    assert whitening.scatter(fit, known)[4].tolist() == exact


def test_primes():
    for bits in (1, 64, 300):
        p = whitening.primes(bits)
        assert math.prod(p) > 1 << bits and max(p) < 1 << 21 and all(all(q % k for k in range(2, 1500)) for q in p)
    m = whitening.remaindered({7: np.array([6, 3]), 11: np.array([10, 3])})
    assert m.tolist() == [-1, 3]


def test_whitening_odd(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [2.0, 1.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [3.0]), (8, [1e300, -1e300]), (9, [4.0, 4.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"N": F.lit("x"), "a b.c": F.lit(1), "whitened": F.lit(0)})
    out = whitening.whiten(df, whitening.fit_whitening(df)).collect()
    assert sorted((r.vec_id or 0, len(r.embedding)) for r in out) == [(0, 2), (1, 2), (1, 2), (7, 1), (8, 2), (9, 2)]
    by_id = {r.vec_id: r for r in out}
    assert by_id[7].whitened == [] and by_id[7].n == 1 and by_id[7].deviation == 0
    assert by_id[1].n == 4 and by_id[8].n == 4 and out[0]["a b.c"] == 1 and out[0].asDict()["whitened"] != 0
    same = spark.createDataFrame([(k, [0.5, 0.25]) for k in range(9)], "vec_id long, embedding array<float>")
    assert {tuple(r.whitened) for r in whitening.whiten(same, whitening.fit_whitening(same)).collect()} == {()}
    assert whitening.fit_whitening(df.limit(0)) == {} and whitening.whiten(df.limit(0), {}).count() == 0


def test_query_over_the_whole_table(spark):
    rows = sorted(spark.read.parquet(f"{SF}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
    n, deviation, z, explained = brute([r.embedding for r in rows])
    out = queries.op12_whiten(spark, SF).collect()
    assert len(out) == 4 * len(rows) and {r.n for r in out} == {n} and max(r.identity_error for r in out) < 1e-9
    assert [next(r.deviation for r in out if r.vec_id == v.vec_id) for v in rows[:20]] == deviation[:20]
    got = np.zeros((len(rows), 4))
    for r in out:
        got[r.vec_id, r.component - 1] = r.whitened
        assert abs(r.explained / explained[r.component - 1] - 1) < 1e-9
    same_up_to_sign(got, z)
