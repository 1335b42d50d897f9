"""Providers with planted faults: each is a row, none fails the job."""

import math

import pytest

from newsprism.operators import providers as p


def stub():
    """Made here, so that it travels with the job."""

    def vectors(texts):
        """A stub: vectors of two numbers, faults by what a batch holds."""
        first = texts[0]
        items = [{"index": k, "embedding": [float(len(t)), 1.0]} for k, t in enumerate(texts)][::-1]
        if first == "boom":
            raise RuntimeError("no")
        if first == "limited":
            raise p.RateLimited(0.0)
        faults = {"gap": items[1:], "list": "x", "nan": [*items[:-1], {"index": 0, "embedding": [math.nan, 1.0]}], "word": [*items[:-1], {"index": 0, "embedding": ["a", 1.0]}], "none": [*items[:-1], {"index": 0, "embedding": []}], "dim": [*items[:-1], {"index": 0, "embedding": [1.0]}], "item": [1]}
        return faults.get(first, items)

    return vectors


WANT = {"ok": "ok", "boom": "failed: RuntimeError", "limited": "rate_limited", "gap": "indexes", "list": "malformed", "nan": "not_finite", "word": "not_numeric", "none": "empty_vector", "dim": "dimensions", "item": "malformed"}


def test_each_fault_is_a_row(spark):
    rows = [(f"{name}-{k}", name if k == 0 else f"{name} {k}") for name in WANT for k in range(3)]
    df = spark.createDataFrame(rows, "id string, text string").coalesce(1)
    out = p.embed(df, stub(), 2, batch=3, retries=1).collect()
    assert len(out) == len(rows)
    for r in out:
        want = WANT[r.id.split("-")[0]]
        assert r.outcome == want and (r.embedding is None) == (want != "ok")
        assert want != "ok" or r.embedding == [float(len(r.text)), 1.0]
    assert {r.outcome for r in p.embed(df.where("id like 'ok%'"), stub(), 3, batch=3).collect()} == {"dimensions"}


def test_pacing_and_retries():
    now, slept, asked = [0.0], [], []

    def sleep(s):
        slept.append(s)
        now[0] += s

    def provider(rows):
        asked.append(now[0])
        if len(asked) in (2, 3):
            raise p.RateLimited(7.0 if len(asked) == 2 else None)
        return "answer"

    call = p.Caller(provider, 2.0, 3, lambda: now[0], sleep)
    assert call([1]) == ("answer", 1) and call([2]) == ("answer", 3)
    assert slept == [2.0, 7.0, 2.0] and asked == [0.0, 2.0, 9.0, 11.0]
    final = p.Caller(lambda _: (_ for _ in ()).throw(p.RateLimited(final=True)), 0, 3, lambda: 0.0, sleep)
    with pytest.raises(p.Fault, match="rate_limited"):
        final([1])


def test_decisions(spark):
    def decide(pairs):
        out = [{"left_group": r["right_group"], "right_group": r["left_group"], "relation": "disputes", "confidence": 0.9, "reason": "  because " + "x" * 600} for r in pairs]
        kind = pairs[0]["left_group"].split("-")[0]
        if kind == "twice":
            out.append(out[0])
        if kind in ("relation", "confidence"):
            out[0][kind] = {"relation": "likes", "confidence": 1.5}[kind]
        if kind == "pairs":
            out[0]["left_group"] = "other"
        if kind == "bool":
            out[0]["confidence"] = True
        return {"decisions": out} if kind != "shape" else out

    kinds = {"fine": "ok", "twice": "decided_twice", "relation": "relation", "confidence": "confidence", "pairs": "pairs", "bool": "malformed", "shape": "malformed"}
    rows = [(f"{k}-{n}", f"{k}+{n}") for k in kinds for n in range(2)]
    out = p.classify(spark.createDataFrame(rows, "left_group string, right_group string").coalesce(1), decide, ["disputes", "unrelated"], batch=2).collect()
    assert {r.left_group.split("-")[0]: r.outcome for r in out} == kinds and len(out) == len(rows)
    fine = [r for r in out if r.outcome == "ok"]
    assert all(r.relation == "disputes" and r.confidence == 0.9 and len(r.reason) == 500 for r in fine)
