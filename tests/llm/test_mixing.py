"""The mix against plain Python: targets by rounds, streams, van der Corput slots and blocks."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from newsprism.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, source string, text string"


def brute(docs, weights=(5, 2, 1), repeats=3, block=mixing.BLOCK):
    """Sizes with targets and words taken, and the mix as (slot, source, doc_id, begin, words)."""
    size = lambda t: len(WORD.findall(t or ""))
    sources = sorted({s for _, s, _ in docs}, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(sources)}
    own = {s: sum(size(t) for _, x, t in docs if x == s) for s in sources}
    full: set = set()
    while True:
        rest, left = sum(own.values()) - sum(repeats * own[s] for s in full), sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and rest * weight[s] > repeats * own[s] * left}
        if not more:
            break
        full |= more
    target = {s: float(repeats * own[s]) if s in full else rest * weight[s] / left for s in sources}
    take = {s: int(target[s] + 0.5) for s in sources}
    streams, out, pieces = {}, [], {}
    for s in sources:
        rows = sorted(((int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:8], 16), i is not None, i or 0, size(t), i) for i, x, t in docs if x == s))
        streams[s] = [(i, k) for _, _, _, n, i in rows for k in range(n)]
        used = [streams[s][k % own[s]] for k in range(take[s])]
        for r in range(0, len(used), block):
            pieces[s, r // block] = used[r : r + block]
        at = 0
        for *_, n, i in rows:
            copies = sum(max(0, min(turn * own[s] + at + n, take[s]) - turn * own[s] - at) for turn in range(repeats))
            out.append((i, n, own[s], target[s], copies))
            at += n
    turns = [s for s in sorted(sources, key=lambda s: (s is not None, (s or "").encode())) for _ in range(-(-take[s] // block))]
    bits = max(1, (len(turns) - 1).bit_length())
    rank, mix = {}, []
    for k in range(1 << bits):
        x = int(format(k, f"0{bits}b")[::-1], 2)
        if x < len(turns):
            s = turns[x]
            mix.append((k, s, pieces[s, rank.setdefault(s, 0)]))
            rank[s] += 1
    return out, mix


def corpus(n=120, seed=1):
    rng = random.Random(seed)
    names = ["big", "b", "B", "é", "zz", None, "with, 'quotes'"]
    docs = [(k, names[0] if k % 3 == 0 else rng.choice(names), " ".join(f"w{rng.randrange(50)}" for _ in range(rng.choice([0, 1, 7, 40, 90])))) for k in range(n)]
    return [*docs, (n, "tiny", "one two"), (n + 1, "empty", ""), (n + 2, "big", None), (n + 3, "big", "  \x0b a\tb\nc " + "x " * 900)]


def table(df):
    return sorted(((r.doc_id, r.size, r.source_size, r.target, r.taken) for r in df.collect()), key=repr)


@pytest.mark.parametrize("block", [7, 64])
def test_mix(spark, block, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK", 16)
    docs = corpus()
    want, mix = brute(docs, block=block)
    df = spark.createDataFrame(docs, SCHEMA).repartition(3)
    got = mixing.mixed_sizes(df, block=block)
    assert table(got) == sorted(want, key=repr)
    assert all(r.taken <= 3 * r.size for r in got.collect())
    spans = mixing.mix_sources(df, block=block).collect()
    by_slot = {}
    for r in sorted(spans, key=lambda r: (r.slot, r.at)):
        by_slot.setdefault((r.slot, r.source), []).extend((r.doc_id, k) for k in range(r.begin, r.begin + r.words))
    assert [(k, s, w) for (k, s), w in sorted(by_slot.items(), key=lambda x: x[0][0])] == mix
    # any stretch of the mix holds nearly its share of every source
    for name in {s for _, s, _ in mix}:
        share = sum(s == name for _, s, _ in mix) / len(mix)
        for end in range(1, len(mix), 5):
            assert abs(sum(s == name for _, s, _ in mix[:end]) - share * end) <= 6


def test_texts_of_the_mix(spark):
    docs = corpus(40)
    words = {i: WORD.findall(t or "") for i, _, t in docs}
    _, mix = brute(docs, block=10)
    got = mixing.mixed_texts(spark.createDataFrame(docs, SCHEMA), block=10).collect()
    assert sorted((r.slot, r.text) for r in got) == [(k, " ".join(words[i][p] for i, p in w)) for k, _, w in mix]


def test_slots_in_small_chunks(spark):
    rows = spark.createDataFrame([("=a", 1000), ("=b", 333), ("", 41), ("=c", 0)], "key string, take long")
    got = sorted((r.slot, r.key, r.rank) for r in mixing.schedule(rows, 1, 16).collect())
    assert got == sorted((r.slot, r.key, r.rank) for r in mixing.schedule(rows, 1).collect())
    assert len(got) == 1374 and len({s for s, _, _ in got}) == 1374
    for key, n in (("=a", 1000), ("=b", 333), ("", 41)):
        assert [r for _, k, r in got if k == key] == list(range(n))


def test_mix_odd(spark):
    # shared and missing ids are documents of their own; extra columns with clashing names do no harm
    odd = [(1, "s", "a b c"), (1, "s", "a b c"), (None, "s", "d e"), (None, None, "f"), (2, None, None), (3, "S", "")]
    df = spark.createDataFrame(odd, SCHEMA).withColumns({"size": F.lit("x"), "KEY": F.lit(1), "a b.c": F.lit(None).cast("string"), "target": F.array(F.lit(1))})
    assert table(mixing.mixed_sizes(df, block=2)) == sorted(brute(odd, block=2)[0], key=repr)
    assert mixing.mixed_sizes(df.limit(0)).count() == 0 and mixing.mix_sources(df.limit(0)).count() == 0
    nothing = spark.createDataFrame([(1, "a", ""), (2, None, None)], SCHEMA)
    assert table(mixing.mixed_sizes(nothing)) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_level_passes_64_bits(spark):
    huge = spark.createDataFrame([(5, 4 * 10**18), (2, 10), (1, 4 * 10**18), (5, 0)], "weight long, own long")
    rest, n = mixing.level(huge)
    assert (rest, n) == (8 * 10**18 + 10 - 30, 6)


def test_native(spark):
    df = spark.createDataFrame(corpus(30), SCHEMA)
    plan = mixing.mixed_sizes(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan
