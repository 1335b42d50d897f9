"""Fragments and covers against all windows."""

import random

from newsprism.operators import search


def all_windows(words, hits, most):
    best = None
    for begin in range(words):
        for end in range(begin + 1, min(words, begin + most) + 1):
            own = [w for k, w in hits if begin <= k < end]
            if own and any(k == begin for k, _ in hits) and any(k == end - 1 for k, _ in hits):
                rank = (-len(set(own)), end - begin, -len(own), begin)
                best = min(best, (rank, begin, end)) if best else (rank, begin, end)
    return best


def test_best_window_is_the_best_of_all():
    rng = random.Random(3)
    for _ in range(400):
        n = rng.randint(1, 60)
        hits = sorted({(rng.randrange(n), rng.choice("abc")) for _ in range(rng.randint(0, 9))})
        most = rng.choice([3, 8, 35])
        want = all_windows(n, hits, most)
        got = search.best_window(hits, n, fewest=1, most=most)
        assert (got is None) == (want is None)
        if want:
            assert got == want[1:], (hits, most)


def test_fragments_grow_and_dont_overlap():
    rng = random.Random(5)
    for _ in range(200):
        listed = [rng.choice(["x", "y", "Climate,", "deal"]) if rng.random() < 0.1 else f"w{k}" for k in range(rng.randint(1, 120))]
        text = search.fragments(" ".join(listed), ["climate", "deal"], count=3)
        parts = text.replace("<mark>", "").replace("</mark>", "").split(" ... ")
        at = 0
        for part in parts:
            own = part.split()
            k = next(k for k in range(at, len(listed)) if listed[k : k + len(own)] == own)
            assert len(own) <= 35 and (len(own) >= 15 or len(listed) < 60 or len(parts) > 1)
            at = k + len(own)
    assert search.fragments("a b c", ["zz"]) == "a b c" and search.fragments("", ["a"]) == "" and search.fragments(None, ["a"]) is None
    assert search.fragments("The Climate-deal of climate", ["climate"]) == "The <mark>Climate</mark>-deal of <mark>climate</mark>"


def test_covers_are_the_minimal_ones():
    rng = random.Random(9)
    for _ in range(300):
        spread = rng.sample(range(1, 30), 12)  # a place holds one word
        places = {w: sorted(spread[4 * k : 4 * k + rng.randint(0, 4)]) for k, w in enumerate("abc")}
        needed = rng.choice([["a"], ["a", "b"], ["a", "b", "c"]])
        entries = sorted((p, w) for w in needed for p in places[w])
        spans = {(x, y) for x, _ in entries for y, _ in entries if x <= y and all(any(x <= p <= y for p in places[w]) for w in needed)}
        minimal = {s for s in spans if not any(o != s and s[0] <= o[0] and o[1] <= s[1] for o in spans)}
        got = {(run[0][0], run[-1][0]) for run in search.covers(places, needed)}
        assert got == minimal, (places, needed)
