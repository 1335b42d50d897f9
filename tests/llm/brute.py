"""Brute-force versions of the operators' results, from plain Python over small inputs."""

import hashlib
import re
import struct
import zlib
from collections import defaultdict

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(data):
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def substring_dedup(docs, n=20):
    """docs: (doc_id, text) with distinct ids."""
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda r: r[0]):
        w = WORD.findall(text or "")
        gone = [False] * len(w)
        for k in range(len(w) - n + 1):
            g = tuple(w[k : k + n])
            if g in seen:
                gone[k : k + n] = [True] * n
            seen.add(g)
        out[i] = (len(w), sum(gone), sha(" ".join(x for x, y in zip(w, gone) if not y)))
    return out


def contamination(docs, items, n=13):
    grams = defaultdict(set)
    for name, text in items:
        w = ALNUM.findall(lower(text))
        size = min(n, len(w))
        for k in range(len(w) - size + 1 if size else 0):
            grams[tuple(w[k : k + size])].add(str(name))
    sizes = sorted({len(g) for g in grams})
    out = {}
    for i, text in docs:
        w = ALNUM.findall(lower(text))
        hit, found = [0] * len(w), set()
        for size in sizes:
            for k in range(len(w) - size + 1):
                names = grams.get(tuple(w[k : k + size]))
                if names:
                    hit[k : k + size] = [1] * size
                    found |= names
        h = sum(hit)
        out[i] = (len(w), h, len(found), sha(",".join(sorted(found))), h > 0 and 20 * h >= len(w))
    return out


def u32(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


def bpe(docs, tok):
    out = {}
    for i, text in docs:
        ids = tok.encode(text or "", add_special_tokens=False).ids
        out[i] = (len(ids), sha(u32(ids)), sha(tok.decode(ids, skip_special_tokens=False)))
    return out


def token_files(docs, tok, end=2):
    out, start = {}, 0
    for i, text in sorted(docs, key=lambda r: r[0]):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, end]
        out[i] = (start, len(ids), zlib.crc32(u32(ids)))
        start += len(ids)
    return out


def shingles(text, n=5):
    w = WORD.findall(lower(text))
    return {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_dedup(docs, percent=75):
    sets = {i: shingles(t) for i, t in docs}
    ids, root = sorted(sets), {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    by = defaultdict(list)
    for i in ids:
        for g in sets[i]:
            by[g].append(i)
    for i in ids:
        shared = defaultdict(int)
        for g in sets[i]:
            for j in by[g]:
                if j > i:
                    shared[j] += 1
        for j, s in shared.items():
            if 100 * s >= percent * (len(sets[i]) + len(sets[j]) - s):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def byte_dedup(docs, n=50):
    """docs: (doc_id, text); a window counts only if a smaller doc_id has it."""
    least, out = {}, {}
    data = {i: (t or "").encode() for i, t in docs}
    for i in sorted(data):
        for k in range(len(data[i]) - n + 1):
            least.setdefault(data[i][k : k + n], i)
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - n + 1):
            if least[b[k : k + n]] < i:
                gone[k : k + n] = b"\1" * n
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), sha(kept))
    return out


def top_k(rows, k=20, every=20):
    import math

    vecs = {i: [math.floor(64 * x) for x in v] for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in vecs if i % every == 0):
        s = sorted((-sum(a * b for a, b in zip(vecs[q], v)), i) for i, v in vecs.items() if i != q)[:k]
        out += [(q, r + 1, i, -x) for r, (x, i) in enumerate(s)]
    return out
