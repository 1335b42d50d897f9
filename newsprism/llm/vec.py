"""Array primitives on UTF-8 bytes shared by the corpus operators.

Every function works on a *chunk*: the UTF-8 bytes of some documents joined by one
separator byte, so that word boundaries, word hashes and window hashes come out of a few
numpy passes instead of a Python loop over words.  Chunks are a few MB; callers cut their
input with :func:`chunks`, so memory follows the chunk (or the longest document).
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
CHUNK_BYTES = 2 << 20
#: Powers of a base that a worker keeps.
KEEP = 1 << 21
#: Words longer than this are hashed one by one; shorter ones eight bytes at a time.
LONG_WORD = 256
#: Odd base of the rolling window hash, and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)

SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
#: Separators of alphanumeric words once A-Z are lower-cased: all ASCII but digits and letters.
NON_ALNUM = np.zeros(256, bool)
NON_ALNUM[[*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

_LANE = np.array([(1 << (8 * r)) - 1 for r in range(9)], dtype=U64)
_powers = {BASE: np.ones(1, U64), BASE_INV: np.ones(1, U64)}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64.  Tables of up to KEEP powers are kept."""
    have = _powers[base]
    if len(have) < n:
        steps = np.full(max(n, 1 << 16), base, U64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=U64)
        if len(have) <= KEEP:
            _powers[base] = have
    return have[:n]


def release() -> None:
    """Gives memory back that a worker keeps from earlier tasks of other operators."""
    for base in _powers:
        _powers[base] = np.ones(1, U64)
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser (in place): spreads every input bit over the word."""
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def utf8(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """A string column as bytes; null counts as empty."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def chunks(texts: list[bytes], limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of consecutive texts of at most `limit` bytes each (one text at least)."""
    i = size = 0
    for j, text in enumerate(texts):
        if j > i and size + len(text) > limit:
            yield i, j
            i, size = j, 0
        size += len(text) + 1
    if i < len(texts):
        yield i, len(texts)


class Words:
    """Word boundaries of a chunk of texts.

    buf       bytes of the chunk, a separator before, between and after the texts
    starts    first byte of each word; ends: one past its last byte (always a separator)
    first     index of each text's first word, and the number of words at the end
    """

    def __init__(self, texts: list[bytes], sep: np.ndarray = SPACES, fold: bool = False, glue: bytes = b" "):
        raw = np.frombuffer(glue + glue.join(texts) + glue, np.uint8)
        self.buf = LOWER[raw] if fold else raw
        inside = ~sep[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        self.starts, self.ends = edges[0::2], edges[1::2]
        begin = np.cumsum([1, *(len(t) + 1 for t in texts)])
        self.begin = begin
        self.first = np.searchsorted(self.starts, begin)
        self.n = len(self.starts)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.starts, self.ends)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte span, eight bytes a step."""
    size = ends - starts
    h = mix(size.astype(U64) + U64(0x51_7C_C1_B7_27_22_0A_95))
    if not len(size):
        return h
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(buf) + 1,), dtype="<u8", buffer=padded, strides=(1,))
    big = size > LONG_WORD
    todo = np.flatnonzero(~big) if big.any() else np.arange(len(size))
    at, left = starts[todo], size[todo]
    first = True
    while len(todo):
        lane = eight[at] & _LANE[np.minimum(left, 8)]
        h[todo] = mix((h if first and len(todo) == len(h) else h[todo]) * U64(BASE) ^ lane)
        first = False
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(big):
        h[k] = xxhash.xxh64_intdigest(buf[starts[k] : ends[k]].tobytes(), seed=7)
    return h


def windows(h: np.ndarray, n: int) -> np.ndarray:
    """Rabin-Karp hash of every n consecutive values: sum of h[i+j] * BASE**j, then mixed."""
    if len(h) < n:
        return np.empty(0, U64)
    total = np.zeros(len(h) + 1, U64)
    np.cumsum(h * powers(BASE, len(h)), out=total[1:])
    out = total[n:] - total[:-n]
    out *= powers(BASE_INV, len(out))
    return mix(out)


def inside_texts(first: np.ndarray, n: int, total: int) -> np.ndarray:
    """Of the total - n + 1 window starts of a chunk, those whose window ends in its own text."""
    ok = np.zeros(max(total - n + 1, 0), np.int8)
    step = np.zeros(len(ok) + 1, np.int32)
    size = np.diff(first)
    full = size >= n
    np.add.at(step, first[:-1][full], 1)
    np.add.at(step, np.minimum(first[1:][full] - n + 1, len(ok)), -1)
    return np.cumsum(step[:-1]) > 0


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Mask of `total` places, true where some window [s, s + n) lies."""
    step = np.zeros(total + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + n, total), -1)
    return np.cumsum(step[:-1]) > 0


def runs(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], mask.view(np.int8), [0]])))
    return edges[0::2], edges[1::2]
