"""Documents dealt into blocks of consecutive ids, and packed exchanges between blocks.

An operator that compares every window of a corpus would shuffle one row a window.  Instead a
block (some MB of documents with consecutive ids) sorts its window hashes, cuts them by hash
range into *buckets* and sends each bucket one binary value: hashes and delta-coded places.
Blocks are id ranges, so (block, place in block) orders places as (doc_id, start) does, and
neither ids nor lengths travel with a window.  A hash that repeats inside a block travels once,
so a hot passage costs a bucket one entry a block.

Everything is a plain shuffle of rows: lost executors recompute their blocks.
"""

from __future__ import annotations

import math
import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns

BLOCK_BYTES = 6 << 20
#: Blocks grow with the square root of the input up to this factor, so that blocks times buckets
#: stays far below the number of windows.
BLOCK_GROWTH = 8
ID, TEXT, BLOCK = "_id", "_text", "_block"


class Layout:
    """How a corpus is dealt: number of blocks, their upper id bounds, and its size in bytes."""

    def __init__(self, n: int, bounds: list[int], n_bytes: int, parts: int):
        self.n, self.bounds, self.n_bytes, self.parts = n, bounds, n_bytes, parts

    def buckets(self, items: float, each: int = 1_500_000) -> int:
        return max(self.parts, math.ceil(items / each))


def partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def count(size: int, parts: int) -> int:
    """Number of blocks of a corpus of so many bytes."""
    each = BLOCK_BYTES * min(BLOCK_GROWTH, max(1.0, math.sqrt(size / (1 << 30))))
    return max(parts, math.ceil(size / each))


def plan(own: Columns, id_col: str, text_col: str) -> Layout:
    """Two column-pruned aggregates: bytes of text, then quantiles of the ids."""
    docs, id_ = own.df, own[id_col].cast("long")
    parts = partitions(docs)
    size = docs.agg(F.sum(F.octet_length(own[text_col].cast("string")))).first()[0] or 0
    n = count(size, parts)
    cuts = [i / n for i in range(1, n)]
    bounds = docs.agg(F.percentile_approx(id_, cuts, max(10_000, 20 * n))).first()[0] if cuts else []
    return Layout(n, [int(b) for b in bounds or []], size, parts)


def block_of(df: DataFrame, id_col: str, bounds: list[int]) -> DataFrame:
    """Adds the number of bounds below the id (null: 0), by binary search in the plan."""
    df = df.withColumn(BLOCK, F.lit(0))
    if not bounds:
        return df
    table = F.lit(bounds).cast("array<bigint>")
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        there = F.try_element_at(table, F.col(BLOCK) + step)
        df = df.withColumn(BLOCK, F.when(there < F.col(id_col), F.col(BLOCK) + step).otherwise(F.col(BLOCK)))
        step >>= 1
    return df


def by_number(df: DataFrame, n: int, column: str, even: bool) -> DataFrame:
    """`n` partitions by a column of numbers below n.  Even: each number has a partition of its own; by
    their hash, several share one and others stay empty."""
    return df.repartitionById(n, F.col(column)) if even else df.repartition(n, column)


def deal(own: Columns, id_col: str, text_col: str, layout: Layout, even: bool = False) -> DataFrame:
    """Rows (_box, _id, _text, _block), partitioned by block."""
    rows = own.rows(**{ID: own[id_col].cast("long"), TEXT: own[text_col].cast("string")})
    return by_number(block_of(rows, ID, layout.bounds), layout.n, BLOCK, even)


def in_order(table: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A block's rows by (id, text), null ids first; and the texts' bytes, null as empty."""
    from newsprism.llm.vec import utf8

    ids, texts = table[ID].to_pylist(), utf8(table[TEXT])
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
    return table.take(pa.array(order, pa.int64())), [texts[i] for i in order]


def group_no(ids: list[int | None]) -> np.ndarray:
    """Number of the document of each row in order: rows of one id are one document."""
    change = [False, *(a != b for a, b in zip(ids, ids[1:], strict=False))][: len(ids)]
    return np.cumsum(np.array(change, bool)) if ids else np.empty(0, np.int64)


# -- packing ---------------------------------------------------------------------------------


def pack_places(places: np.ndarray) -> bytes:
    """Ascending non-negative places: gaps in the least width that fits, compressed."""
    if not len(places):
        return b""
    gaps = np.diff(places, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if w == 8 or int(gaps.max()) < 1 << (8 * w))
    return bytes([width]) + zstandard.compress(gaps.astype(f"<u{width}").tobytes(), 1)


def unpack_places(data: bytes) -> np.ndarray:
    if not data:
        return np.empty(0, np.int64)
    return np.cumsum(np.frombuffer(zstandard.decompress(data[1:]), f"<u{data[0]}").astype(np.int64))


def hash_width(items: float, buckets: int) -> int:
    """Bytes of a hash that, beside the bucket's number, leave under 2**-10 false matches expected, at
    any size: 5 to 16, of which the first eight hold the bucket's number if there are more."""
    bits = 2 * math.log2(max(items, 2)) + 9
    small = math.ceil((bits - math.log2(buckets)) / 8)
    return max(5, small if small <= 8 else min(16, math.ceil(bits / 8)))


def cut(h: np.ndarray, width: int) -> bytes:
    """The lowest bytes of hashes, given as a column of 64 bits or two."""
    return np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8 * h.shape[1])[:, :width].tobytes()


def uncut(data: bytes, width: int) -> np.ndarray:
    """Columns of 64 bits."""
    raw = np.frombuffer(data, np.uint8).reshape(-1, width)
    out = np.zeros((len(raw), 8 * (1 + (width > 8))), np.uint8)
    out[:, :width] = raw
    return out.view("<u8")


def order_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal hashes together, and where each new one begins in it."""
    order = np.argsort(h[:, 0]) if h.shape[1] == 1 else np.lexsort(h.T)
    own = h[order]
    return order, np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]).any(1)])) if len(h) else np.empty(0, np.int64)


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


SENT = "_bucket int, _block int, n int, hashes binary, places binary"
FOUND = "_block int, places binary"


def send(block: int, h: np.ndarray, places: np.ndarray, buckets: int, width: int, local: np.ndarray) -> pa.Table:
    """One row a bucket with the hashes (each once) and ascending places; `local` places, found
    without looking elsewhere, travel in a row of no hashes to one bucket and come back with the rest."""
    h = h[:, None] if h.ndim == 1 else h
    which = bucket_of(h[:, 0], buckets).astype(np.int32)
    order = np.lexsort((places, which))
    edges = np.searchsorted(which[order], np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(edges)):
        own = order[edges[b] : edges[b + 1]]
        rows.append((int(b), block, len(own), cut(h[own], width), pack_places(places[own])))
    if len(local):
        rows.append((block % buckets, block, 0, b"", pack_places(local)))
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, (pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["_bucket", "_block", "n", "hashes", "places"])


def first_in_block(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each hash, ascending, and places of the others."""
    order, begin = order_of(h)
    if len(begin) == len(h):
        return np.arange(len(h)), np.empty(0, np.int64)
    least = np.minimum.reduceat(order, begin)
    mask = np.zeros(len(h), bool)
    mask[least] = True
    return np.flatnonzero(mask), np.flatnonzero(~mask)


def match(width: int, later_only: bool):
    """Reducer of a bucket: places whose hash another block sent too - all of them, or all but
    the first in order of (block, place) - one row for each block that has any."""

    def found(table: pa.Table) -> pa.Table:
        table = table.sort_by("_block")
        blocks, sizes = table["_block"].to_numpy(), table["n"].to_numpy()
        out: dict[int, list[np.ndarray]] = {}
        full = np.flatnonzero(sizes)
        for k in np.flatnonzero(sizes == 0):
            out.setdefault(int(blocks[k]), []).append(unpack_places(table["places"][int(k)].as_py()))
        if len(full):
            h = uncut(b"".join(table["hashes"][int(k)].as_py() for k in full), width)
            at = np.concatenate([unpack_places(table["places"][int(k)].as_py()) | int(blocks[k]) << 40 for k in full])
            order, begin = order_of(h)
            size = np.diff(np.append(begin, len(h)))
            at = at[order]
            hit = np.repeat(size > 1, size)
            if later_only:
                hit &= at != np.repeat(np.minimum.reduceat(at, begin), size)
            at = np.sort(at[hit])
            edges = np.searchsorted(at, blocks[full].astype(np.int64) << 40)
            for k, (i, j) in zip(full, zip(edges, [*edges[1:], len(at)], strict=True), strict=True):
                if j > i:
                    out.setdefault(int(blocks[k]), []).append(at[i:j] & ((1 << 40) - 1))
        return pa.table({"_block": pa.array(list(out), pa.int32()), "places": pa.array([pack_places(np.sort(np.concatenate(x))) for x in out.values()], pa.binary())})

    return found


def exchange(sent: DataFrame, buckets: int, width: int, later_only: bool, blocks: int, even: bool = False) -> DataFrame:
    """Rows (_block, places): what each block learns, partitioned like the blocks."""
    found = by_number(sent, buckets, "_bucket", even).groupBy("_bucket").applyInArrow(match(width, later_only), FOUND)
    return by_number(found, blocks, BLOCK, even)


def gathered(table: pa.Table) -> np.ndarray:
    """The ascending places of a block's rows."""
    got = [unpack_places(x) for x in table["places"].to_pylist()]
    return np.unique(np.concatenate(got)) if got else np.empty(0, np.int64)

