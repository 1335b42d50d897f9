"""Suffix-array dedup: bytes that a 50-byte string of an earlier document covers are removed.

A suffix array of the whole corpus needs every suffix to meet its neighbours.  Two exchanges of
blocks (:mod:`blocks`) bring together only those that can match:

1. Anchors.  Every window of LENGTH bytes is named by the least hash among its GRAM-byte grams, so
   equal windows have equal anchors; consecutive windows of one anchor are a *run*.  Blocks
   exchange their anchors' hashes and learn which stand in other blocks too.
2. Pieces.  The text under a run whose anchor several documents share is a piece; each distinct
   piece of a block travels once, to the bucket of its anchor, with its first document.
3. There equal pieces are settled by their first document.  Pieces that differ go into a suffix
   array (truncated to LENGTH bytes).  Over it, previous and next smaller values of the document
   order give each suffix its nearest earlier documents, and the longest common prefix with them
   its longest previous factor; LENGTH or more is a match.
4. Blocks mark the matched windows of all their documents and cut the bytes they cover.

Matches are compared byte by byte, equal pieces as well, so hashes only route them.  The texts are shuffled once (one
exchange, read three times); hot passages cost a block one entry each.

Defined cases: null text counts as empty; null ids come before all others; rows that share an id
are one document, so they don't remove each other's bytes; texts of under LENGTH bytes lose
nothing; what is left of a character whose other bytes were removed stays as bytes in
kept_bytes; extra columns pass through, and a result column replaces an input column of its name.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from newsprism.llm import blocks as B
from newsprism.llm import vec
from newsprism.llm.columns import BOX, Columns, arrow_schema, boxed_schema

LENGTH, GRAM = 50, 26
SPAN = LENGTH - GRAM + 1
CHUNK_BYTES = 1 << 20
#: Bytes of an anchor's hash beside its bucket's number; a false match only costs a comparison.
ANCHOR_WIDTH = 4
#: Anchors of a bucket, and suffixes that are put in order at once.
BUCKET, SLICE = 400_000, 400_000
RESULT = "n_bytes bigint, n_removed bigint, kept_bytes binary, spans array<struct<start:int,end:int>>"
PIECES = "_bucket int, _block int, n int, places binary, data binary"
ANSWER = "_block int, places binary, masks binary"


def _sums(buf: np.ndarray) -> np.ndarray:
    out = np.zeros(len(buf) + 1, np.uint64)
    values = vec.mix(np.arange(1, 257, dtype=np.uint64))
    np.cumsum(values[buf] * vec.powers(vec.BASE, len(buf)), out=out[1:])
    return out


@dataclass
class Runs:
    """The runs of a block, in order of place: document (number in the block), text, first byte of
    the first window in its text, number of windows, hashes of anchor and piece."""

    doc: np.ndarray
    text: np.ndarray
    start: np.ndarray
    n: np.ndarray
    anchor: np.ndarray
    piece: np.ndarray

    def __len__(self) -> int:
        return len(self.doc)


def find_runs(texts: list[bytes], doc: np.ndarray) -> Runs:
    parts: list[tuple[np.ndarray, ...]] = []
    for i, j in vec.chunks(texts, CHUNK_BYTES):
        buf = np.frombuffer(b"".join(texts[i:j]), np.uint8)
        begin = np.cumsum([0, *(len(t) for t in texts[i:j])])
        if len(buf) < LENGTH:
            continue
        sums = _sums(buf)
        inverse = vec.powers(vec.BASE_INV, len(buf) + 1)
        grams = vec.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[: len(buf) - GRAM + 1])
        # hash above, place below: the least is the leftmost of the least hash
        bits = np.uint64(len(grams).bit_length())
        packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
        least = packed
        width = 1
        while width * 2 <= SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < SPAN:
            least = np.minimum(least[: len(grams) - SPAN + 1], least[SPAN - width :])
        at = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        full = np.flatnonzero(np.diff(begin) >= LENGTH)
        step = np.zeros(len(at) + 1, np.int32)
        np.add.at(step, begin[full], 1)
        np.add.at(step, begin[full + 1] - LENGTH + 1, -1)
        valid = np.cumsum(step[:-1]) > 0
        new = np.empty(len(at), bool)
        new[0] = True
        new[1:] = (at[1:] != at[:-1]) | ~valid[:-1]
        new[begin[full]] = True
        heads = np.flatnonzero(new & valid)
        stops = np.flatnonzero(np.concatenate([(new | ~valid)[1:], [True]]) & valid) + 1
        ends = stops + LENGTH - 1
        anchor = grams[at[heads]]
        piece = vec.mix((sums[ends] - sums[heads]) * inverse[heads] + (ends - heads).astype(np.uint64) * np.uint64(256) + (at[heads] - heads).astype(np.uint64))
        text = np.searchsorted(begin, heads, "right") - 1
        # empty texts share their begin with the next: the last one that begins there is meant
        parts.append((doc[i:j][text], text + i, heads - begin[text], stops - heads, anchor, piece))
    if not parts:
        none = np.empty(0, np.int64)
        return Runs(none, none, none, none, none.astype(np.uint64), none.astype(np.uint64))
    return Runs(*(np.concatenate(x) for x in zip(*parts, strict=True)))


def _block(table: pa.Table, numbered: bool = True) -> tuple[int, pa.Table, list[bytes], Runs]:
    """Number, rows, texts and runs of a block; numbered: runs have one piece only if their bytes are equal."""
    rows, texts = B.in_order(table)
    runs = find_runs(texts, B.group_no(rows[B.ID].to_pylist()))
    if numbered and len(runs):
        begin = np.cumsum([0, *(len(t) for t in texts)])
        runs.piece = _alike(runs.piece, np.frombuffer(b"".join(texts), np.uint8), begin[runs.text] + runs.start, runs.n + LENGTH - 1)
    return table[B.BLOCK][0].as_py(), rows, texts, runs


def _firsts(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending places of the first of each key, and for every place the number of its first."""
    _, first, inverse = np.unique(key, return_index=True, return_inverse=True)
    order = np.argsort(first)
    number = np.empty(len(first), np.int64)
    number[order] = np.arange(len(first))
    return first[order], number[inverse]


def _emit(buckets: int):
    def emit(table: pa.Table) -> pa.Table:
        block, _, _, runs = _block(table, numbered=False)
        first, _ = _firsts(runs.anchor)
        return B.send(block, runs.anchor[first], first, buckets, ANCHOR_WIDTH, np.empty(0, np.int64))

    return emit


def _alike(key: np.ndarray, data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A number for each span, equal for spans of equal bytes only.  Their hashes tell which to compare;
    should two differ under one hash, their bytes tell them apart."""
    _, first, kind = np.unique(key, return_index=True, return_inverse=True)
    head = first[kind]
    again = np.flatnonzero(head != np.arange(len(key)))
    same = size[again] == size[head[again]]
    check = np.flatnonzero(same)
    for i in range(0, len(check), 1 << 16):
        own = again[check[i : i + (1 << 16)]]
        differ = _gather(data, begin[own], size[own]) != _gather(data, begin[head[own]], size[own])
        same[check[i : i + (1 << 16)]] = ~np.logical_or.reduceat(differ, np.cumsum(size[own]) - size[own])
    if not same.all():
        names: dict[bytes, int] = {}
        for k in again[~same].tolist():
            kind[k] = len(first) + names.setdefault(data[begin[k] : begin[k] + size[k]].tobytes(), len(names))
    return kind


def _pieces(runs: Runs, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs that stand for the distinct pieces of shared anchors; each run's number among them (-1:
    its anchor is no other document's)."""
    if not len(runs):
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    first, number = _firsts(runs.anchor)
    shared = np.zeros(len(first), bool)
    shared[np.searchsorted(first, found)] = True
    # in order of place the documents ascend, so an anchor's first run has its least document
    other = runs.doc != runs.doc[first[number]]
    shared[number[other]] = True
    live = np.flatnonzero(shared[number])
    own, which = _firsts(runs.piece[live]) if len(live) else (live, live)
    stands = np.full(len(runs), -1, np.int64)
    stands[live] = which
    return live[own], stands, other


def _gather(data: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = np.cumsum(size)
    at = np.repeat(begin - (total - size), size) + np.arange(total[-1] if len(total) else 0)
    return data[at]


def _send_pieces(buckets: int):
    def send(docs: pa.Table, found: pa.Table) -> pa.Table:
        names = ["_bucket", "_block", "n", "places", "data"]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()]
        rows = []
        if docs.num_rows:
            block, _, texts, runs = _block(docs)
            own, _, _ = _pieces(runs, B.gathered(found))
            if len(own):
                which = B.bucket_of(runs.anchor[own], buckets).astype(np.int64)
                order = np.argsort(which, kind="stable")
                edges = np.searchsorted(which[order], np.arange(buckets + 1))
                flat = np.frombuffer(b"".join(texts), np.uint8)
                begin = np.cumsum([0, *(len(t) for t in texts)])
                for b in np.flatnonzero(np.diff(edges)):
                    part = own[order[edges[b] : edges[b + 1]]]
                    size = runs.n[part] + LENGTH - 1
                    text = _gather(flat, begin[runs.text[part]] + runs.start[part], size)
                    data = (runs.anchor[part] & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + runs.doc[part].astype("<i4").tobytes() + size.astype(np.uint8).tobytes() + text.tobytes()
                    rows.append((int(b), block, len(part), B.pack_places(part), zstandard.compress(data, 3)))
        return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [[]] * 5, kinds, strict=True)], names)

    return send


def smaller(order: np.ndarray) -> np.ndarray:
    """Place of the previous strictly smaller value of each place (-1: none), by pointer jumping."""
    n = len(order)
    value = np.concatenate([order, [np.iinfo(np.int64).min]])  # place -1 ends every chain
    at = np.arange(n) - 1
    live = np.flatnonzero(value[at] >= order)
    while len(live):
        at[live] = at[at[live]]
        live = live[value[at[live]] >= order[live]]
    return at


def previous_factors(data: np.ndarray, starts: np.ndarray, order: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For the suffixes of `data` at `starts`, whether a suffix of smaller `order` shares their first
    `length` bytes.  Suffix array, previous and next smaller values, common prefixes."""
    if not len(starts):
        return np.empty(0, bool)
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), dtype=">u8", buffer=padded, strides=(1,))
    lanes = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]  # the last overlaps the one before
    # a suffix whose prefix occurs once has no match; hashes tell before the order is made
    h = np.full(len(starts), length, np.uint64)
    for k in lanes:
        h = vec.mix(h * np.uint64(vec.BASE) ^ eight[starts + k].astype(np.uint64))
    by_hash = np.argsort(h)
    twin = h[by_hash][1:] == h[by_hash][:-1]
    twice = np.zeros(len(starts), bool)
    twice[by_hash[1:][twin]] = twice[by_hash[:-1][twin]] = True
    live = np.flatnonzero(twice)
    out = np.zeros(len(starts), bool)
    if not len(live):
        return out
    keys = np.stack([eight[starts[live] + k].astype(np.uint64) for k in lanes])
    suffixes = np.lexsort((order[live], *keys[::-1]))
    keys = keys[:, suffixes]
    o = order[live][suffixes]
    rank = np.cumsum(np.concatenate([[0], (keys[:, 1:] != keys[:, :-1]).any(0)]))
    before = smaller(o)
    behind = len(o) - 1 - smaller(o[::-1])[::-1]
    hit = (before >= 0) & (rank[before] == rank)
    hit |= (behind < len(o)) & (rank[np.minimum(behind, len(o) - 1)] == rank)
    out[live[suffixes]] = hit
    return out


def _settle(table: pa.Table) -> pa.Table:
    """Reducer of a bucket: the windows of each block's pieces that an earlier document has."""
    table = table.sort_by("_block")
    blocks = table["_block"].to_numpy().astype(np.int64)
    counts = table["n"].to_numpy()
    anchors, docs, sizes, texts = [], [], [], []
    for k, n in enumerate(counts.tolist()):
        raw = zstandard.decompress(table["data"][k].as_py())
        anchors.append(np.frombuffer(raw, "<u4", n))
        docs.append(np.frombuffer(raw, "<i4", n, 4 * n).astype(np.int64) | blocks[k] << 32)
        sizes.append(np.frombuffer(raw, np.uint8, n, 8 * n))
        texts.append(np.frombuffer(raw, np.uint8, offset=9 * n))
    anchor, doc, size, data = (np.concatenate(x) for x in (anchors, docs, sizes, texts))
    size = size.astype(np.int64)
    end = np.cumsum(size)
    text = vec.span_hashes(data, end - size, end)
    windows = size - LENGTH + 1
    mask = np.zeros(len(doc), np.uint32)
    # equal pieces: all but the first document's are matched whole
    kind = _alike(text, data, end - size, size)
    ordered = np.lexsort((doc, kind))
    head = np.concatenate([[True], kind[ordered][1:] != kind[ordered][:-1]])
    mask[ordered[~head]] = ((np.uint64(1) << windows[ordered[~head]].astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
    one = ordered[head]
    # pieces that differ under one anchor
    _, group, many = np.unique(anchor[one], return_inverse=True, return_counts=True)
    one = one[many[group] > 1]
    one = one[np.argsort(anchor[one], kind="stable")]
    total = np.cumsum(windows[one])
    edge = np.flatnonzero(np.concatenate([anchor[one][1:] != anchor[one][:-1], [True]])) + 1 if len(one) else []
    i = 0
    for j in edge:  # slices of whole anchors
        if total[j - 1] - (total[i - 1] if i else 0) < SLICE and j < len(one):
            continue
        part, i = one[i:j], j
        n = windows[part]
        owner = np.repeat(np.arange(len(part)), n)
        inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        hit = previous_factors(data, (end - size)[part][owner] + inner, doc[part][owner])
        bits = np.zeros(len(part), np.uint32)
        np.bitwise_or.at(bits, owner[hit], np.uint32(1) << inner[hit].astype(np.uint32))
        mask[part] = bits
    out, at = [], 0
    for k, count in enumerate(counts.tolist()):
        own = mask[at : at + count]
        some = np.flatnonzero(own)
        if len(some):
            places = B.unpack_places(table["places"][k].as_py())
            out.append((int(blocks[k]), B.pack_places(places[some]), zstandard.compress(own[some].astype("<u4").tobytes(), 1)))
        at += count
    return pa.Table.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else [[]] * 3, (pa.int32(), pa.binary(), pa.binary()), strict=True)], ["_block", "places", "masks"])


def _apply(schema: pa.Schema):
    def cut(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        _, rows, texts, runs = _block(docs)
        places = [B.unpack_places(x) for x in found["places"].to_pylist()]
        shared = np.concatenate(places) if places else np.empty(0, np.int64)
        masks = np.concatenate([np.frombuffer(zstandard.decompress(x), "<u4") for x in found["masks"].to_pylist()]) if places else np.empty(0, np.uint32)
        full = ((np.uint64(1) << runs.n.astype(np.uint64)) - np.uint64(1)).astype(np.uint32)
        # every run takes part in a piece; a later document's copy of a block's piece is matched whole
        first, number = _firsts(runs.piece) if len(runs) else (np.empty(0, np.int64), np.empty(0, np.int64))
        of_first = np.zeros(len(runs), np.uint32)
        of_first[shared] = masks
        mask = np.where(runs.doc != runs.doc[first[number]], full, of_first[first[number]]) if len(runs) else of_first
        flat = np.frombuffer(b"".join(texts), np.uint8)
        begin = np.cumsum([0, *(len(t) for t in texts)])
        step = np.zeros(len(flat) + LENGTH + 1, np.int32)
        base = begin[runs.text] + runs.start
        for k in range(SPAN):
            at = base[(mask >> np.uint32(k)) & np.uint32(1) == 1] + k
            np.add.at(step, at, 1)
            np.add.at(step, at + LENGTH, -1)
        gone = np.cumsum(step[: len(flat)]) > 0
        lost = np.concatenate([[0], np.cumsum(gone)])
        kept = flat[~gone].tobytes()
        at = begin - lost[begin]
        spans: list[list[dict]] = [[] for _ in texts]
        if gone.any():
            inner = np.unique(begin[1:-1])
            inner = inner[(inner > 0) & (inner < len(flat))]
            inner = inner[gone[inner] & gone[inner - 1]]
            s, e = vec.runs(gone)
            s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
            for a, b, d in zip(s.tolist(), e.tolist(), (np.searchsorted(begin, s, "right") - 1).tolist(), strict=True):
                spans[d].append({"start": a - int(begin[d]), "end": b - int(begin[d])})
        cols = [rows[BOX], rows[B.ID], rows[B.TEXT], pa.array(np.diff(begin), pa.int64()), pa.array(lost[begin[1:]] - lost[begin[:-1]], pa.int64()), pa.array([kept[a:b] for a, b in zip(at.tolist(), at.tolist()[1:], strict=False)], pa.binary()), pa.array(spans, schema.field("spans").type)]
        return pa.Table.from_arrays([pa.chunked_array(c) if isinstance(c, pa.Array) else c for c in cols], schema.names).cast(schema)

    return cut


def dedup_suffixes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with n_bytes, n_removed, kept_bytes and spans (maximal removed runs of
    bytes, end exclusive)."""
    results = ["n_bytes", "n_removed", "kept_bytes", "spans"]
    own = Columns(docs, results, [id_col, text_col])
    layout = B.plan(own, id_col, text_col)
    dealt = B.deal(own, id_col, text_col, layout)
    buckets = layout.buckets(layout.n_bytes / 13, BUCKET)
    sent = dealt.groupBy(B.BLOCK).applyInArrow(_emit(buckets), B.SENT)
    found = B.exchange(sent, buckets, ANCHOR_WIDTH, False, layout.n)
    pieces = dealt.groupBy(B.BLOCK).cogroup(found.groupBy(B.BLOCK)).applyInArrow(_send_pieces(buckets), PIECES)
    answers = pieces.repartition(buckets, "_bucket").groupBy("_bucket").applyInArrow(_settle, ANSWER).repartition(layout.n, B.BLOCK)
    spark_schema = boxed_schema(dealt.drop(B.BLOCK), RESULT)
    out = dealt.groupBy(B.BLOCK).cogroup(answers.groupBy(B.BLOCK)).applyInArrow(_apply(arrow_schema(docs.sparkSession, spark_schema)), spark_schema)
    return own.back(out, results, **{id_col: B.ID, text_col: B.TEXT})
