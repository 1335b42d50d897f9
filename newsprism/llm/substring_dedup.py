"""Substring dedup: Rabin-Karp hashes of every fixed-length word window, counted in Spark.

Each block hashes all its windows (:func:`vec.windows`); buckets of the hash range count them
over the corpus and tell each block which of its windows also start earlier; the block merges
those into maximal removal intervals.  One shuffle of the texts (its exchange is used twice),
one of the packed hashes, one of the answers; each block and each bucket is a task of its own, so
none holds several.

Defined cases: null text counts as empty; rows that share an id are one document, ordered by
text; null ids come before all others; texts of under `window` words lose nothing; extra
columns pass through, and a result column replaces an input column of its name.  Windows match
by their hashes alone, 40 to 128 bits of them as :func:`blocks.hash_width` finds: under 2**-10
expected false matches a run at any size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from newsprism.llm import blocks as B
from newsprism.llm import vec
from newsprism.llm.columns import BOX, Columns, arrow_schema, boxed_schema

WINDOW = 20
RESULT = "n_words bigint, n_removed bigint, kept_text string, spans array<struct<start:int,end:int>>"


def _window_hashes(texts: list[bytes], n: int, wide: bool) -> np.ndarray:
    """The hashes of all windows: a column of 64 bits, or two."""
    parts = [np.empty((0, 1 + wide), np.uint64)]
    for i, j in vec.chunks(texts):
        w = vec.Words(texts[i:j])
        words = w.hashes()
        at = np.flatnonzero(vec.inside_texts(w.first, n, w.n))
        columns = [vec.windows(words, n)[at]]
        if wide:  # the same words under other numbers
            columns.append(vec.windows(vec.mix(words ^ np.uint64(0x2545F4914F6CDD1D)), n)[at])
        parts.append(np.stack(columns, 1))
    return np.concatenate(parts)


def _emit(n: int, buckets: int, width: int):
    def emit(table: pa.Table) -> pa.Table:
        block = table[B.BLOCK][0].as_py()
        _, texts = B.in_order(table)
        h = _window_hashes(texts, n, width > 8)
        own, again = B.first_in_block(h)
        return B.send(block, h[own], own, buckets, width, again)

    return emit


def _cut(n: int, schema: pa.Schema):
    def remove(docs: pa.Table, found: pa.Table) -> pa.Table:
        if not docs.num_rows:
            return schema.empty_table()
        docs, texts = B.in_order(docs)
        places, base = B.gathered(found), 0
        n_words, n_removed, kept, spans = [], [], [], []
        for i, j in vec.chunks(texts):
            w = vec.Words(texts[i:j])
            at = np.flatnonzero(vec.inside_texts(w.first, n, w.n))
            lo, hi = np.searchsorted(places, [base, base + len(at)])
            gone = vec.cover(at[places[lo:hi] - base], n, w.n)
            base += len(at)
            n_words += w.counts().tolist()
            lost = np.concatenate([[0], np.cumsum(gone)])
            n_removed += (lost[w.first[1:]] - lost[w.first[:-1]]).tolist()
            stay = ~gone
            # each kept word with the separator behind it, which becomes one space
            step = np.zeros(len(w.buf) + 1, np.int8)
            step[w.starts[stay]] += 1
            step[w.ends[stay] + 1] -= 1
            mask = np.cumsum(step[:-1], dtype=np.int8).view(bool)
            out = np.where(vec.SPACES[w.buf], np.uint8(32), w.buf)[mask].tobytes()
            sizes = np.concatenate([[0], np.cumsum((w.ends - w.starts + 1) * stay)])[w.first]
            kept += [out[a : max(a, b - 1)] for a, b in zip(sizes, sizes[1:], strict=False)]
            s, e = vec.runs(gone)
            inner = np.unique(w.first[1:-1])  # a run may go on into the next text of the chunk
            inner = inner[(inner > 0) & (inner < w.n)]
            inner = inner[gone[inner] & gone[inner - 1]]
            s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
            of = np.searchsorted(w.first, s, "right") - 1
            per: list[list[dict]] = [[] for _ in range(j - i)]
            for a, b, d in zip(s.tolist(), e.tolist(), of.tolist(), strict=True):
                per[d].append({"start": a - int(w.first[d]), "end": b - int(w.first[d])})
            spans += per
        cols = [docs[BOX], docs[B.ID], docs[B.TEXT], pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, schema.field("spans").type)]
        return pa.Table.from_arrays([pa.chunked_array(c) if isinstance(c, pa.Array) else c for c in cols], schema.names).cast(schema)

    return remove


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """The rows of `docs` with n_words, n_removed, kept_text (the words that stay, one space
    between) and spans (maximal removed runs of words, end exclusive)."""
    results = ["n_words", "n_removed", "kept_text", "spans"]
    own = Columns(docs, results, [id_col, text_col])
    layout = B.plan(own, id_col, text_col)
    dealt = B.deal(own, id_col, text_col, layout, even=True)
    items = max(1.0, layout.n_bytes / 6)
    buckets = layout.buckets(items)
    width = B.hash_width(items, buckets)
    sent = dealt.groupBy(B.BLOCK).applyInArrow(_emit(window, buckets, width), B.SENT)
    found = B.exchange(sent, buckets, width, True, layout.n, even=True)
    spark_schema = boxed_schema(dealt.drop(B.BLOCK), RESULT)
    cut = _cut(window, arrow_schema(docs.sparkSession, spark_schema))
    out = dealt.groupBy(B.BLOCK).cogroup(found.groupBy(B.BLOCK)).applyInArrow(cut, spark_schema)
    return own.back(out, results, **{id_col: B.ID, text_col: B.TEXT})
