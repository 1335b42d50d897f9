"""Benchmark decontamination: broadcast hash sets of normalised test n-grams.

The benchmark's text is measured first.  Up to BROADCAST_BYTES it is broadcast; each task builds
its hash set once and scans whole training texts window by window.  A larger benchmark is not
broadcast: only a bit filter of fixed size is, the windows that pass it are joined to the
benchmark's n-grams by shuffle, and what they hit goes back to the rows.  Both ways verify each hash
hit on the words themselves and give the same rows.

Words: A-Z lower-cased, then runs of ASCII digits, ASCII letters and non-ASCII bytes.  A window
is `n` consecutive words of an item; a shorter item, if it has words, is one window.

Defined cases: null texts have no words; an item without words has no window; an item whose id
is null marks words but has no id to list; items that share an id are one; an empty benchmark
hits nothing; extra columns pass through, and a result column replaces an input column of its
name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprism.llm import vec
from newsprism.llm.columns import Columns, arrow_schema, batch_of, boxed_schema
from newsprism.storage import stored

N = 13
#: Text of a benchmark whose n-grams each worker may hold, and bits of the filter for larger ones.
BROADCAST_BYTES = 2 << 20
FILTER_BITS = 1 << 24
CHUNK_BYTES = 1 << 18
RESULT = "n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"


class Grams:
    """The windows of one length: sorted hashes, a bit filter on them, and words -> items."""

    def __init__(self, grams: dict[bytes, set[str | None]], hashes: np.ndarray):
        self.items = grams
        self.hashes = np.unique(hashes)
        self.bits = 1 << max(16, int(len(self.hashes) * 16).bit_length())
        self.filter = np.zeros(self.bits, bool)
        self.filter[(self.hashes & np.uint64(self.bits - 1)).astype(np.int64)] = True

    def candidates(self, h: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(self.filter[(h & np.uint64(self.bits - 1)).view(np.int64)])
        return at[np.isin(h[at], self.hashes)] if len(at) else at


def gram_sets(items: list[tuple[str | None, bytes]], n: int) -> dict[int, Grams]:
    """The windows of the items by length."""
    w = vec.Words([t for _, t in items], vec.NON_ALNUM, fold=True)
    h = w.hashes()
    words: dict[int, dict[bytes, set[str | None]]] = {}
    hashes: dict[int, list[np.ndarray]] = {}
    for (name, _), a, b in zip(items, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
        size = min(n, b - a)
        if size:
            hashes.setdefault(size, []).append(vec.windows(h[a:b], size))
            for k in range(a, b - size + 1):
                words.setdefault(size, {}).setdefault(_gram(w, k, size), set()).add(name)
    return {size: Grams(words[size], np.concatenate(hashes[size])) for size in words}


def _gram(w: vec.Words, k: int, size: int) -> bytes:
    return b" ".join([w.buf[a:b].tobytes() for a, b in zip(w.starts[k : k + size].tolist(), w.ends[k : k + size].tolist(), strict=True)])


def scan(w: vec.Words, sets: dict[int, Grams]) -> tuple[np.ndarray, dict[int, set[str]]]:
    """Mask of the words of a chunk that a window covers, and the items found in each text."""
    hit = np.zeros(w.n, bool)
    found: dict[int, set[str]] = {}
    h = w.hashes()
    for size, grams in sets.items():
        hs = vec.windows(h, size)
        if not len(hs):
            continue
        at = grams.candidates(hs)
        at = at[vec.inside_texts(w.first, size, w.n)[at]]
        true = []
        for k, d in zip(at.tolist(), (np.searchsorted(w.first, at, "right") - 1).tolist(), strict=True):
            names = grams.items.get(_gram(w, k, size))
            if names is not None:
                true.append(k)
                found.setdefault(d, set()).update(x for x in names if x is not None)
        hit |= vec.cover(np.array(true, np.int64), size, w.n)
    return hit, found


def _described(w: vec.Words, hit: np.ndarray, found: dict[int, set[str]], schema: pa.Schema) -> list[pa.Array]:
    """Columns n_words, n_hit, items and spans of a chunk."""
    n = len(w.first) - 1
    n_hit = np.diff(np.concatenate([[0], np.cumsum(hit)])[w.first])
    spans = [[] for _ in range(n)]
    for d in np.flatnonzero(n_hit).tolist():
        s, e = vec.runs(hit[w.first[d] : w.first[d + 1]])
        spans[d] = [{"start": a, "end": b} for a, b in zip(s.tolist(), e.tolist(), strict=True)]
    return [pa.array(w.counts(), pa.int64()), pa.array(n_hit, pa.int64()), pa.array([sorted(found.get(d, ())) for d in range(n)], pa.list_(pa.string())), pa.array(spans, schema.field("spans").type)]


def _scanner(shared, n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams = gram_sets(shared.value, n)
        for batch in batches:
            texts = vec.utf8(batch.column(1))
            for i, j in vec.chunks(texts):
                w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
                hit, found = scan(w, grams)
                yield batch_of([*(x.slice(i, j - i) for x in batch.columns), *_described(w, hit, found, schema)], schema)

    return run


# -- benchmarks beyond the broadcast -----------------------------------------------------------

GRAM = "size int, h bigint, gram binary, name string"
WINDOW = "row bigint, place int, size int, h bigint, gram binary"


def _grams(n: int, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vec.utf8(batch.column(1))
            for i, j in vec.chunks(texts, CHUNK_BYTES):
                w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
                h, own, names = w.hashes(), [], batch.column(0).slice(i, j - i).to_pylist()
                for name, a, b in zip(names, w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    size = min(n, b - a)
                    if size:
                        own += [(size, x, _gram(w, a + k, size), name) for k, x in enumerate(vec.windows(h[a:b], size).view(np.int64).tolist())]
                yield batch_of([pa.array(x, f.type) for x, f in zip(zip(*own, strict=True) if own else [[]] * 4, schema, strict=True)], schema)

    return run


def _windows(sizes: list[int], shared, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, rows = vec.utf8(batch.column(1)), batch.column(0).to_numpy()
            for i, j in vec.chunks(texts, CHUNK_BYTES):
                w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
                h = w.hashes()
                for size in sizes:
                    hs = vec.windows(h, size)
                    if not len(hs):
                        continue
                    bit = (hs & np.uint64(FILTER_BITS - 1)).astype(np.int64)
                    at = np.flatnonzero(vec.inside_texts(w.first, size, w.n) & ((shared.value[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1))
                    d = np.searchsorted(w.first, at, "right") - 1
                    yield batch_of([pa.array(rows[i + d]), pa.array((at - w.first[d]).astype(np.int32)), pa.array(np.full(len(at), size, np.int32)), pa.array(hs[at].view(np.int64)), pa.array([_gram(w, k, size) for k in at.tolist()], pa.binary())], schema)

    return run


def _marker(schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vec.utf8(batch.column(1))
            hits, names = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            for i, j in vec.chunks(texts):
                w = vec.Words(texts[i:j], vec.NON_ALNUM, fold=True)
                hit = np.zeros(w.n, bool)
                for d, places in enumerate(hits[i:j]):
                    for p in places or ():
                        hit[w.first[d] + p["place"] : w.first[d] + p["place"] + p["size"]] = True
                found = {d: set(x or ()) for d, x in enumerate(names[i:j])}
                yield batch_of([*(x.slice(i, j - i) for x in batch.columns[:2]), *_described(w, hit, found, schema)], schema)

    return run


def _joined(rows: DataFrame, items: DataFrame, n: int, schema: StructType) -> DataFrame:
    """The rows (_box, text) with their results; nothing of the benchmark but the filter is broadcast."""
    spark = rows.sparkSession
    grams = stored(items.mapInArrow(_grams(n, arrow_schema(spark, GRAM)), GRAM).distinct(), "grams")
    sizes = [r.size for r in grams.select("size").distinct().collect()]  # at most n
    # at most FILTER_BITS / 32 rows of two integers, whatever the benchmark's size
    own = grams.selectExpr(f"h & {FILTER_BITS - 1} as bit").selectExpr("bit div 32 as word", "shiftleft(1L, cast(bit % 32 as int)) as one")
    words = own.groupBy("word").agg(F.bit_or("one").alias("bits")).toPandas()
    filter_bits = np.zeros(FILTER_BITS // 32, "<u4")
    filter_bits[words["word"].to_numpy()] = words["bits"].to_numpy().astype(np.uint32)
    numbered = stored(rows.withColumn("row", F.monotonically_increasing_id()), "rows")  # numbered once, as written
    shared = spark.sparkContext.broadcast(filter_bits.view(np.uint8))
    windows = numbered.select("row", "text").mapInArrow(_windows(sizes, shared, arrow_schema(spark, WINDOW)), WINDOW)
    names = F.array_sort(F.collect_set("name"))
    found = windows.join(grams.groupBy("size", "h", "gram").agg(names.alias("names")), ["size", "h", "gram"])
    by_row = found.groupBy("row").agg(F.collect_set(F.struct("place", "size")).alias("places"), F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    both = numbered.join(by_row, "row", "left").select(*rows.columns, "places", "names")
    return both.mapInArrow(_marker(arrow_schema(spark, schema)), schema)


# -- operator ----------------------------------------------------------------------------------


def find_contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", n: int = N) -> DataFrame:
    """The rows of `docs` (with a column text) with n_words, n_hit, items (sorted ids of items with a
    window in the text), spans (maximal runs of hit words) and contaminated (a hit, and at least 5 %
    of words)."""
    spark = docs.sparkSession
    tests = Columns(benchmark)
    items = tests.df.select(tests[id_col].cast("string").alias("name"), tests[text_col].cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + F.coalesce(F.octet_length("name"), F.lit(0)) + 8)).first()[0] or 0
    results = ["n_words", "n_hit", "items", "spans", "contaminated"]
    own = Columns(docs, results, ["text"])
    rows = own.rows(text=own["text"].cast("string"))
    schema = boxed_schema(rows, RESULT)
    if size <= BROADCAST_BYTES:
        known = [(r.name, (r.text or "").encode()) for r in items.where("text is not null").toLocalIterator()]  # at most BROADCAST_BYTES
        found = rows.mapInArrow(_scanner(spark.sparkContext.broadcast(known), n, arrow_schema(spark, schema)), schema)
    else:
        found = _joined(rows, items, n, schema)
    return own.back(found.withColumn("contaminated", F.expr("n_hit > 0 AND 20 * n_hit >= n_words")), results, text="text")


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """The rows of `docs`, unchanged, without the contaminated documents."""
    own = Columns(docs, moved=["text"])
    found = find_contamination(own.rows(text=own["text"]), benchmark, n=n)
    return own.back(found.where(~F.col("contaminated")), text="text")


def remove_spans(found: DataFrame, text_col: str = "text") -> DataFrame:
    """Replaces each text of find_contamination()'s rows by its words outside the spans, as they
    stand in the text, one space between."""
    word = "[^\\\\x00-\\\\x2F\\\\x3A-\\\\x40\\\\x5B-\\\\x60\\\\x7B-\\\\x7F]+"
    words = f"regexp_extract_all(`{text_col}`, '{word}', 0)"
    kept = f"filter(transform({words}, (w, i) -> struct(w, i)), x -> NOT exists(spans, s -> x.i >= s.start AND x.i < s.end))"
    return found.withColumn(text_col, F.when(F.size("spans") > 0, F.expr(f"array_join(transform({kept}, x -> x.w), ' ')")).otherwise(F.col(text_col)))
