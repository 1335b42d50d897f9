"""MinHash near-dedup with an LSH forest, links confirmed on full shingle sets.

1. Each text becomes its set of distinct word shingles: its size, a 128-bit key, K minhashes.
   Texts of one set are one class, whatever their ids; a class has a number of its own.
2. Forest: TREES sorted orders of the signatures, tree t by its own DEPTH minhashes, then by those
   of the trees behind it.  Classes that agree on a tree's own minhashes share a *region*; so a pair
   of similarity s meets in no region with (1 - s**2)**24, 2.4e-9 at 0.75.  Most classes share no
   region with another and leave here.
3. Candidates of a class in a region: its neighbours of longest common prefix, which is the depth
   that the region's crowd calls for, and its densest class (the one that shares regions with
   the most others, as the text that all copies come from does).  Each class is compared on the
   full sets to one candidate a round, that with the most agreement: a group of n copies costs n
   comparisons.  The first round gives a forest of links, resolved by pointer jumping; the next
   rounds pair only classes of different components, joined by label propagation.
4. The last pass leaves no region with pairs of different components unexamined: all such pairs,
   dealt over pairs of blocks of BLOCK entries, are compared by size, by all K minhashes (fewer equal
   ones than a pair at the threshold has with MISS rule it out) and by a bound that never errs: of
   each set a bitmap of BITS places is kept, and places that only one of two sets fills are shingles
   that the other lacks.  What is left is confirmed on the full sets, the closest pair of two
   components first.

Nothing about all documents reaches the driver.  Ids of texts to compare are broadcast only if
at most BROADCAST_IDS, counted first; else they are joined by shuffle.

Defined cases: null text counts as empty; texts without words have no set and are linked with
nothing; rows that share an id are each judged by their own text; rows without an id have no
component and are not kept, nor do they link others; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm import vec
from newsprism.llm.blocks import partitions
from newsprism.llm.columns import Columns, arrow_schema
from newsprism.storage import Scratch, stored

WORDS, PERCENT = 5, 75
TREES, DEPTH = 24, 2
K = TREES * DEPTH
#: Rounds of candidates between components, before the last pass.
ROUNDS = 1
#: Entries of a block of the last pass, and the chance that its count of minhashes may lose a pair at
#: the threshold.
BLOCK, MISS = 2000, 1e-6
#: Places of a set's bitmap.
BITS = 2048
BROADCAST_IDS = 1_000_000
_rng = np.random.default_rng(20_11)
_MUL = _rng.integers(0, 1 << 63, K, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, K, dtype=np.uint64)


def shingle_sets(texts: list[bytes], n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    for i, j in vec.chunks(texts):
        w = vec.Words(texts[i:j], fold=True)
        h = w.hashes()
        win = vec.windows(h, n)
        for a, b in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
            if b - a >= n:
                yield np.unique(win[a : b - n + 1])
            elif b > a:
                yield vec.windows(h[a:b], b - a) ^ np.uint64(b - a)
            else:
                yield np.empty(0, np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """K minhashes (32 bits) of each non-empty set."""
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), K), np.uint32)
    for k in range(K):
        x = flat * _MUL[k]
        x += _ADD[k]
        x >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(x.astype(np.uint32), starts)
    return out


def bitmaps(sets: list[np.ndarray]) -> list[bytes]:
    """The places of each set's shingles, by their lowest bits."""
    places = np.zeros((len(sets), BITS), bool)
    own = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    if len(own):
        places[own, (np.concatenate(sets) & np.uint64(BITS - 1)).astype(np.int64)] = True
    return [x.tobytes() for x in np.packbits(places, axis=1)]


def _describe(at_text: int, schema: pa.Schema, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = vec.utf8(batch.column(at_text))
            for i, j in vec.chunks(texts):
                sets = list(shingle_sets(texts[i:j], n))
                some = [s for s in sets if len(s)]
                sig = signatures(some) if some else np.empty((0, K), np.uint32)
                ends = np.cumsum([0, *(TREES if len(s) else 0 for s in sets)]).astype(np.int32)
                sigs = pa.ListArray.from_arrays(pa.array(ends), pa.array(sig.view(np.int64).ravel()))
                keys = [xxhash.xxh128_digest(s.tobytes()) if len(s) else None for s in sets]
                cols = [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(keys, pa.binary()), sigs.cast(schema.field("sig").type), pa.array(bitmaps(sets), pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, schema=schema)

    return run


# -- forest ----------------------------------------------------------------------------------


def live_entries(classes: DataFrame) -> DataFrame:
    """(c, score, sig, trees): the classes that share a region with another, the trees of those
    regions, and how many entries these hold.  classes: (c, sig)."""
    entries = classes.select("c", F.posexplode("sig").alias("tree", "prefix"))
    crowd = entries.groupBy("tree", "prefix").agg(F.count("*").alias("n")).where("n > 1")
    shared = entries.join(crowd, ["tree", "prefix"]).groupBy("c").agg(F.sum("n").alias("score"), F.collect_list("tree").alias("trees"))  # at most TREES items
    return stored(classes.select("c", "sig").join(shared, "c"), "live")


def entries_of(live: DataFrame, *extra: str) -> DataFrame:
    """A row a tree of each class: (tree, prefix, p1, p2, c, score, ...), p1 and p2 from the trees behind it."""
    rows = live.select("c", "score", "sig", *extra, F.explode("trees").alias("tree"))
    at = lambda k: F.col("sig")[F.pmod(F.col("tree") + k, F.lit(TREES))]
    return rows.select("tree", at(0).alias("prefix"), at(1).alias("p1"), at(2).alias("p2"), "c", "score", *extra)


def _neighbours(schema: pa.Schema):
    """Over entries in order: each entry with the one before it in its region, if their components
    differ, and how many trees in a row they agree on."""
    columns = ["tree", "prefix", "p1", "p2", "c", "score", "part"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: list | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in columns]
            cols = own if last is None else [np.concatenate([x, y]) for x, y in zip(last, own, strict=True)]
            last = [x[-1:] for x in own]
            tree, prefix, p1, p2, c, score, part = cols
            same = (tree[1:] == tree[:-1]) & (prefix[1:] == prefix[:-1])
            at = np.flatnonzero(same & (part[1:] != part[:-1]))
            deep = (p1[1:] == p1[:-1])[at]
            depth = 1 + deep + (deep & (p2[1:] == p2[:-1])[at])
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (c[at], score[at], c[at + 1], score[at + 1], depth.astype(np.int64))], schema=schema)

    return run


def untried(pairs: DataFrame, measured: DataFrame) -> DataFrame:
    """The pairs (a, b) that were not compared yet, in either direction."""
    done = measured.select("a", "b").union(measured.select("b", "a"))
    return pairs.join(done, ["a", "b"], "left_anti")


def candidates(live: DataFrame, at: DataFrame | None = None, measured: DataFrame | None = None) -> DataFrame:
    """(b, a): for each class its best candidate of another component that it was not compared to.
    `at` (id, root) are components already known; without them the candidates lead up to ever denser
    classes, so that they form a forest."""
    if at is None:
        rows = entries_of(live.withColumn("part", F.col("c")), "part")
    else:
        known = live.join(at.withColumnRenamed("id", "c"), "c", "left").withColumn("part", F.coalesce("root", "c"))
        rows = entries_of(known, "part")
        mixed = rows.groupBy("tree", "prefix").agg(F.min("part").alias("low"), F.max("part").alias("high")).where("low < high")
        rows = stored(rows.join(mixed.select("tree", "prefix"), ["tree", "prefix"]), "mixed")
    order = ["tree", "prefix", "p1", "p2", "c"]
    ddl = "c bigint, score bigint, d bigint, d_score bigint, weight bigint"
    sorted_rows = rows.repartitionByRange(partitions(live), *order).sortWithinPartitions(*order)
    near = sorted_rows.select(*order, "score", "part").mapInArrow(_neighbours(arrow_schema(live.sparkSession, ddl)), ddl)
    up = F.struct("score", "c") > F.struct(F.col("d_score").alias("score"), F.col("d").alias("c"))
    near = near.select(F.when(up, F.col("d")).otherwise(F.col("c")).alias("b"), F.when(up, F.col("c")).otherwise(F.col("d")).alias("a"), F.greatest("score", "d_score").alias("a_score"), "weight")
    densest = rows.groupBy("tree", "prefix", "part").agg(F.max(F.struct("score", "c")).alias("top"))
    best = densest.withColumn("rank", F.row_number().over(Window.partitionBy("tree", "prefix").orderBy(F.desc("top")))).where("rank <= 2")  # of two components
    tops = best.groupBy("tree", "prefix").agg(F.max(F.when(F.col("rank") == 1, F.struct("top", "part"))).alias("first"), F.max(F.when(F.col("rank") == 2, F.struct("top", "part"))).alias("second"))
    meet = rows.select("tree", "prefix", "c", "part").join(tops, ["tree", "prefix"])
    other = F.when(F.col("first.part") != F.col("part"), F.col("first.top")).otherwise(F.col("second.top") if at is not None else F.lit(None))
    star = meet.withColumn("other", other).where("other is not null").select(F.col("c").alias("b"), F.col("other.c").alias("a"), F.col("other.score").alias("a_score"), F.lit(1).cast("bigint").alias("weight"))
    pairs = near.unionByName(star).groupBy("b", "a").agg(F.sum("weight").alias("weight"), F.max("a_score").alias("a_score"))
    pairs = untried(pairs, measured) if measured is not None else pairs
    return stored(pairs.groupBy("b").agg(F.max(F.struct("weight", "a_score", "a")).alias("m")).select("b", F.col("m.a").alias("a")), "pairs")


# -- full sets -------------------------------------------------------------------------------


def _compare(schema: pa.Schema, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_pylist()
            left, right = vec.utf8(batch.column(2)), vec.utf8(batch.column(3))
            both, union = [], []
            for i in range(0, len(left), 256):
                # a densest class comes with many others
                again = {a: k for k, a in enumerate(ids[i : i + 256], i)}
                sets = dict(zip(again, shingle_sets([left[k] for k in again.values()], n), strict=True))
                for a, y in zip(ids[i : i + 256], shingle_sets(right[i : i + 256], n), strict=True):
                    x = sets[a]
                    both.append(len(np.intersect1d(x, y, assume_unique=True)))
                    union.append(len(x) + len(y) - both[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(both, pa.int64()), pa.array(union, pa.int64())], schema=schema)

    return run


def compared(pairs: DataFrame, texts: DataFrame, n: int) -> DataFrame:
    """The pairs (a, b) with the sizes of intersection and union of their full sets, stored.
    texts: (c, text)."""
    spark = pairs.sparkSession
    ids = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    needed = texts.join(ids, "c", "left_semi")
    first = pairs.select("a", "b").join(needed.select(F.col("c").alias("b"), F.col("text").alias("right")), "b")
    both = first.join(needed.select(F.col("c").alias("a"), F.col("text").alias("left")), "a")
    ddl = "a bigint, b bigint, common bigint, total bigint"
    return stored(both.select("a", "b", "left", "right").mapInArrow(_compare(arrow_schema(spark, ddl), n), ddl), "compared")


def _texts(rows: DataFrame, classes: DataFrame, repeats: bool) -> DataFrame:
    """(c, text): the text of each class, found by its id and hash."""
    own = rows.join(classes.select("c", F.col("rep").alias("id"), "text_hash"), ["id", "text_hash"]).select("c", "text")
    return own.groupBy("c").agg(F.min("text").alias("text")) if repeats else own


# -- components ------------------------------------------------------------------------------


def roots(links: DataFrame) -> DataFrame:
    """(id, root) for the child b of each link (a, b); each b has one a < b.  Pointer jumping,
    which leaves a third of every path each time."""
    at = stored(links.select(F.col("b").alias("id"), F.col("a").alias("root")), "roots")
    while True:
        up = at.select(F.col("id").alias("root"), F.col("root").alias("next"))
        two = up.join(up.select(F.col("root").alias("next"), F.col("next").alias("after")), "next", "left").select("root", F.coalesce("after", "next").alias("next"))
        at = stored(at.join(two, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if at.where("moved").isEmpty():
            return at.select("id", "root")
        at = at.select("id", "root")


def components(edges: DataFrame) -> DataFrame:
    """(id, label): each node's smallest reachable node.  Label propagation with jumps."""
    both = stored(edges.select(F.col("a").alias("x"), F.col("b").alias("y")).union(edges.select("b", "a")).distinct(), "edges")
    at = stored(both.groupBy(F.col("x").alias("id")).agg(F.least(F.min("y"), F.col("id")).alias("label")), "labels")
    while True:
        seen = both.join(at, both["y"] == at["id"]).groupBy("x").agg(F.min("label").alias("near"))
        best = at.join(seen, at["id"] == seen["x"]).select("id", F.least("label", "near").alias("best"), F.col("label").alias("old"))
        best = stored(best, "labels")
        jump = best.select(F.col("id").alias("best"), F.col("best").alias("next"))
        new = best.join(jump, "best", "left").select("id", F.coalesce("next", "best").alias("label"), "old")
        if new.where("label <> old").isEmpty():
            return new.select("id", "label")
        at = new.select("id", "label")


def apart(pairs: DataFrame, at: DataFrame) -> DataFrame:
    """The pairs whose ends are in different components, with root_a and root_b."""
    for side in ("a", "b"):
        up = at.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}"))
        pairs = pairs.join(up, side, "left").withColumn(f"root_{side}", F.coalesce(f"root_{side}", side))
    return pairs.where("root_a <> root_b")


def joined(at: DataFrame, links: DataFrame) -> DataFrame:
    """`at` after more links (a, b)."""
    found = apart(links, at).select(F.col("root_a").alias("a"), F.col("root_b").alias("b"))
    moved = components(found)
    kept_up = at.join(moved.select(F.col("id").alias("root"), "label"), "root", "left").select("id", F.coalesce("label", "root").alias("root"))
    return stored(kept_up.union(moved.where("id <> label").select("id", "label")), "roots")


# -- last pass -------------------------------------------------------------------------------


def least_equal(percent: int) -> int:
    """A pair at the threshold has fewer equal minhashes than this with at most MISS."""
    p, below = percent / 100, 0.0
    for k in range(K + 1):
        below += comb(K, k) * p**k * (1 - p) ** (K - k)
        if below > MISS:
            return k
    return K


def unsettled(live: DataFrame, at: DataFrame, classes: DataFrame) -> DataFrame:
    """Entries of regions that hold more than one component, with what the last pass needs of each:
    (tree, prefix, n, c, part, size, sig, bits)."""
    known = live.join(at.withColumnRenamed("id", "c"), "c", "left").withColumn("part", F.coalesce("root", "c"))
    rows = entries_of(known, "part").select("tree", "prefix", "c", "part")
    regions = rows.groupBy("tree", "prefix").agg(F.min("part").alias("low"), F.max("part").alias("high"), F.count("*").alias("n")).where("low < high")
    rows = rows.join(regions.select("tree", "prefix", "n"), ["tree", "prefix"])
    return stored(rows.join(classes.select("c", "size", "sig", "bits"), "c"), "unsettled")


def _all_pairs(schema: pa.Schema, percent: int, least: int):
    """Over entries in order of their groups: pairs of different components that can be similar, each
    in the first tree where they meet."""
    keys = ["tree", "prefix", "low", "high"]

    def pairs(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        tree, prefix, low, high, block, c, part, size = (rows[x].to_numpy() for x in (*keys, "block", "c", "part", "size"))
        sig = rows["sig"].combine_chunks().flatten().to_numpy().view(np.uint32).reshape(-1, K)
        bits = np.frombuffer(b"".join(rows["bits"].to_pylist()), np.uint64).reshape(-1, BITS // 64)
        group = np.cumsum(np.concatenate([[0], (tree[1:] != tree[:-1]) | (prefix[1:] != prefix[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])]))
        at, k, found, n_found = np.arange(len(c)), 0, [], 0
        while len(at):
            k += 1
            at = at[at + k < len(c)]
            at = at[group[at + k] == group[at]]
            x, y = at, at + k
            fit = (part[x] != part[y]) & ((low[x] == high[x]) | (block[x] != block[y])) & (100 * np.minimum(size[x], size[y]) >= percent * np.maximum(size[x], size[y]))
            x, y = x[fit], y[fit]
            for i in range(0, len(x), 1 << 14):
                u, v = x[i : i + (1 << 14)], y[i : i + (1 << 14)]
                same = sig[u] == sig[v]
                n = same.sum(1)
                ok = np.flatnonzero(n >= least)
                ok = ok[same[ok].reshape(-1, TREES, DEPTH).all(2).argmax(1) == tree[u[ok]]]
                u, v, n = u[ok], v[ok], n[ok]
                common = np.minimum(size[u] - np.bitwise_count(bits[u] & ~bits[v]).sum(1), size[v] - np.bitwise_count(bits[v] & ~bits[u]).sum(1))
                ok = 100 * common >= percent * (size[u] + size[v] - common)
                if ok.any():
                    found.append(np.stack([u[ok], v[ok], n[ok]]))
                    n_found += int(ok.sum())
            if n_found > 1 << 17 or (not len(at) and found):
                u, v, n = np.concatenate(found, 1)
                found, n_found = [], 0
                yield pa.RecordBatch.from_arrays([pa.array(c[u]), pa.array(c[v]), pa.array(n.astype(np.int32))], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = [batch.column(batch.schema.get_field_index(c)).to_numpy() for c in keys]
            last = np.logical_and.reduce([c == c[-1] for c in key])
            begins = int(np.argmax(last))  # the last group may go on in the next batch
            if held and begins == 0 and any(held[0][c][0].as_py() != batch[c][0].as_py() for c in keys):
                yield from pairs(pa.Table.from_batches(held))
                held = []
            elif begins:
                yield from pairs(pa.Table.from_batches([*held, batch.slice(0, begins)]))
                held = []
            held.append(batch.slice(begins))
        if held:
            yield from pairs(pa.Table.from_batches(held))

    return run


def all_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """(a, b, same) of unsettled()'s entries."""
    keys = ["tree", "prefix", "low", "high"]
    blocks = F.ceil(F.col("n") / BLOCK)
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("c"), blocks)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), blocks - 1)))
    dealt = dealt.withColumn("low", F.least("block", "other")).withColumn("high", F.greatest("block", "other")).select(*keys, "block", "c", "part", "size", "sig", "bits")
    dealt = dealt.repartition(partitions(rows), *keys).sortWithinPartitions(*keys)
    ddl = "a bigint, b bigint, same int"
    return stored(dealt.mapInArrow(_all_pairs(arrow_schema(rows.sparkSession, ddl), percent, least_equal(percent)), ddl), "pairs")


# -- operator --------------------------------------------------------------------------------


def _repeats(described: DataFrame) -> bool:
    """Whether rows share an id."""
    return not described.where("id is not null").groupBy("id").count().where("count > 1").isEmpty()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """A row a row of `docs`: id, text_hash (Spark's xxhash64 of the text), n_shingles,
    component_id and kept."""
    spark, own = docs.sparkSession, Columns(docs)
    rows = own.df.select(own[id_col].cast("long").alias("id"), F.xxhash64(own[text_col]).alias("text_hash"), own[text_col].cast("string").alias("text"))
    ddl = "id bigint, text_hash bigint, n_shingles bigint, key binary, sig array<bigint>, bits binary"
    with Scratch(spark):
        described = stored(rows.mapInArrow(_describe(2, arrow_schema(spark, ddl), n), ddl), "sets")
        out = stored(_labelled(rows, described, n, percent), "near-duplicates", keep=True)
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "text_hash", "n_shingles", component.alias("component_id"), F.coalesce(component == F.col("id"), F.lit(False)).alias("kept"))


def _labelled(rows: DataFrame, described: DataFrame, n: int, percent: int) -> DataFrame:
    """(id, text_hash, n_shingles, component) a row."""
    with_id = described.where("id is not null and key is not null")
    classes = with_id.groupBy("key").agg(F.min(F.struct("id", "text_hash", "sig", "bits", "n_shingles")).alias("m"))
    # numbered once, as written
    classes = stored(classes.select(F.monotonically_increasing_id().alias("c"), "key", F.col("m.id").alias("rep"), "m.text_hash", "m.sig", "m.bits", F.col("m.n_shingles").alias("size")), "classes")
    texts = _texts(rows, classes, _repeats(described))
    linked = F.col("common") * 100 >= F.col("total") * percent
    live = live_entries(classes.select("c", "sig"))
    measured = compared(candidates(live), texts, n)
    at = roots(measured.where(linked))
    for _ in range(ROUNDS):
        pairs = candidates(live, at, measured)
        if pairs.isEmpty():
            break
        again = compared(pairs, texts, n)
        measured = measured.unionByName(again)
        if again.where(linked).isEmpty():
            break
        at = joined(at, again.where(linked))
    rest = unsettled(live, at, classes)
    if not rest.isEmpty():
        pairs = apart(untried(all_pairs(rest, percent), measured), at)
        # the closest pair of two components first: most others are joined by it
        order = Window.partitionBy(F.least("root_a", "root_b"), F.greatest("root_a", "root_b")).orderBy(F.desc("same"), "a", "b")
        pairs = stored(pairs.withColumn("first", F.row_number().over(order) == 1).select("a", "b", "first"), "ranked")
        for first in (True, False):
            open_pairs = stored(apart(pairs.where(F.col("first") == first), at).select("a", "b"), "open")
            if not open_pairs.isEmpty():
                at = joined(at, compared(open_pairs, texts, n).where(linked))
    label = classes.select("key", "c", "rep").join(at.withColumnRenamed("id", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    least = label.groupBy("root").agg(F.min("rep").alias("component"))
    return described.join(label.join(least, "root").select("key", "component"), "key", "left").select("id", "text_hash", "n_shingles", "component")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of `docs` that are kept, unchanged."""
    gone = near_duplicates(docs).where("not kept").select(F.col("doc_id").alias("_gone"), F.col("text_hash").alias("_hash")).distinct()
    gone = stored(gone, "gone")
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    own = Columns(docs)
    rows = own.rows(_id=own["doc_id"].cast("long"), _text_hash=F.xxhash64(own["text"]))
    return own.back(rows.join(gone, F.col("_id").eqNullSafe(F.col("_gone")) & (F.col("_text_hash") == F.col("_hash")), "left_anti"))
