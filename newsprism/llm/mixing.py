"""Mixing sources to target weights by a low-discrepancy schedule.  Native: DataFrame functions only.

Targets.  The sources, in order, weigh WEIGHTS, repeated; together they are to give as many words as
the corpus has.  A source gives at most REPEATS times its own words; what it can't give is shared
again by weight, round by round, until no target is above.

Schedule.  A source's target is cut into blocks of `block` words (the last one may be shorter), and
the blocks of all sources, laid end to end, are Q places.  Slot k of the mix takes the place that the
van der Corput point of k falls on: k's binary digits, reversed, over the power of two at or above
Q; points beyond Q are passed over.  So each place is taken once, each source gets exactly its
blocks, and any stretch of the mix holds nearly its share of every source.  Reversal is its own
inverse, so a source's slots are computed from its own places and no slot looks for its source.

Blocks.  A source's documents are shuffled by a hash of their id and laid end to end; the r-th of its
slots takes words [r * block, (r + 1) * block) of that stream, which begins again at its end.  Slots
and blocks meet by (source, r), both sides with one group of bounded size a key.

Scale.  A source may hold any share of the rows: places in a stream, and ranks of slots, are sums of
chunks before (CHUNK documents or SLOTS slots on average) plus the place inside a chunk, so no task
gets a source as a whole.  Texts are read once, to count words; everything else runs on narrow rows.

Defined cases: a null text has no words; rows without words get targets but no place; a null source is
a source, the last; rows that share an id, and rows without one, are documents of their own, laid
in order of their size; an empty table gives no rows; extra columns are ignored here and pass through
:func:`mixed_texts` not at all.  Words are `[^\\x20\\x09-\\x0D]+`, so a text of any length is counted in
one pass; it is cut into blocks in one array of block numbers.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns
from newsprism.operators.ranks import numbered, running
from newsprism.storage import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, REPEATS = (5, 2, 1), 3
#: Words of a block; documents of a chunk of a stream, and slots of a chunk of the schedule, on average.
BLOCK, CHUNK, SLOTS = 1024, 512, 1 << 15
SEED = "mix"


def reversed_bits(k: Column, bits: int) -> Column:
    """The number whose `bits` binary digits are those of k from right to left (bits 1 to 62)."""
    return F.conv(F.reverse(F.lpad(F.bin(k), bits, "0")), 2, 10).cast("bigint")


def sizes(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """(doc_id, source, key, size, shuffled): words of each document, a key of its source that is never
    null, and 32 bits that shuffle documents."""
    own = Columns(docs)
    id_, source = own["doc_id"], own["source"].cast("string")
    words = F.coalesce(F.regexp_count(own["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("bigint")
    shuffled = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 8), 16, 10).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), source), F.lit(""))
    return own.df.select(id_.cast("bigint").alias("doc_id"), source.alias("source"), key.alias("key"), words.alias("size"), shuffled.alias("shuffled"))


def level(sources: DataFrame, repeats: int = REPEATS) -> tuple[int, int]:
    """(rest, weight): sources of weight w may give rest * w / weight words, or `repeats` times their
    own.  sources: (weight, own).  Each round is one aggregate of one row; the level only rises, so
    a source that has reached its bound stays there."""
    top = lambda c: F.col(c).cast("decimal(19,0)")
    total, weight = sources.agg(F.sum(top("own")), F.sum("weight")).first()
    rest, n = int(total or 0), int(weight or 0)
    while n:
        full = top("own") * repeats * F.lit(n).cast("decimal(14,0)") < F.lit(rest).cast("decimal(25,0)") * F.col("weight")
        given, left = sources.agg(F.sum(F.when(full, top("own") * repeats)), F.sum(F.when(~full, F.col("weight")))).first()
        now = int(total) - int(given or 0), int(left or 0)
        if now == (rest, n):
            break
        rest, n = now
    return rest, n


def targets(thin: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS) -> DataFrame:
    """(key, own, target, take) a source: its words, its target, and the target in whole words.
    thin: sums of words (key, source, own), any number of rows a source."""
    sources = thin.groupBy("key", "source").agg(F.sum("own").alias("own"))
    order = [F.col("source").isNull(), F.col("source")]
    ranked = numbered(sources, order, "place")
    listed = F.array(*map(F.lit, weights))
    sources = stored(ranked.withColumn("weight", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")).cast("bigint")), "sources")
    rest, n = level(sources, repeats)
    bound = (F.col("own") * repeats).cast("double")
    share = F.lit(float(rest)) * F.col("weight") / F.lit(float(n)) if n else bound
    return sources.withColumn("target", F.least(bound, share)).withColumn("take", F.floor(F.col("target") + 0.5)).drop("weight", "source")


def placed(docs: DataFrame, weights: Sequence[int] = WEIGHTS, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """The rows of :func:`sizes` with own and target of their source, words to `take` from it, and
    `start`, the document's place in its source's stream.  Stored."""
    thin = stored(sizes(docs, seed), "sizes")
    chunks = max(1, math.ceil(thin.count() / CHUNK))
    thin = thin.withColumn("chunk", F.floor(F.col("shuffled") * chunks / (1 << 32)).cast("bigint"))
    by_chunk = stored(thin.groupBy("key", "source", "chunk").agg(F.sum("size").alias("own")), "chunks")
    earlier = Window.partitionBy("key").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    begins = by_chunk.select("key", "chunk", F.coalesce(F.sum("own").over(earlier), F.lit(0)).alias("begin"))
    begins = begins.join(targets(by_chunk, weights, repeats), "key")
    before = Window.partitionBy("key", "chunk").orderBy("shuffled", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    start = F.col("begin") + F.coalesce(F.sum("size").over(before), F.lit(0))
    return stored(thin.join(begins, ["key", "chunk"]).select("doc_id", "source", "key", "size", "own", "target", "take", start.alias("start")), "placed")


def schedule(sources: DataFrame, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """(slot, key, rank): whose turn each slot of the mix is, and its number among the slots of its source.
    sources: (key, take).  Slots are ascending numbers with gaps (points beyond the last place)."""
    own = sources.where("take > 0").select("key", F.ceil(F.col("take") / block).alias("blocks"))
    own = stored(running(own, [F.col("key")], F.col("blocks"), "first"), "turns")
    places = int(own.agg(F.sum("blocks")).first()[0] or 0)
    bits = max(1, (places - 1).bit_length()) if places else 1
    pieces = own.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("blocks") - 1) / slots)))).repartition("key", "piece")
    low = F.col("first") + F.col("piece") * slots
    high = F.col("first") + F.least(F.col("blocks"), (F.col("piece") + 1) * slots) - 1
    turns = stored(pieces.select("key", F.explode(F.sequence(low, high)).alias("place")).select("key", reversed_bits(F.col("place"), bits).alias("slot")), "slots")
    turns = turns.withColumn("part", F.floor(F.col("slot") / slots))
    earlier = Window.partitionBy("key").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    begins = turns.groupBy("key", "part").agg(F.count("*").alias("n")).select("key", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("begin"))
    inside = F.row_number().over(Window.partitionBy("key", "part").orderBy("slot"))
    return turns.withColumn("inside", inside).join(begins, ["key", "part"]).select("slot", "key", (F.col("begin") + F.col("inside") - 1).alias("rank"))


def blocks(rows: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """(key, rank, doc_id, start, at, begin, words): what the blocks of each source's stream hold, words
    [begin, begin + words) of a document, in order of `at`, the place in the endless stream."""
    whole = rows.where("size > 0 and take > 0").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))))
    low = F.col("turn") * F.col("own") + F.col("start")
    whole = whole.withColumn("low", low).withColumn("high", F.least(F.col("low") + F.col("size"), F.col("take"))).where("low < high")
    cut = whole.withColumn("rank", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))))
    at, end = F.greatest("low", F.col("rank") * block), F.least("high", (F.col("rank") + 1) * block)
    return cut.select("key", "rank", "doc_id", "start", at.alias("at"), (at - F.col("low")).alias("begin"), (end - at).alias("words"))


def mix_placed(rows: DataFrame, block: int = BLOCK, repeats: int = REPEATS) -> DataFrame:
    """The mix of rows of :func:`placed`: (slot, source key, doc_id, start, at, begin, words)."""
    sources = rows.groupBy("key").agg(F.first("take").alias("take"))
    return schedule(sources, block).join(blocks(rows, block, repeats), ["key", "rank"]).drop("rank")


def mix_sources(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(slot, source, doc_id, begin, words): the mix, in order of (slot, at): words [begin, begin + words)
    of documents (doc_id, source, text)."""
    rows = mix_placed(placed(docs, weights, repeats, seed), block, repeats)
    source = F.when(F.col("key") != "", F.substring("key", 2, 1 << 30))
    return rows.select("slot", source.alias("source"), "doc_id", "at", "begin", "words")


def mixed_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(doc_id, source, size, source_size, target, taken): each document with the words that the mix
    takes from it, repeats counted."""
    rows = placed(docs, weights, repeats, seed)
    taken = mix_placed(rows, block, repeats).groupBy("key", "start").agg(F.sum("words").alias("taken"))
    # a document with words is the only one of its source that begins where it does
    out = rows.where("size > 0").join(taken, ["key", "start"], "left")
    out = out.unionByName(rows.where("size = 0").withColumn("taken", F.lit(0).cast("bigint")))
    return out.select("doc_id", "source", "size", F.col("own").alias("source_size"), "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def mixed_texts(docs: DataFrame, weights: Sequence[int] = WEIGHTS, block: int = BLOCK, repeats: int = REPEATS, seed: str = SEED) -> DataFrame:
    """(slot, source, text): the blocks of the mix as texts, words joined by one space.  Ids must be
    distinct; a block holds at most `block` words, so its group is bounded."""
    own = Columns(docs)
    texts = own.df.select(own["doc_id"].cast("bigint").alias("doc_id"), F.regexp_extract_all(own["text"].cast("string"), F.lit(WORD), F.lit(0)).alias("w"))
    spans = mix_sources(docs, weights, block, repeats, seed).join(texts, "doc_id")
    cut = spans.withColumn("cut", F.array_join(F.slice("w", (F.col("begin") + 1).cast("int"), F.col("words").cast("int")), " "))
    parts = F.array_sort(F.collect_list(F.struct("at", "cut")))
    return cut.groupBy("slot", "source").agg(parts.alias("p")).select("slot", "source", F.array_join(F.transform("p", lambda x: x["cut"]), " ").alias("text"))
