"""Token-ID output as directly addressable codes (DACs).

Documents are dealt into blocks of consecutive ids (:mod:`blocks`); each block becomes a
*segment*: the ids of its documents, in order, as chunk levels.  Level k holds byte k of every
id that reaches it; a bitmap says which of them go on to level k + 1, and a directory of rank
counts finds their place there.  Any id is read by one byte and one rank a level, without
decoding what stands before it.  Segments are rows of Parquet files (uncompressed, columns
segment, doc_ids, n_tokens, dac), so Spark's committed writers put them on any shared store, and
a lost task writes its segment again.  One shuffle: the texts, by id range.

Segment bytes: "DAC1", number of ids (u32), number of levels (u32); for each level its number of
chunks (u32), the chunks, and - but for the last level - the bitmap (little-endian bits, padded
to whole superblocks) and u32 counts of set bits before each superblock.

Defined cases: null text counts as empty (it still gets the end id); rows that share an id are
ordered by text; null ids come first; an empty table gives files without segments.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsprism.llm import blocks as B
from newsprism.llm import vec
from newsprism.llm.bpe import CHUNK_BYTES, codec
from newsprism.llm.columns import Columns, arrow_schema

END_ID = 2
MAGIC = b"DAC1"
#: Bits that one entry of the rank directory covers.
SUPER = 512
_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def encode(ids: np.ndarray) -> bytes:
    """A segment of these ids."""
    rest = np.asarray(ids, np.uint32)
    levels = []
    while True:
        more = rest > 255
        last = not more.any()
        part = struct.pack("<I", len(rest)) + (rest & np.uint32(255)).astype(np.uint8).tobytes()
        if not last:
            bits = np.packbits(more, bitorder="little")
            bits = np.pad(bits, (0, -len(bits) % (SUPER // 8)))
            ones = _POP[bits].reshape(-1, SUPER // 8).sum(1, dtype=np.uint32)
            part += bits.tobytes() + (np.cumsum(ones, dtype=np.uint32) - ones).astype("<u4").tobytes()
        levels.append(part)
        if last:
            return MAGIC + struct.pack("<II", len(ids), len(levels)) + b"".join(levels)
        rest = rest[more] >> np.uint32(8)


class Segment:
    """Random access to the ids of a segment's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a DAC segment")
        self.n, depth = struct.unpack_from("<II", data, 4)
        self.levels, at = [], 12
        for k in range(depth):
            (n,) = struct.unpack_from("<I", data, at)
            at += 4
            chunk = np.frombuffer(data, np.uint8, n, at)
            at += n
            bits = ranks = None
            if k + 1 < depth:
                blocks = -(-n // SUPER)
                bits = np.frombuffer(data, np.uint8, blocks * SUPER // 8, at)
                at += len(bits)
                ranks = np.frombuffer(data, "<u4", blocks, at)
                at += 4 * blocks
            self.levels.append((chunk, bits, ranks))

    def __len__(self) -> int:
        return self.n

    def get(self, at: np.ndarray | int) -> np.ndarray:
        """The ids at these places, by rank alone."""
        at = np.atleast_1d(np.asarray(at, np.int64))
        out = np.zeros(len(at), np.uint32)
        who = np.arange(len(at))
        for k, (chunk, bits, ranks) in enumerate(self.levels):
            out[who] |= chunk[at].astype(np.uint32) << np.uint32(8 * k)
            if bits is None or not len(who):
                break
            on = (bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            who, at = who[on], at[on]
            rank = ranks[at // SUPER].astype(np.int64)
            begin = at // SUPER * (SUPER // 8)
            # set bits of the superblock before the place: whole bytes, then the bits below
            for byte in range(SUPER // 8):
                rank += np.where(begin + byte < at >> 3, _POP[bits[np.minimum(begin + byte, len(bits) - 1)]], 0)
            rank += _POP[bits[at >> 3] & ((1 << (at & 7)) - 1).astype(np.uint8)]
            at = rank
        return out

    def slice(self, begin: int, end: int) -> np.ndarray:
        """The ids of [begin, end): one rank a level finds the first, the rest follow in order."""
        out, lo, hi = None, begin, end
        chains = []
        for chunk, bits, ranks in self.levels:
            on = None if bits is None else np.unpackbits(bits[lo >> 3 : (hi + 7) >> 3], bitorder="little")[lo & 7 :][: hi - lo].view(bool)
            chains.append((chunk[lo:hi], on))
            if on is None:
                break
            lo = self._rank(bits, ranks, lo)
            hi = lo + int(on.sum())
        for chunk, on in reversed(chains):
            own = chunk.astype(np.uint32)
            if on is not None and out is not None:
                own[on] |= out << np.uint32(8)
            out = own
        return out if out is not None else np.empty(0, np.uint32)

    @staticmethod
    def _rank(bits: np.ndarray, ranks: np.ndarray, at: int) -> int:
        if not len(ranks):
            return 0
        s = min(at // SUPER, len(ranks) - 1)
        return int(ranks[s]) + int(np.unpackbits(bits[s * SUPER // 8 : (at + 7) >> 3], bitorder="little")[: at - s * SUPER].sum())


#: Segments of which the places before them are broadcast; more are joined by shuffle.
BROADCAST_SEGMENTS = 500_000
SEGMENTS = "segment int, doc_ids array<bigint>, n_tokens array<bigint>, dac binary"


def write_tokens(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> None:
    """Writes the ids of every text, `end_id` behind each document, in ascending id order."""
    own = Columns(docs.select(id_col, text_col), moved=[id_col, text_col])
    layout = B.plan(own, id_col, text_col)

    def segment(table: pa.Table) -> pa.Table:
        rows, texts = B.in_order(table)
        c, ids, counts = codec(tokenizer), [], []
        for i, j in vec.chunks(texts, CHUNK_BYTES):
            got, starts = c.encode(texts[i:j])
            ids.append(np.insert(got, starts[1:], np.uint32(end_id)))
            counts += (np.diff(starts) + 1).tolist()
        return pa.table([pa.array([table[B.BLOCK][0].as_py()], pa.int32()), pa.array([rows[B.ID].to_pylist()], pa.list_(pa.int64())), pa.array([counts], pa.list_(pa.int64())), pa.array([encode(np.concatenate(ids))], pa.binary())], ["segment", "doc_ids", "n_tokens", "dac"])

    dealt = B.deal(own, id_col, text_col, layout)
    dealt.groupBy(B.BLOCK).applyInArrow(segment, SEGMENTS).write.option("compression", "none").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """A row a document, from the files: doc_id, start (ids of all documents before it),
    n_tokens and ids (little-endian unsigned 32-bit, as binary)."""
    files = spark.read.schema(SEGMENTS).parquet(path)
    # one row a segment: the layout bounds their number
    sizes = files.select("segment", F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("total"))
    before = sizes.select(F.col("segment").alias("of"), (F.sum("total").over(Window.orderBy("segment")) - F.col("total")).alias("before"))
    schema = "doc_id bigint, start bigint, n_tokens bigint, ids binary"
    arrow = arrow_schema(spark, schema)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                seg = Segment(row["dac"])
                starts = np.concatenate([[0], np.cumsum(row["n_tokens"])]).astype(np.int64)
                data = [seg.slice(a, b).astype("<u4").tobytes() for a, b in zip(starts.tolist(), starts.tolist()[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["before"]), pa.array(row["n_tokens"], pa.int64()), pa.array(data, pa.binary())], schema=arrow)

    if before.count() <= BROADCAST_SEGMENTS:
        before = F.broadcast(before)  # else the segments themselves would be shuffled
    joined = files.join(before, F.col("segment") == F.col("of"), "left").select("doc_ids", "n_tokens", "before", "dac")
    return joined.mapInArrow(rows, schema)
