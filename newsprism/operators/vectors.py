"""An exact join of vectors by cosine and time, that gives only pairs above a threshold.

Unit vectors are dealt by time slot to the nearest of a few pivots (rows of the input, for dealing only)
and to blocks of at most BLOCK rows on average.  A block knows its greatest angle to its pivot; by the triangle
inequality two blocks whose pivots are farther apart than both angles and the threshold's angle
hold no pair, and are never sent to each other.  Blocks that may hold one meet as a group of bounded size and
are multiplied as matrices; what leaves the group are the pairs above the threshold."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.operators.relations import cosine
from newsprism.storage import stored

PIVOTS, BLOCK = 32, 2048
#: What rounding may cost an angle or a product.
SLACK = 1e-7


def _units(rows: DataFrame, window: int) -> DataFrame:
    """(id, time_s, v, dim, slot) of usable vectors, at length one."""
    v = F.col("embedding").cast("array<double>")
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
    fine = F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x)), F.lit(False)) & (norm > 0) & (norm < float("inf"))
    rows = rows.where(F.col("time_s").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    return rows.select(F.col("article_id").alias("id"), "time_s", F.transform(v, lambda x: x / norm).alias("v"), F.size(v).alias("dim"), F.floor(F.col("time_s") / window).alias("slot"))


def _pivots(rows: DataFrame, count: int) -> dict[int, np.ndarray]:
    """dim -> unit vectors of rows with the least hashes."""
    found: dict[int, list] = {}
    for r in rows.select("dim", "v", F.xxhash64("id").alias("h")).orderBy("h").limit(count).collect():
        found.setdefault(r.dim, []).append(r.v)
    return {d: np.array(v) for d, v in found.items()}


def _dealt(rows: DataFrame, pivots: dict[int, np.ndarray]) -> tuple[DataFrame, DataFrame]:
    """Rows with pivot and part, and blocks (dim, slot, pivot, part, angle, first_s, last_s)."""

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            pivot, angle = np.zeros(len(dims), np.int32), np.full(len(dims), math.pi)
            for d in set(dims.tolist()) & set(pivots):
                own = np.flatnonzero(dims == d)
                x = np.asarray(batch.column("v").take(pa.array(own)).flatten()).reshape(len(own), d)
                cos = x @ pivots[d].T
                pivot[own] = cos.argmax(1)
                angle[own] = np.arccos(np.clip(cos.max(1), -1, 1))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pivot), pa.array(angle)], names=[*batch.schema.names, "pivot", "angle"])

    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    placed = stored(rows.mapInArrow(near, f"{kinds}, pivot int, angle double"), "placed")
    keys = ["dim", "slot", "pivot"]
    sizes = placed.groupBy(*keys).agg(F.ceil(F.count("*") / BLOCK).alias("parts"))
    parted = stored(placed.join(sizes, keys).withColumn("part", F.pmod(F.xxhash64("id"), "parts")).drop("parts"), "parted")
    return parted, parted.groupBy(*keys, "part").agg(F.max("angle").alias("angle"), F.min("time_s").alias("first_s"), F.max("time_s").alias("last_s"))


def cosine_pairs(articles: DataFrame, others: DataFrame, least: float, window: int) -> DataFrame:
    """(a_id, b_id): articles and others (article_id, time_s, embedding) of different ids, at most `window`
    seconds apart, whose cosine is at least `least` (0 to 1), to rounding."""
    a, b = _units(articles, window), _units(others, window)
    kind = dict(a.dtypes)["id"]
    pivots = _pivots(b, PIVOTS)
    (left, left_blocks), (right, right_blocks) = _dealt(a, pivots), _dealt(b, pivots)
    # the angles between pivots: a table of at most PIVOTS x PIVOTS numbers a length
    apart = {d: np.arccos(np.clip(p @ p.T, -1, 1)) for d, p in pivots.items()}
    flat = F.create_map(*(F.lit(x) for d, t in apart.items() for i, row in enumerate(t.tolist()) for j, v in enumerate(row) for x in (f"{d}/{i}/{j}", v))) if apart else None
    between: Column = F.coalesce(F.try_element_at(flat, F.concat_ws("/", *(F.col(c).cast("string") for c in ("dim", "a_pivot", "b_pivot")))), F.lit(0.0)) if flat is not None else F.lit(0.0)
    name = lambda blocks, s: blocks.select("dim", F.col("slot").alias(f"{s}_slot"), *(F.col(c).alias(f"{s}_{c}") for c in ("pivot", "part", "angle", "first_s", "last_s")))
    x = name(left_blocks, "a").withColumn("b_slot", F.explode(F.array(*(F.col("a_slot") + k for k in (-1, 0, 1)))))
    meet = x.join(name(right_blocks, "b"), ["dim", "b_slot"])
    close = between - F.col("a_angle") - F.col("b_angle") <= math.acos(min(1.0, least)) + SLACK
    in_time = (F.col("a_first_s") - F.col("b_last_s") <= window) & (F.col("b_first_s") - F.col("a_last_s") <= window)
    places = ["dim", *(f"{s}_{c}" for s in "ab" for c in ("slot", "pivot", "part"))]
    meet = stored(meet.where(close & in_time).select(*places), "meetings")
    sent = {}
    for s, rows in (("a", left), ("b", right)):
        own = {f"{s}_{c}": F.col(c) for c in ("slot", "pivot", "part")}
        rows = rows.select("dim", *(c.alias(n) for n, c in own.items()), "id", "time_s", "v")
        both = meet.join(rows, ["dim", *own])
        sent[s] = both.select(*(F.col(c).alias(f"{s}{k}") for k, c in enumerate(places)), F.col("dim").alias("d"), "id", "time_s", "v")
    keys = {s: [f"{s}{k}" for k in range(len(places))] for s in "ab"}

    def multiply(p: pa.Table, q: pa.Table) -> pa.Table:
        empty = pa.table({"a_id": p["id"].slice(0, 0), "b_id": q["id"].slice(0, 0)})
        if not p.num_rows or not q.num_rows:
            return empty
        d = p["d"][0].as_py()
        m = [np.concatenate([np.asarray(c.flatten()) for c in t["v"].chunks]).reshape(-1, d) for t in (p, q)]
        at = [t["time_s"].to_numpy() for t in (p, q)]
        i, j = np.nonzero(m[0] @ m[1].T >= least - SLACK)
        near = np.abs(at[0][i] - at[1][j]) <= window
        rows = pa.table({"a_id": p["id"].take(pa.array(i[near])), "b_id": q["id"].take(pa.array(j[near]))})
        return rows.filter(pc.not_equal(rows["a_id"], rows["b_id"]))

    return sent["a"].groupBy(*keys["a"]).cogroup(sent["b"].groupBy(*keys["b"])).applyInArrow(multiply, f"a_id {kind}, b_id {kind}")


def near_vectors(rows: DataFrame, keys: list[str], item: str, vector: str, least: float) -> DataFrame:
    """(keys, earlier, later, close): pairs of items (whole numbers) of one key tuple whose cosine is at least
    `least`.  A key's vectors are dealt to blocks of BLOCK on average and each two blocks are multiplied as
    one group, so a key of any size is held by no task; null vectors and null keys take no part."""
    known = rows.where(F.col(vector).isNotNull()).select(*keys, F.col(item).cast("bigint").alias("item"), F.col(vector).cast("array<double>").alias("v"), F.size(vector).alias("dim"))
    each = [*keys, "dim"]
    sizes = known.groupBy(*each).agg(F.count("*").alias("n")).where("n > 1").select(*each, F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
    dealt = known.join(sizes, each).withColumn("part", F.pmod(F.xxhash64("item"), "parts").cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    sent = dealt.select(*each, F.least("part", "other").alias("p"), F.greatest("part", "other").alias("q"), "part", "item", "v")

    def multiply(t: pa.Table) -> pa.Table:
        part, items, d = t["part"].to_numpy(), t["item"].to_numpy(), t["dim"][0].as_py()
        x = np.concatenate([np.asarray(c.flatten()) for c in t["v"].chunks]).reshape(-1, d)
        unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
        inside = t["p"][0].as_py() == t["q"][0].as_py()
        first, second, close = [], [], []
        for at in range(0, len(items), 1024):
            i, j = np.nonzero(unit[at : at + 1024] @ unit.T >= least - SLACK)
            i += at
            fits = (items[i] < items[j]) & (inside | (part[i] != part[j]))
            for a, b in zip(i[fits].tolist(), j[fits].tolist(), strict=True):
                got = cosine(x[a].tolist(), x[b].tolist())
                if got >= least:
                    first.append(a)
                    second.append(b)
                    close.append(got)
        found = {k: t[k].take(pa.array(first, pa.int64())) for k in keys}
        return pa.table(found | {"earlier": t["item"].take(pa.array(first, pa.int64())), "later": t["item"].take(pa.array(second, pa.int64())), "close": pa.array(close, pa.float64())})

    kinds = dict(known.dtypes)
    return sent.groupBy(*each, "p", "q").applyInArrow(multiply, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "earlier bigint, later bigint, close double"]))
