"""Hard negatives by vantage-point trees over norm-augmented vectors.

With M the largest norm, a row x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0); then
distance^2 = |q|^2 + M^2 - 2 q.x: falling scores are rising distances, and a window of scores is an
annulus around the anchor.  Two searches use this.

1. Positives: an anchor's `positives` nearest rows of its own label.
2. Negatives: for each positive the `k` nearest rows of other labels inside the annulus that its
   window gives: low/100 * positive score <= score <= high/100 * positive score.

Rows are dealt to regions by a vantage-point tree over a bounded sample (SAMPLE rows, for routing only:
every row is searched), and large regions to blocks of about BLOCK_ROWS by a hash of the id, so copies
of one vector spread out.  Each region knows its least and largest distance to the vantage points
above it; the triangle inequality then bounds all its scores for an anchor.  The first search asks
an anchor's own region first, and with the kth score found there only regions that may do better;
the second asks only regions that meet an annulus.  In a block a vantage-point tree of its own is
walked nearest first (:meth:`Tree.nearest`): subtrees outside the annuli are never entered, and
the walk ends when no subtree left can improve what was found.  All answers are exact integers; trees
decide only what needs no look.

Scale.  A group is a block of rows with up to BATCH anchors: bounded, whatever the input, its copies
or labels.  Where nothing can be pruned (random vectors in many dimensions) each anchor meets each
block, the stated query set against all rows.  What travels in closures is the region tree: at most
SAMPLE / LEAF_SAMPLE regions.  Nothing is broadcast.

Defined cases: rows without a label or vector, with null or non-finite components, or without an id take
no part; only vectors of one length are compared; exact repeats of a row (id, label, vector) count
once; a row is never its anchor's partner if it has the anchor's id; an anchor whose id repeats
stands for its least (label, vector); ties go to the smaller id; products beyond a long are clipped;
a window that holds nothing (as of a negative score) gives no rows; fewer partners than asked give
all; extra columns are ignored; no rows give no rows.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns
from newsprism.llm.whitening import complete, whole
from newsprism.storage import stored

SCALE, EVERY, POSITIVES, K, LOW, HIGH = 256, 100, 5, 5, 80, 100
BLOCK_ROWS, BATCH, LEAF = 8192, 4096, 256
#: Rows of the sample that routes; the most of them in a region, or a block's share of them if that is more.
SAMPLE, LEAF_SAMPLE = 2048, 32
LONG = np.iinfo(np.int64)


class Tree:
    """A vantage-point tree over points.  A node splits its points at the median distance to a vantage
    point, one of its own; both halves keep their least and largest distance to it."""

    def __init__(self, points: np.ndarray, leaf: int):
        self.points = points
        #: per node: (vantage point, [(low, high, child)]) or the rows of a leaf
        self.nodes: list[tuple[np.ndarray, list[tuple[float, float, int]]] | np.ndarray] = []
        if len(points):
            self._build(np.arange(len(points)), leaf)

    def _build(self, own: np.ndarray, leaf: int) -> int:
        k = len(self.nodes)
        self.nodes.append(own)
        if len(own) <= leaf:
            return k
        # the point farthest from the first one sees the others at the most different distances
        far = self.points[own[np.argmax(distances(self.points[own], self.points[own[0]]))]]
        d = distances(self.points[own], far)
        cut = np.median(d)
        inner = d <= cut
        if inner.all():
            inner = d < cut
        if not inner.any():  # all at one distance: no sphere parts them
            return k
        sides = []
        for side in (inner, ~inner):
            sides.append((float(d[side].min()), float(d[side].max()), self._build(own[side], leaf)))
        self.nodes[k] = (far, sides)
        return k

    def nearest(self, q: np.ndarray, low: float, high: float) -> Iterator[tuple[float, np.ndarray]]:
        """(bound, rows) of leaves that may hold points at distances low to high from q, nearest bound
        first; no point of the leaf, nor of any later one, is nearer than its bound."""
        heap = [(0.0, 0)] if self.nodes else []
        while heap:
            bound, k = heapq.heappop(heap)
            node = self.nodes[k]
            if isinstance(node, np.ndarray):
                yield bound, node
                continue
            d = float(np.sqrt(((node[0] - q) ** 2).sum()))
            for near, far, child in node[1]:
                least = max(bound, d - far, near - d)
                if least <= high and d + far >= low:
                    heapq.heappush(heap, (least, child))


def distances(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    return np.sqrt(((x - point) ** 2).sum(1))


def augmented(x: np.ndarray, top: float) -> np.ndarray:
    """Rows on a sphere of radius `top` in one more dimension."""
    x = x.astype(np.float64)
    return np.column_stack([x, np.sqrt(np.maximum(top * top - (x * x).sum(1), 0.0))])


class Space:
    """Distances of scores: the largest norm, and the slack that makes up for rounding."""

    def __init__(self, top: float):
        self.top = top

    def query(self, q: np.ndarray) -> np.ndarray:
        return np.append(q.astype(np.float64), 0.0)

    def _square(self, q: np.ndarray, score: float) -> float:
        return float((q * q).sum()) + self.top**2 - 2.0 * float(score)

    def slack(self, q: np.ndarray) -> float:
        return 1e-9 * (float((q * q).sum()) + self.top**2) + 1e-6

    def annulus(self, q: np.ndarray, low: int, high: int) -> tuple[float, float]:
        """Least and largest distance of rows whose score is from low to high; a long's ends stand for
        all beyond."""
        s = self.slack(q)
        near = 0.0 if high >= LONG.max else math.sqrt(max(0.0, self._square(q, high) - s))
        return near, math.inf if low <= LONG.min else math.sqrt(max(0.0, self._square(q, low) + s))

    def best(self, q: np.ndarray, distance: float) -> float:
        """No row at this distance or farther has a higher score."""
        return (float((q * q).sum()) + self.top**2 - distance**2 + self.slack(q)) / 2


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Exact inner products, clipped to longs."""
    most = int(np.abs(x).max(initial=0)) * int(np.abs(q).max(initial=0)) * max(1, x.shape[1])
    if most < 1 << 53:
        return np.rint(x.astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
    return np.array([min(max(int(v), LONG.min), LONG.max) for v in x.astype(object) @ q.astype(object)], np.int64)


def search(tree: Tree, space: Space, x: np.ndarray, ids: np.ndarray, wanted: np.ndarray, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list[list[tuple[int, int]]]:
    """For each window of scores (low, high) the k best (score, id) among rows that `wanted` marks, by
    one incremental walk, nearest first, through the annulus around all windows."""
    found: list[list[tuple[int, int]]] = [[] for _ in windows]
    real = [w for w, (low, high) in enumerate(windows) if low <= high]
    if not real:
        return found
    qf, qa = q.astype(np.float64), space.query(q)
    near, far = space.annulus(qf, min(windows[w][0] for w in real), max(windows[w][1] for w in real))
    for bound, rows in tree.nearest(qa, near, far):
        best = space.best(qf, bound)
        real = [w for w in real if (windows[w][0] <= best) and (len(found[w]) < k or found[w][-1][0] <= best)]
        if not real:
            break
        rows = rows[wanted[rows]]
        s = products(x[rows], q)
        for w in real:
            low, high = windows[w]
            floor = max(low, found[w][-1][0]) if len(found[w]) == k else low
            hit = np.flatnonzero((s >= floor) & (s <= high))
            if len(hit):
                both = found[w] + [(int(s[h]), int(ids[rows[h]])) for h in hit]
                found[w] = sorted(both, key=lambda r: (-r[0], r[1]))[:k]
    return found


# -- regions ---------------------------------------------------------------------------------


class Router:
    """Region trees over a sample, one a length of vectors.  A length that the sample lacks is one region
    without bounds."""

    def __init__(self, sample: list[list[int]], top: float, leaf: int = LEAF_SAMPLE):
        self.space, self.trees = Space(top), {}
        for d in {len(v) for v in sample}:
            own = [v for v in sample if len(v) == d]
            self.trees[d] = Tree(augmented(np.array(own, np.int64).reshape(len(own), d), top), leaf)
        #: (length, region) -> [(vantage point, low, high)], once measured
        self.bounds: dict[tuple[int, int], list[tuple[np.ndarray, float, float]]] = {}

    def place(self, x: np.ndarray) -> tuple[np.ndarray, list[list[float]]]:
        """Region (a leaf's number) and distances to the vantage points above it, of rows of one length."""
        tree = self.trees.get(x.shape[1])
        regions, seen = np.zeros(len(x), np.int64), [[] for _ in x]
        if tree is None:
            return regions, seen
        points, todo = augmented(x, self.space.top), [(0, np.arange(len(x)))]
        while todo:
            k, own = todo.pop()
            node = tree.nodes[k]
            if isinstance(node, np.ndarray) or not len(own):
                regions[own] = k
                continue
            vantage, ((_, inner, left), (outer, _, right)) = node
            d = distances(points[own], vantage)
            for i, v in zip(own.tolist(), d.tolist(), strict=True):
                seen[i].append(v)
            beyond = d > (inner + outer) / 2
            todo += [(left, own[~beyond]), (right, own[beyond])]
        return regions, seen

    def above(self, d: int) -> dict[int, list[np.ndarray]]:
        """Vantage points on the way to each region."""
        out: dict[int, list[np.ndarray]] = {}
        tree = self.trees.get(d)
        todo: list[tuple[int, list[np.ndarray]]] = [(0, [])]
        while todo:
            k, way = todo.pop()
            if tree is None or isinstance(tree.nodes[k], np.ndarray):
                out[k] = way
            else:
                vantage, sides = tree.nodes[k]
                todo += [(child, [*way, vantage]) for _, _, child in sides]
        return out

    def reach(self, q: np.ndarray, region: int) -> tuple[float, float]:
        """Least and largest distance that members of a region may have from an anchor."""
        least, most, qa = 0.0, math.inf, self.space.query(q)
        for vantage, low, high in self.bounds.get((len(q), region), ()):
            d = float(np.sqrt(((vantage - qa) ** 2).sum()))
            least, most = max(least, d - high, low - d), min(most, d + high)
        return least, most


def dealt(rows: DataFrame, router: Router) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """The rows with region and block, and how many blocks each region has; measures the regions' bounds."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for d in np.unique(dims):
                part = batch.take(pa.array(np.flatnonzero(dims == d)))
                x = np.asarray(part.column("v").flatten()).reshape(part.num_rows, d)
                regions, seen = router.place(x)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(regions), pa.array(seen, pa.list_(pa.float64()))], names=[*part.schema.names, "region", "seen"])

    placed = stored(rows.mapInArrow(place, "id bigint, label string, v array<bigint>, dim int, region bigint, seen array<double>"), "regions")
    sizes = {(r.dim, r.region): r.n for r in placed.groupBy("dim", "region").agg(F.count("*").alias("n")).collect()}  # a row a region
    ways = {d: router.above(d) for d in {d for d, _ in sizes}}
    for r in placed.select("dim", "region", F.posexplode("seen").alias("at", "s")).groupBy("dim", "region", "at").agg(F.min("s").alias("low"), F.max("s").alias("high")).collect():
        slack = 1e-9 * (r.high + router.space.top)
        router.bounds.setdefault((r.dim, r.region), []).append((ways[r.dim][r.region][r.at], r.low - slack, r.high + slack))
    counts = {k: max(1, math.ceil(n / BLOCK_ROWS)) for k, n in sizes.items()}
    listed = F.lit(1)
    if any(c > 1 for c in counts.values()):
        table = F.create_map(*(F.lit(x) for (d, g), c in counts.items() if c > 1 for x in (f"{d}/{g}", c)))
        listed = F.coalesce(F.try_element_at(table, F.concat_ws("/", F.col("dim").cast("string"), F.col("region").cast("string"))), F.lit(1))
    block = F.pmod(F.xxhash64("id"), listed.cast("bigint"))
    return placed.drop("seen").withColumn("block", block), counts


# -- the two searches ------------------------------------------------------------------------

ASKED = "anchor_id bigint, label string, q array<bigint>, dim int, region bigint, block bigint, low array<bigint>, high array<bigint>"
FOUND = "anchor_id bigint, window int, id bigint, score bigint"


def asks(router: Router, counts: dict[tuple[int, int], int], stage: str):
    """A map from anchors (anchor_id, label, v, dim, low, high) to the blocks that may answer.  Stage own:
    the anchor's region; others: every other region that may hold better scores; all: every one."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for r in batch.to_pylist():
                q, d = np.array(r["v"], np.int64), r["dim"]
                mine = int(router.place(q[None])[0][0])
                real = [(a, b) for a, b in zip(r["low"], r["high"], strict=True) if a <= b]
                if not real:
                    continue
                qf = q.astype(np.float64)
                near, far = router.space.annulus(qf, min(a for a, _ in real), max(b for _, b in real))
                for (dim, region), n in counts.items():
                    if dim != d or stage == "own" and region != mine or stage == "others" and region == mine:
                        continue
                    least, most = router.reach(q, region)
                    if least <= far and most >= near:
                        out += [(r["anchor_id"], r["label"], r["v"], d, region, b, r["low"], r["high"]) for b in range(n)]
            kinds = (pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            names = [c.split()[0] for c in ASKED.split(", ")]
            for at in range(0, max(1, len(out)), 2000):
                part = out[at : at + 2000]
                yield pa.RecordBatch.from_arrays([pa.array([o[c] for o in part], t) for c, t in enumerate(kinds)], names=names)

    return send


def answers(router: Router, same: bool, k: int, leaf: int):
    """The cogroup of a block's anchors and rows: the best k of each window, in the block's own tree."""

    def meet(asked: pa.Table, rows: pa.Table) -> pa.Table:
        out: list[tuple] = []
        if asked.num_rows and rows.num_rows:
            d = rows["dim"][0].as_py()
            x = np.concatenate([np.asarray(c.flatten()) for c in rows["v"].chunks]).reshape(rows.num_rows, d)
            ids, labels = rows["id"].to_numpy(), np.array(rows["label"].to_pylist(), object)
            order = np.lexsort((*x.T[::-1], labels.astype(str), ids))
            x, ids, labels = x[order], ids[order], labels[order]
            new = np.ones(len(ids), bool)
            new[1:] = (ids[1:] != ids[:-1]) | (labels[1:] != labels[:-1]) | (x[1:] != x[:-1]).any(1)
            x, ids, labels = x[new], ids[new], labels[new]
            tree = Tree(augmented(x, router.space.top), leaf)
            alike = {label: labels == label for label in set(asked["label"].to_pylist())}
            for r in asked.to_pylist():
                wanted = (alike[r["label"]] if same else ~alike[r["label"]]) & (ids != r["anchor_id"])
                got = search(tree, router.space, x, ids, wanted, np.array(r["q"], np.int64), list(zip(r["low"], r["high"], strict=True)), k)
                out += [(r["anchor_id"], w, i, s) for w, rows_ in enumerate(got) for s, i in rows_]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        return pa.table([pa.array([o[c] for o in out], t) for c, t in enumerate(kinds)], names=["anchor_id", "window", "id", "score"])

    return meet


def _ask(anchors: DataFrame, rows: DataFrame, router: Router, counts: dict, stage: str, same: bool, k: int) -> DataFrame:
    """(anchor_id, window, id, score): the best k of each block that was asked."""
    batches = max(1, math.ceil(anchors.count() / BATCH))
    sent = anchors.mapInArrow(asks(router, counts, stage), ASKED).withColumn("batch", F.pmod(F.xxhash64("anchor_id"), F.lit(batches)).cast("bigint"))
    keys = ["dim", "region", "block"]
    copies = rows.withColumn("of", F.lit(0).cast("bigint"))
    if batches > 1:  # a block goes to the batches that ask it
        copies = rows.join(sent.select(*keys, F.col("batch").alias("of")).distinct(), keys)
    return sent.groupBy(*keys, "batch").cogroup(copies.groupBy(*keys, "of")).applyInArrow(answers(router, same, k, LEAF), FOUND)


def _best(found: DataFrame, k: int, name: str) -> DataFrame:
    order = Window.partitionBy("anchor_id", "window").orderBy(F.desc("score"), "id")
    ranked = found.withColumn(name, F.row_number().over(order))
    return ranked.where(F.col(name) <= k)


def hard_negatives(
    vectors: DataFrame, label_col: str = "label", id_col: str = "vec_id", vec_col: str = "embedding", every: int = EVERY, positives: int = POSITIVES, k: int = K, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the anchors, rows
    whose id is divisible by `every`.  Low and high are percents of the positive's score."""
    own = Columns(vectors)
    id_, label, v = own[id_col], own[label_col], own[vec_col]
    ready = own.df.where(id_.isNotNull() & label.isNotNull() & complete(v))
    ready = ready.select(id_.cast("bigint").alias("id"), label.cast("string").alias("label"), whole(v, scale).alias("v"))
    rows = stored(ready.withColumn("dim", F.size("v")), "rows")
    norm = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, top = rows.agg(F.count("*"), F.max(norm)).first()
    if top is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    sample = [r.v for r in rows.select("v", F.xxhash64("id").alias("h")).orderBy("h").limit(SAMPLE).collect()]
    # regions of about a block's rows each, as far as the sample tells them apart
    router = Router(sample, math.sqrt(top) * (1 + 1e-12), max(LEAF_SAMPLE, len(sample) * BLOCK_ROWS // n))
    rows, counts = dealt(rows, router)

    lowest, highest = (F.lit(v).cast("bigint") for v in (LONG.min, LONG.max))
    least = rows.where(F.col("id") % every == 0).groupBy("id").agg(F.min(F.struct("label", "v", "dim")).alias("r"))
    anchors = stored(least.select(F.col("id").alias("anchor_id"), "r.label", "r.v", "r.dim", F.array(lowest).alias("low"), F.array(highest).alias("high")), "anchors")
    near = stored(_best(_ask(anchors, rows, router, counts, "own", True, positives), positives, "place"), "near")
    # the worst of a full list is a floor for all other regions
    floor = near.where(F.col("place") == positives).select("anchor_id", F.col("score").alias("floor"))
    again = anchors.join(floor, "anchor_id", "left").withColumn("low", F.array(F.coalesce("floor", lowest))).drop("floor")
    both = near.drop("place").unionByName(_ask(again, rows, router, counts, "others", True, positives))
    chosen = stored(_best(both, positives, "place"), "positives")

    score, no = F.col("score"), F.col("place") - 1
    wide = score.cast("decimal(25,0)")
    windows = chosen.select("anchor_id", no.alias("window"), F.ceil(wide * low / 100).cast("bigint").alias("lo"), F.floor(wide * high / 100).cast("bigint").alias("hi"))
    listed = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("window", "lo", "hi"))).alias("w"))
    asked = anchors.drop("low", "high").join(listed, "anchor_id")
    asked = asked.withColumns({"low": F.transform("w", lambda w: w["lo"]), "high": F.transform("w", lambda w: w["hi"])}).drop("w")
    mined = _best(_ask(stored(asked, "windows"), rows, router, counts, "all", False, k), k, "rank")
    pairs = chosen.select("anchor_id", no.alias("window"), F.col("id").alias("positive_id"), score.alias("positive_score"))
    out = mined.join(pairs, ["anchor_id", "window"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
