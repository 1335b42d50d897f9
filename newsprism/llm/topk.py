"""Exact top-k search by inner product: dual-tree search over cover trees.

Rows are dealt into blocks of about BLOCK_ROWS by a hash of their id, queries into batches of
about BATCH_QUERIES; each (batch, block) pair is one group.  There both sides are indexed alike, as
cover trees (:class:`CoverTree`), and pairs of nodes are visited together, best bound first.  A
pair is pruned when even the best product that the two covering radii allow stays below the worst
kth score of the query node's members.  Each pair of groups gives at most k rows a query; a ranked
window keeps the best k of them.  Groups are bounded whatever the input or its copies, and nothing
is broadcast.

Components become floor(64 * x), so scores are integers and ties are exact: they go to the smaller
id.  Products that leave 2**53 are computed with unbounded integers and clipped to a long.

Defined cases: a null vector, or one with null or non-finite components, takes no part, nor does a
null id; only vectors of one length are compared; exact repeats of a row count once, and as a query
a repeated id stands for its least vector; a candidate never has the query's id; with fewer than k
candidates all are returned; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns

K, EVERY = 20, 20
BLOCK_ROWS, BATCH_QUERIES = 8192, 8192
FANOUT, LEAF_DATA, LEAF_QUERIES = 16, 512, 256


class CoverTree:
    """Nodes with a centre, a covering radius and children.

    The children of a node are centres taken by farthest-first traversal: they are separated by
    at least the scale r at which it stops and cover every member within r, and a node's own
    centre is its first child's, as in a cover tree whose scales follow the data."""

    def __init__(self, x: np.ndarray, leaf: int):
        self.x = x
        self.norms = np.sqrt((x * x).sum(1)) if len(x) else np.empty(0)
        self.leaf = leaf
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if len(x):
            self._build(np.arange(len(x)), 0)

    def _distance(self, own: np.ndarray, c: int) -> np.ndarray:
        d = self.x[own] - self.x[c]
        return np.sqrt(np.maximum((d * d).sum(1), 0.0))

    def _build(self, own: np.ndarray, centre: int) -> int:
        d = self._distance(own, centre)
        node = len(self.centre)
        self.centre.append(centre)
        self.radius.append(float(d.max()))
        self.children.append([])
        self.members.append(own)
        if len(own) <= self.leaf or self.radius[node] == 0:
            return node
        centres, nearest, least = [centre], np.zeros(len(own), np.int64), d
        while len(centres) < FANOUT:
            far = int(least.argmax())
            if least[far] == 0:
                break
            other = self._distance(own, int(own[far]))
            nearest[other < least] = len(centres)
            least = np.minimum(least, other)
            centres.append(int(own[far]))
        for k, c in enumerate(centres):
            part = own[nearest == k]
            if len(part):
                self.children[node].append(self._build(part, c))
        return node


class Search:
    """Best k data ids and scores of each query."""

    def __init__(self, q: np.ndarray, q_ids: np.ndarray, d: np.ndarray, d_ids: np.ndarray, k: int, leaves: tuple[int, int] = (LEAF_QUERIES, LEAF_DATA)):
        self.k, self.q_ids, self.d_ids = k, q_ids, d_ids
        top = lambda x: int(np.abs(x).max()) if x.size else 0
        self.exact = max(q.shape[1], 1) * max(top(q), 1) * max(top(d), 1) < 1 << 53
        self.qi, self.di = q, d
        self.q, self.d = q.astype(np.float64), d.astype(np.float64)
        self.qt, self.dt = CoverTree(self.q, leaves[0]), CoverTree(self.d, leaves[1])
        self.scores = np.full((len(q), k), np.iinfo(np.int64).min, np.int64)
        self.ids = np.full((len(q), k), np.iinfo(np.int64).max, np.int64)
        self.full = np.zeros((len(q), k), bool)
        self.pruned = self.visited = 0
        if len(q) and len(d):
            self._pair(0, 0)

    def bound(self, a: int, b: int) -> float:
        """No product of a member of query node a and one of data node b exceeds this."""
        qc, dc = self.qt.centre[a], self.dt.centre[b]
        qr, dr = self.qt.radius[a], self.dt.radius[b]
        best = float(self.q[qc] @ self.d[dc]) + qr * self.dt.norms[dc] + dr * self.qt.norms[qc] + qr * dr
        return best + 1e-9 * abs(best) + 1e-6

    def worst(self, a: int) -> int:
        return int(self.scores[self.qt.members[a], -1].min())

    def _pair(self, a: int, b: int) -> None:
        if self.bound(a, b) < self.worst(a):
            self.pruned += 1
            return
        qs, ds = self.qt.children[a], self.dt.children[b]
        if qs and (not ds or self.qt.radius[a] >= self.dt.radius[b]):
            for c in qs:
                self._pair(c, b)
        elif ds:
            for _, c in sorted(((-self.bound(a, c), c) for c in ds)):
                self._pair(a, c)
        else:
            self._leaves(self.qt.members[a], self.dt.members[b])

    def _products(self, qs: np.ndarray, ds: np.ndarray) -> np.ndarray:
        if self.exact:
            return np.rint(self.q[qs] @ self.d[ds].T).astype(np.int64)
        wide = self.qi[qs].astype(object) @ self.di[ds].astype(object).T
        lim = np.iinfo(np.int64)
        return np.array([[min(max(int(v), lim.min), lim.max) for v in row] for row in wide], np.int64).reshape(len(qs), len(ds))

    def _leaves(self, qs: np.ndarray, ds: np.ndarray) -> None:
        self.visited += 1
        s = self._products(qs, ds)
        ok = (s >= self.scores[qs, -1][:, None]) | ~self.full[qs, -1][:, None]
        ok &= self.q_ids[qs][:, None] != self.d_ids[ds][None, :]
        r, c = np.nonzero(ok)
        if not len(r):
            return
        had_r, had_c = np.nonzero(self.full[qs])
        row = np.concatenate([had_r, r])
        score = np.concatenate([self.scores[qs[had_r], had_c], s[r, c]])
        ids = np.concatenate([self.ids[qs[had_r], had_c], self.d_ids[ds[c]]])
        order = np.lexsort((ids, -score, row)) if score.min(initial=0) > np.iinfo(np.int64).min else np.lexsort((ids, ~score, row))
        row, score, ids = row[order], score[order], ids[order]
        start = np.searchsorted(row, np.arange(len(qs)))
        place = np.arange(len(row)) - start[row]
        keep = place < self.k
        row, score, ids, place = row[keep], score[keep], ids[keep], place[keep]
        self.scores[qs[row], place], self.ids[qs[row], place], self.full[qs[row], place] = score, ids, True


def quantised(vectors: DataFrame, id_col: str, vec_col: str, scale: int) -> DataFrame:
    """(id, v array<bigint>, dim) of the rows that take part."""
    own = Columns(vectors)
    v = own[vec_col].cast("array<double>")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    lim = float(1 << 62)
    # beyond a long a component is clipped; such sizes only keep the query from failing
    whole = F.transform(v, lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(lim)), F.lit(-lim))).cast("bigint"))
    rows = own.df.where(own[id_col].isNotNull() & own[vec_col].isNotNull()).where(fine)
    return rows.select(own[id_col].cast("bigint").alias("id"), whole.alias("v")).withColumn("dim", F.size("v"))


def top_k(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, every: int = EVERY, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score): for each id divisible by `every`, the k best other rows."""
    rows = quantised(vectors, id_col, vec_col, scale)
    n = vectors.count()
    blocks = max(1, math.ceil(n / BLOCK_ROWS))
    batches = max(1, math.ceil(n / every / BATCH_QUERIES))
    data = rows.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)))
    queries = rows.where(F.col("id") % every == 0).withColumn("batch", F.pmod(F.xxhash64("id"), F.lit(batches)))
    # the query set against all rows, in blocks: each query goes to each block, each row to each batch of queries
    sent = queries.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select("dim", "batch", F.col("block").cast("bigint"), "id", "v")
    kept = data.withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1)))).select("dim", F.col("batch").cast("bigint"), "block", "id", "v")
    keys = ["dim", "batch", "block"]

    def matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = table["id"].to_numpy()
        flat = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if len(ids) else np.empty(0, np.int64)
        x = flat.reshape(len(ids), -1) if len(ids) else np.empty((0, 0), np.int64)
        if not len(ids):
            return ids, x
        order = np.lexsort((*x.T[::-1], ids)) if x.shape[1] else np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (x[1:] != x[:-1]).any(1)])
        return ids[new], x[new]

    def pair(q_table: pa.Table, d_table: pa.Table) -> pa.Table:
        q_ids, q = matrix(q_table)
        d_ids, d = matrix(d_table)
        empty = pa.table({c: pa.array([], pa.int64()) for c in ("query_id", "vec_id", "score")})
        if not len(q_ids) or not len(d_ids):
            return empty
        first = np.concatenate([[True], q_ids[1:] != q_ids[:-1]])
        found = Search(q[first], q_ids[first], d, d_ids, k)
        r, c = np.nonzero(found.full)
        return pa.table({"query_id": pa.array(q_ids[first][r]), "vec_id": pa.array(found.ids[r, c]), "score": pa.array(found.scores[r, c])})

    pairs = sent.groupBy(*keys).cogroup(kept.groupBy(*keys)).applyInArrow(pair, "query_id bigint, vec_id bigint, score bigint")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
