"""Whitening of embeddings from an exact scatter matrix, reduced in residue numbers.

Components become x = floor(scale * c), whole numbers, so the sums that make a covariance have one
right value, whatever the order of rows, partitions and retries.  The fit list is each distinct x
once.  One pass gives its size n, the sums S and the largest |x|.  The second centres each
vector without a fraction, y = n * x - S, and multiplies: each partition takes y modulo several
primes, small enough that a product of residue matrices is exact in doubles (a GEMM), and keeps
one sum a prime modulo that prime.  These are added up over partitions in two rounds, and Chinese
remaindering gives the exact integers sum(y y') = n^3 * V.  The number of primes follows from the
bound n * max|y|^2.  Only then V becomes doubles, each entry rounded once, and goes to eigh.

Scale.  Rows are shuffled once, to make them distinct (repeats meet on the map side already, so a
vector that a third of the rows hold costs a row a task).  Partitions send d * d residues a prime, in
bands of BAND entries; a reducing task holds sqrt(partitions) bands.  The driver gets one d x d matrix a
prime and the model is a few d-vectors: vectors of some thousands of components are the bound, as
for eigh itself; no size depends on the rows.

Defined cases: rows without a vector, or with null or non-finite components, are left out; components
beyond 2^62 / scale are clipped to that; vectors of each length have a fit of their own; components
without variance (to double precision) aren't returned, nor is anything for empty vectors; signs
are such that a component's largest entry is positive; repeated rows and rows without an id each get
their results; a deviation beyond 38 digits is null; extra columns pass through, and a result
column replaces an input column of its name; no rows give no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsprism.llm.columns import Columns, arrow_schema, batch_of, boxed_schema
from newsprism.storage import stored

SCALE, COMPONENTS = 256, 4
#: Residues stay within +-2^20, so GEMM_ROWS products of two add up below 2^53.
PRIME_BITS, GEMM_ROWS = 21, 1 << 13
#: Entries of a band of a residue matrix.
BAND = 1 << 16
LIMIT = float(1 << 62)


@dataclass
class Model:
    """What whitens vectors of one length: n and S of the fit list, components as rows, eigenvalues,
    their share of the trace, and the measured error of the whitened fit list's covariance."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0


def primes(bits: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS whose product has over `bits` bits."""
    top, out, product = 1 << PRIME_BITS, [], 1
    small = [p for p in range(2, math.isqrt(top) + 1) if all(p % q for q in range(2, math.isqrt(p) + 1))]
    for c in range(top - 1, 2, -2):
        if product.bit_length() > bits + 1:
            break
        if all(c % p for p in small):
            out.append(c)
            product *= c
    return out


def whole(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * c) of each component, clipped to 62 bits."""
    return F.transform(vector.cast("array<double>"), lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(LIMIT)), F.lit(-LIMIT))).cast("bigint"))


def complete(vector: Column) -> Column:
    """True where there is a vector and all its components are finite numbers."""
    v = vector.cast("array<double>")
    return vector.isNotNull() & F.coalesce(F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))), F.lit(False))


def by_length(x: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, matrix) of each length of vectors in a column."""
    lengths = np.asarray(x.value_lengths())
    for d in np.unique(lengths):
        if d:
            own = np.flatnonzero(lengths == d)
            yield int(d), own, np.asarray(x.take(pa.array(own)).flatten()).reshape(len(own), d)


# -- first pass: n, S and the largest component ----------------------------------------------


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[int, list] = {}
    for batch in batches:
        for d, own, x in by_length(batch.column("x")):
            t = total.setdefault(d, [0, np.zeros(d, object), np.zeros(d, object), 0])
            t[0] += len(own)
            t[1] += (x >> 31).sum(0).astype(object)
            t[2] += (x & ((1 << 31) - 1)).sum(0).astype(object)
            t[3] = max(t[3], int(x.max()), -int(x.min()))
    rows = [(d, i, t[0], Decimal(int(t[1][i])), Decimal(int(t[2][i])), t[3]) for d, t in total.items() for i in range(d)]
    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.decimal128(38, 0), pa.decimal128(38, 0), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["d", "i", "n", "high", "low", "most"])


def moments(fit: DataFrame) -> dict[int, tuple[int, list[int], int]]:
    """length -> (n, S, largest |x|), by sums of one row a partition and component."""
    parts = fit.mapInArrow(_sums, "d int, i int, n bigint, high decimal(38,0), low decimal(38,0), most bigint")
    rows = parts.groupBy("d", "i").agg(F.sum("n").alias("n"), F.sum("high").alias("high"), F.sum("low").alias("low"), F.max("most").alias("most")).collect()
    out: dict[int, tuple[int, list[int], int]] = {}
    for d in {r.d for r in rows}:
        own = sorted((r for r in rows if r.d == d), key=lambda r: r.i)
        out[d] = (own[0].n, [(int(r.high) << 31) + int(r.low) for r in own], max(r.most for r in own))
    return out


# -- second pass: the scatter, by residues ---------------------------------------------------

SENT = "d int, prime int, band int, salt int, residues array<bigint>"


def _bands(d: int, p: int, salt: int, g: np.ndarray) -> Iterator[tuple]:
    flat = g.reshape(-1)
    for k in range(0, len(flat), BAND):
        yield d, p, k // BAND, salt, flat[k : k + BAND]


def _sent(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int64()))
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["d", "prime", "band", "salt", "residues"])


def residue_products(y: np.ndarray, p: int) -> np.ndarray:
    """y'y modulo p of residues modulo p, by exact products of doubles."""
    y = np.where(y > p // 2, y - p, y).astype(np.float64)
    g = np.zeros((y.shape[1],) * 2, np.int64)
    for k in range(0, len(y), GEMM_ROWS):
        part = y[k : k + GEMM_ROWS]
        g += np.rint(part.T @ part).astype(np.int64) % p
    return g % p


def scatter(fit: DataFrame, known: dict[int, tuple[int, list[int], int]]) -> dict[int, np.ndarray]:
    """length -> exact sum over the fit list of (n x - S)(n x - S)', as Python integers."""
    plan = {d: (n, sums, primes((n * (n * most + max(map(abs, sums))) ** 2).bit_length())) for d, (n, sums, most) in known.items()}
    salts = max(1, math.isqrt(int(fit.sparkSession.conf.get("spark.sql.shuffle.partitions"))))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for d, _, x in by_length(batch.column("x")):
                n, sums, moduli = plan[d]
                for p in moduli:
                    y = (n % p * (x % p) - np.array([s % p for s in sums], np.int64)) % p
                    total[d, p] = (total.get((d, p), 0) + residue_products(y, p)) % p
        salt = TaskContext.get().partitionId() % salts
        for (d, p), g in total.items():
            yield _sent(list(_bands(d, p, salt, g)))

    def add(table: pa.Table) -> pa.Table:
        d, p, band, salt = (table[c][0].as_py() for c in ("d", "prime", "band", "salt"))
        total = np.zeros(len(table["residues"][0]), np.int64)
        for part in table["residues"].chunks:
            total = (total + np.asarray(part.flatten()).reshape(len(part), -1).sum(0)) % p
        return pa.Table.from_batches([_sent([(d, p, band, salt, total)])])

    sums = fit.mapInArrow(multiply, SENT)
    sums = sums.groupBy("d", "prime", "band", "salt").applyInArrow(add, SENT).groupBy("d", "prime", "band").applyInArrow(add, SENT)
    got: dict[tuple[int, int], list[tuple[int, list[int]]]] = {}
    for r in sums.toArrow().to_pylist():  # d x d numbers a prime
        got.setdefault((r["d"], r["prime"]), []).append((r["band"], r["residues"]))
    return {d: remaindered({p: np.concatenate([x for _, x in sorted(got[d, p])]) for p in moduli}).reshape(d, d) for d, (_, _, moduli) in plan.items()}


def remaindered(residues: dict[int, np.ndarray]) -> np.ndarray:
    """The integers of least size with these residues (Chinese remaindering)."""
    m = math.prod(residues)
    out = sum(r.astype(object) * (m // p * pow(m // p, -1, p)) for p, r in residues.items()) % m
    return np.where(out > m // 2, out - m, out)


# -- the model, and rows through it ----------------------------------------------------------


def _decompose(n: int, sums: list[int], exact: np.ndarray, components: int) -> Model:
    d = len(sums)
    v = np.array([[int(a) / n**3 for a in row] for row in exact])  # each entry rounded once
    values, vectors = np.linalg.eigh(v)
    trace = sum(int(exact[i, i]) for i in range(d)) / n**3
    best = [k for k in np.argsort(-values, kind="stable") if values[k] > trace * d * np.finfo(float).eps][:components]
    u = vectors[:, best].T
    if len(u):
        u = u * np.sign(u[np.arange(len(u)), np.abs(u).argmax(1)])[:, None]
    return Model(n, sums, u, values[best], values[best] / trace if trace else values[best])


def centred(x: np.ndarray, model: Model) -> np.ndarray:
    """n x - S, exact: longs where they suffice, else Python integers."""
    most = max(int(x.max(initial=0)), -int(x.min(initial=0)))
    if model.n * most + max(map(abs, model.sums)) < 1 << 62:
        return model.n * x - np.array(model.sums, np.int64)
    return model.n * x.astype(object) - np.array(model.sums, object)


def projected(y: np.ndarray, model: Model) -> np.ndarray:
    return y.astype(np.float64) / model.n @ model.components.T / np.sqrt(model.values)


def _deviations(y: np.ndarray) -> list[Decimal | None]:
    most = max(abs(int(y.max(initial=0))), abs(int(y.min(initial=0))))
    if y.shape[1] * most**2 >= 1 << 63:
        y = y.astype(object)
    return [Decimal(int(s)) if s < 10**38 else None for s in (y * y).sum(1)]


def _identity_errors(fit: DataFrame, models: dict[int, Model]) -> None:
    """Sets each model's identity_error from the whitened fit list itself."""

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for d, own, x in by_length(batch.column("x")):
                z = projected(centred(x, models[d]), models[d])
                z = np.column_stack([z, np.ones(len(own))])
                total[d] = total.get(d, 0) + z.T @ z
        rows = [(d, i, float(g)) for d, t in total.items() for i, g in enumerate(t.reshape(-1))]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int32(), pa.float64()))], names=["d", "i", "g"])

    sums = fit.mapInArrow(products, "d int, i int, g double").groupBy("d", "i").agg(F.sum("g").alias("g")).collect()
    for d, m in models.items():
        k = len(m.values) + 1
        g = np.array([r.g for r in sorted((r for r in sums if r.d == d), key=lambda r: r.i)]).reshape(k, k) / m.n
        mean = g[:-1, -1]
        m.identity_error = float(np.abs(g[:-1, :-1] - np.outer(mean, mean) - np.eye(k - 1)).max(initial=0.0))


def fit_whitening(vectors: DataFrame, vec_col: str = "embedding", scale: int = SCALE, components: int = COMPONENTS) -> dict[int, Model]:
    """length of vector -> model, from all distinct whole vectors."""
    own = Columns(vectors)
    x = own.df.where(complete(own[vec_col])).select(whole(own[vec_col], scale).alias("x"))
    fit = stored(x.distinct(), "fit")
    known = moments(fit)
    exact = scatter(fit, known) if known else {}
    models = {d: _decompose(n, sums, exact[d], components) for d, (n, sums, _) in known.items()}
    if models:
        _identity_errors(fit, models)
    return models


RESULTS = "n bigint, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"


def whiten(vectors: DataFrame, models: dict[int, Model], vec_col: str = "embedding", scale: int = SCALE) -> DataFrame:
    """The rows with complete vectors, and n, deviation, whitened and explained (an entry a component) and
    identity_error."""
    names = [f.split()[0] for f in RESULTS.split(", ")]
    own = Columns(vectors, names)
    rows = own.rows(x=whole(own[vec_col], scale), ok=complete(own[vec_col])).where("ok").drop("ok")
    schema = boxed_schema(rows.drop("x"), RESULTS)
    arrow = arrow_schema(vectors.sparkSession, schema)

    def through(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, at, x in by_length(batch.column("x")):
                m = models[d]
                y = centred(x, m)
                one = lambda v, t, k=len(at): pa.array([v] * k, t)
                z = projected(y, m)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, z.size + 1, max(1, z.shape[1]), dtype=np.int32) if z.shape[1] else np.zeros(len(at) + 1, np.int32)), pa.array(z.reshape(-1)))
                columns = [one(m.n, pa.int64()), pa.array(_deviations(y), pa.decimal128(38, 0)), lists, one(m.explained.tolist(), pa.list_(pa.float64())), one(m.identity_error, pa.float64())]
                yield batch_of([batch.column(0).take(pa.array(at)), *columns], arrow)

    return own.back(rows.mapInArrow(through, schema), names)
