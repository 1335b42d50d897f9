"""Outside providers of vectors and decisions, called in batches from a map over rows.

A task makes its own calls: BATCH rows each, not faster than one every `pace` seconds, again after a rate
limit with the pause that the provider asks for or a doubled one.  Answers are checked before anything
is kept, and a fault never fails the job: the rows of its batch come back with the fault's name
and without a value, for a later run to take up."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame

BATCH, RETRIES, PAUSE, LONGEST = 25, 3, 1.0, 60.0
#: Characters of a reason that are kept.
REASON = 500


class RateLimited(Exception):
    """Raised by a provider: how long to wait, if it says, and whether waiting can help."""

    def __init__(self, after: float | None = None, final: bool = False):
        super().__init__(after, final)
        self.after, self.final = after, final


class Fault(Exception):
    """An answer that must not be kept; its name."""


class Caller:
    """Calls a provider with pacing and retries.  `clock` and `sleep` are for tests."""

    def __init__(self, provider: Callable, pace: float, retries: int, clock=time.monotonic, sleep=time.sleep):
        self.provider, self.pace, self.retries, self.clock, self.sleep, self.last = provider, pace, retries, clock, sleep, None

    def __call__(self, asked: Sequence) -> tuple[object, int]:
        """The answer and the number of attempts; Fault if there is none."""
        for attempt in range(1, self.retries + 2):
            if self.last is not None and (wait := self.last + self.pace - self.clock()) > 0:
                self.sleep(wait)
            self.last = self.clock()
            try:
                return self.provider(asked), attempt
            except RateLimited as limit:
                if limit.final or attempt > self.retries:
                    raise Fault("rate_limited") from limit
                self.sleep(min(LONGEST, PAUSE * 2 ** (attempt - 1) if limit.after is None else limit.after))
            except Exception as e:  # noqa: BLE001 - whatever an outside provider raises
                raise Fault(f"failed: {type(e).__name__}") from e
        raise Fault("rate_limited")


def checked_vectors(answer: object, n: int, dimensions: int | None) -> list[list[float]]:
    """Vectors in the order of the texts, from items (index, embedding) in any order."""
    if not isinstance(answer, list):
        raise Fault("malformed")
    found: dict[int, list[float]] = {}
    for item in answer:
        index, vector = (item.get("index"), item.get("embedding")) if isinstance(item, dict) else (None, None)
        if not isinstance(index, int) or isinstance(index, bool) or not isinstance(vector, list):
            raise Fault("malformed")
        if not vector:
            raise Fault("empty_vector")
        if not all(isinstance(v, (int, float)) for v in vector):
            raise Fault("not_numeric")
        if not all(math.isfinite(v) for v in vector):
            raise Fault("not_finite")
        found[index] = [float(v) for v in vector]
    if set(found) != set(range(n)):
        raise Fault("indexes")
    sizes = {len(v) for v in found.values()}
    if len(sizes) > 1 or dimensions is not None and sizes != {dimensions}:
        raise Fault("dimensions")
    return [found[k] for k in range(n)]


def checked_decisions(answer: object, asked: Sequence[tuple[str, str]], kinds: Sequence[str]) -> list[tuple[str, float, str | None]]:
    """(relation, confidence, reason) of each pair asked, sides in either order, each exactly once."""
    listed = answer.get("decisions") if isinstance(answer, dict) else None
    if not isinstance(listed, list):
        raise Fault("malformed")
    found: dict[frozenset, tuple] = {}
    for item in listed:
        row = tuple(item.get(k) for k in ("left_group", "right_group", "relation", "confidence", "reason")) if isinstance(item, dict) else ()
        if len(row) != 5 or not all(isinstance(row[k], str) for k in (0, 1, 2, 4)) or not isinstance(row[3], (int, float)) or isinstance(row[3], bool):
            raise Fault("malformed")
        left, right, relation, confidence, reason = row
        if relation not in kinds:
            raise Fault("relation")
        if not math.isfinite(confidence) or not 0 <= confidence <= 1:
            raise Fault("confidence")
        if frozenset((left, right)) in found:
            raise Fault("decided_twice")
        found[frozenset((left, right))] = (relation, float(confidence), reason.strip()[:REASON] or None)
    if set(found) != {frozenset(p) for p in asked}:
        raise Fault("pairs")
    return [found[frozenset(p)] for p in asked]


def _batches(rows: DataFrame, provider: Callable, ask: Callable, kinds: Sequence[pa.DataType], schema: str, batch: int, pace: float, retries: int) -> DataFrame:
    """Maps rows in batches: `ask(caller, rows of a batch)` gives columns beside theirs."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        caller = Caller(provider, pace, retries)
        for part in parts:
            for at in range(0, part.num_rows, batch):
                own = part.slice(at, batch)
                rows = ask(caller, own.to_pylist())
                yield pa.RecordBatch.from_arrays([*own.columns, *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names=[*own.schema.names, *names])

    have = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes)
    return rows.mapInArrow(run, f"{have}, {schema}")


def embed(texts: DataFrame, provider: Callable[[list[str]], object], dimensions: int | None = None, batch: int = BATCH, pace: float = 0.0, retries: int = RETRIES) -> DataFrame:
    """Texts (id, text) with outcome, attempts and embedding.  `provider` gives items (index, embedding)."""

    def ask(caller: Caller, rows: list[dict]) -> list[tuple]:
        try:
            answer, attempts = caller([r["text"] or "" for r in rows])
            return [("ok", attempts, v) for v in checked_vectors(answer, len(rows), dimensions)]
        except Fault as f:
            return [(str(f), None, None)] * len(rows)

    kinds = (pa.string(), pa.int32(), pa.list_(pa.float64()))
    return _batches(texts.select("id", "text"), provider, ask, kinds, "outcome string, attempts int, embedding array<double>", batch, pace, retries)


def classify(pairs: DataFrame, provider: Callable[[list[dict]], object], kinds: Sequence[str], batch: int = BATCH, pace: float = 0.0, retries: int = RETRIES) -> DataFrame:
    """Pairs (left_group, right_group, ...) with outcome, attempts, relation, confidence and reason."""

    def ask(caller: Caller, rows: list[dict]) -> list[tuple]:
        try:
            answer, attempts = caller(rows)
            return [("ok", attempts, *d) for d in checked_decisions(answer, [(r["left_group"], r["right_group"]) for r in rows], kinds)]
        except Fault as f:
            return [(str(f), None, None, None, None)] * len(rows)

    types = (pa.string(), pa.int32(), pa.string(), pa.float64(), pa.string())
    return _batches(pairs, provider, ask, types, "outcome string, attempts int, relation string, confidence double, reason string", batch, pace, retries)
