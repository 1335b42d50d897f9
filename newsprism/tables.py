"""Keyed tables on the shared folder: versions by manifest, commits by compare-and-swap.

A table is a folder with data parts and a log.  Each version has a manifest in the log, that names
for each bucket of the key the Parquet folders that hold its rows; nothing that a manifest names is ever
changed, so a reader of one version is not disturbed by writers.  A write reads a version, writes
new parts for the buckets that it touches, and commits by putting the next manifest, which succeeds for
one writer only.  A writer that finds other versions in between goes on if they touched none of its
buckets, else it computes its rows again from the newer version (optimistic concurrency).

Spark does the work: rows are joined with the touched buckets only, and written by bucket in one job.
The driver handles names of folders, a number a bucket."""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from newsprism.operators import writes
from newsprism.storage import stored

BUCKET, ACTION = "_bucket", "action"
#: Buckets of a table that names no other number: a write touches at least one.
BUCKETS = 16
TRIES = 10


class Conflict(Exception):
    """Another writer changed the same buckets; after TRIES attempts it reaches the caller."""


class Blocked(Exception):
    """A plan that must not be applied, since some of its rows conflict."""


@dataclass(frozen=True)
class Snapshot:
    """A version: bucket -> folders, and what the commit that made it did."""

    version: int
    parts: dict[int, list[str]]
    operation: str = ""
    touched: list[int] = field(default_factory=list)
    metrics: dict[str, int] = field(default_factory=dict)


class Files:
    """What a log needs of a file system that Spark reaches."""

    def __init__(self, spark: SparkSession):
        self.jvm, self.conf, self.gateway = spark._jvm, spark._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def system(self, name: str):
        return self.path(name).getFileSystem(self.conf)

    def names(self, folder: str) -> list[str]:
        fs, path = self.system(folder), self.path(folder)
        return sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []

    def read(self, name: str) -> str:
        stream = self.system(name).open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.system(name).delete(self.path(name), True)

    def put_new(self, name: str, text: str) -> bool:
        """Makes a file with this text, whole, unless there is one; of several callers one succeeds."""
        draft = f"{name}.{uuid.uuid4().hex}.draft"
        stream = self.system(draft).create(self.path(draft), True)
        stream.write(bytearray(text.encode()))
        stream.close()
        try:
            if self.system(name).getUri().getScheme() == "file":
                return self._link_new(draft, name)
            return self.rename_new(draft, name)
        finally:
            self.delete(draft)

    def _link_new(self, draft: str, name: str) -> bool:
        # a rename on a local disk checks and replaces in two steps; a link does in one
        local = lambda n: self.path(n).toUri().getPath()
        try:
            os.link(local(draft), local(name))
        except FileExistsError:
            return False
        return True

    def rename_new(self, draft: str, name: str) -> bool:
        """Renames without overwriting, which a name node does in one step."""
        none = self.gateway.new_array(getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
        none[0] = getattr(self.jvm, "org.apache.hadoop.fs.Options$Rename").NONE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.system(name).getUri(), self.conf)
        try:
            context.rename(self.path(draft), self.path(name), none)
        except Py4JJavaError as failed:
            if "FileAlreadyExistsException" in str(failed.java_exception.getClass().getName()):
                return False
            raise
        return True


Resolve = Callable[[DataFrame, DataFrame], DataFrame]


class Table:
    """A table of rows with keys; rows of one key lie in one bucket."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.files = spark, path.rstrip("/"), Files(spark)
        meta = json.loads(self.files.read(f"{self.path}/_log/table.json"))
        self.schema, self.keys, self.buckets = StructType.fromJson(meta["schema"]), meta["keys"], meta["buckets"]

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: StructType, keys: Sequence[str], buckets: int = BUCKETS) -> Table:
        """A new, empty table; raises FileExistsError if there is one."""
        files, path = Files(spark), path.rstrip("/")
        files.system(path).mkdirs(files.path(f"{path}/_log"))
        if not files.put_new(f"{path}/_log/table.json", json.dumps({"schema": json.loads(schema.json()), "keys": list(keys), "buckets": buckets})):
            raise FileExistsError(path)
        table = cls(spark, path)
        files.put_new(table._manifest(0), json.dumps({"parts": {}, "operation": "create"}))
        return table

    # -- reading -------------------------------------------------------------------------------

    def _manifest(self, version: int) -> str:
        return f"{self.path}/_log/{version:020d}.json"

    def version(self) -> int:
        return max(int(n[:20]) for n in self.files.names(f"{self.path}/_log") if n.endswith(".json") and n[:20].isdigit())

    def snapshot(self, version: int | None = None) -> Snapshot:
        version = self.version() if version is None else version
        m = json.loads(self.files.read(self._manifest(version)))
        return Snapshot(version, {int(b): p for b, p in m["parts"].items()}, m["operation"], m.get("touched", []), m.get("metrics", {}))

    def read(self, version: int | None = None, buckets: Iterable[int] | None = None) -> DataFrame:
        """The rows of a version, the newest if none is given, or of some of its buckets."""
        return self._rows(self.snapshot(version), buckets)

    def _rows(self, snapshot: Snapshot, buckets: Iterable[int] | None = None) -> DataFrame:
        wanted = snapshot.parts if buckets is None else set(buckets) & set(snapshot.parts)
        folders = [f for b in sorted(wanted) for f in snapshot.parts[b]]
        return self.spark.read.schema(self.schema).parquet(*folders) if folders else self.spark.createDataFrame([], self.schema)

    # -- writing -------------------------------------------------------------------------------

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _write(self, rows: DataFrame) -> tuple[dict[int, list[str]], dict[str, int]]:
        """Writes a part; its folders by bucket, and the number of rows by action.  The action lies beside
        the rows, where readers don't look; rows with action delete go to a folder that no manifest names."""
        part = f"{self.path}/part-{uuid.uuid4().hex}"
        action = F.col(ACTION) if ACTION in rows.columns else F.lit("insert")
        rows = rows.select(*(F.col(f.name).cast(f.dataType) for f in self.schema), action.alias("_action"))
        kept = self._bucketed(rows).withColumn(BUCKET, F.when(F.col("_action") == "delete", -1).otherwise(F.col(BUCKET)))
        kept.repartition(BUCKET).write.partitionBy(BUCKET).parquet(part)
        numbers = [int(n.split("=")[1]) for n in self.files.names(part) if n.startswith(BUCKET)]
        counted = self.spark.read.schema("_action string").parquet(part).groupBy("_action").count().collect() if numbers else []
        return {n: [f"{part}/{BUCKET}={n}"] for n in numbers if n >= 0}, {r[0]: r[1] for r in counted}

    def _commit(self, base: Snapshot, parts: dict[int, list[str]], touched: Iterable[int], operation: str, metrics: dict[str, int], append: bool) -> int:
        """Puts the manifest after the newest one, on top of versions that touched other buckets."""
        touched, seen = set(touched), base.version
        while True:
            newest = self.snapshot()
            for v in range(seen + 1, newest.version + 1):
                if not append and touched & set(self.snapshot(v).touched):
                    raise Conflict(f"version {v} ({self.snapshot(v).operation}) changed rows that {operation} read")
            seen = newest.version
            merged = dict(newest.parts)
            for b in touched:
                merged[b] = (merged.get(b, []) if append else []) + parts.get(b, [])
            text = json.dumps({"parts": {b: p for b, p in merged.items() if p}, "operation": operation, "touched": sorted(touched), "metrics": metrics})
            if self.files.put_new(self._manifest(newest.version + 1), text):
                return newest.version + 1

    def append(self, rows: DataFrame, operation: str = "append") -> int:
        """Adds rows, whatever the table holds; never conflicts."""
        parts, metrics = self._write(rows)
        return self._commit(self.snapshot(), parts, parts, operation, metrics, append=True)

    def change(self, incoming: DataFrame, resolve: Resolve, operation: str, everywhere: bool = False, tries: int = TRIES) -> Snapshot:
        """Replaces the buckets of the incoming keys (or all) by resolve(their rows, incoming), whose `action`
        column, if any, is counted in the metrics (a column of that name is never one of the table's).  After a conflict the rows are resolved anew."""
        incoming = stored(self._bucketed(incoming), "incoming", keep=True)  # retries see the same rows
        touched = range(self.buckets) if everywhere else [r[0] for r in incoming.select(BUCKET).distinct().collect()]
        incoming = incoming.drop(BUCKET)
        for _ in range(tries):
            base = self.snapshot()
            parts, metrics = self._write(resolve(self._rows(base, touched), incoming))
            try:
                return self.snapshot(self._commit(base, parts, touched, operation, metrics, append=False))
            except Conflict as lost:
                last = lost
                for part in {f.rsplit("/", 1)[0] for folders in parts.values() for f in folders}:
                    self.files.delete(part)
        raise last

    def expire(self, keep: int = 10) -> int:
        """Deletes parts and manifests that the newest `keep` versions don't need; the number of parts gone."""
        newest = self.version()
        alive = {f.rsplit("/", 2)[-2] for v in range(max(0, newest - keep + 1), newest + 1) if f"{v:020d}.json" in self.files.names(f"{self.path}/_log") for p in self.snapshot(v).parts.values() for f in p}
        old = [n for n in self.files.names(self.path) if n.startswith("part-") and n not in alive]
        for name in [*old, *(f"_log/{n}" for n in self.files.names(f"{self.path}/_log") if n[:20].isdigit() and int(n[:20]) <= newest - keep)]:
            self.files.delete(f"{self.path}/{name}")
        return len(old)


# -- the writes ------------------------------------------------------------------------------


def _acted(rows: DataFrame, action: str) -> DataFrame:
    return rows.withColumn(ACTION, F.lit(action))


def insert_absent(table: Table, rows: DataFrame) -> Snapshot:
    """Adds the rows whose keys the table lacks, one a key; rows with a null key are always new."""
    return table.change(rows, lambda old, new: _acted(old, "keep").unionByName(_acted(writes.insert_absent(old, new, table.keys), "insert")), "insert absent")


def upsert(table: Table, rows: DataFrame, fields: Sequence[str], derived: dict[str, Sequence[str]] | None = None) -> Snapshot:
    """Inserts and updates by key where a field differs; a derived column, not among the incoming ones,
    becomes null if one of the fields that it was made from changes."""
    derived = derived or {}

    def resolve(old: DataFrame, new: DataFrame) -> DataFrame:
        both = writes.diff_upsert(old, new, table.keys, fields)
        if not derived:
            return both
        both = both.join(old.select(*table.keys, *derived), list(table.keys), "left")
        stale = lambda made_from: F.arrays_overlap(F.split("changed", ","), F.lit(list(made_from)))
        return both.withColumns({c: F.when(~stale(made_from), F.col(c)) for c, made_from in derived.items()})

    return table.change(rows, resolve, "upsert")


def replace(table: Table, rows: DataFrame, covered: DataFrame) -> Snapshot:
    """Rows of the covered keys (the table's) go, and `rows` come in their place."""
    key = table.keys
    marked = rows.withColumn("_new", F.lit(True)).unionByName(covered.select(*key).distinct().withColumn("_new", F.lit(False)), allowMissingColumns=True)

    def resolve(old: DataFrame, new: DataFrame) -> DataFrame:
        gone = new.where("not _new").select(*key)
        parts = _acted(old.join(gone, list(key), "left_anti"), "keep"), _acted(old.join(gone, list(key), "left_semi"), "delete"), _acted(new.where("_new").drop("_new"), "insert")
        return parts[0].unionByName(parts[1]).unionByName(parts[2])

    return table.change(marked, resolve, "replace")


def new_generation(table: Table, rows: DataFrame, generation: str = "generation") -> Snapshot:
    """Adds the rows as a newer generation of their keys (the table's, one column)."""
    (key,) = table.keys
    return table.change(rows, lambda old, new: writes.append_generation(old, new, key, generation), "new generation")


def delete_absent(table: Table, living: DataFrame) -> Snapshot:
    """Rows whose keys are not among `living` go: ineligible documents, children of retired parents."""

    def resolve(old: DataFrame, new: DataFrame) -> DataFrame:
        known = new.select(*table.keys).distinct().withColumn("_alive", F.lit(True))
        both = old.join(known, list(table.keys), "left")
        return both.withColumn(ACTION, F.when(F.col("_alive"), "keep").otherwise("delete")).drop("_alive")

    return table.change(living.select(*table.keys), resolve, "delete absent", everywhere=True)


def patch(table: Table, patches: DataFrame, fields: Sequence[str]) -> Snapshot:
    """Partial updates: (key, a struct (value, present) a field); unknown keys change nothing."""
    (key,) = table.keys
    return table.change(patches, lambda old, new: writes.patch(old, new, key, fields), "patch")


def reconcile(table: Table, wanted: DataFrame, fields: Sequence[str], fixed: Sequence[str] = ()) -> Snapshot:
    """Creates and updates what a catalog wants; raises Blocked, and writes nothing, if a fixed field of
    any row differs.  Rows that the catalog lacks stay as they are."""
    (key,) = table.keys

    def resolve(old: DataFrame, new: DataFrame) -> DataFrame:
        clash = writes.plan_reconcile(new, old, key, fields, fixed).where("action = 'conflict'").select(key)
        first = [r[0] for r in clash.orderBy(key).limit(20).collect()]  # for the message
        if first:
            raise Blocked(f"fixed fields differ for {first}")
        return writes.diff_upsert(old, new, [key], fields)

    return table.change(wanted, resolve, "reconcile")


def commit_unchanged(table: Table, results: DataFrame, inputs: Callable[[], DataFrame]) -> Snapshot:
    """Writes results (keys, input_hash, fields) of a long run only where the input still is what the run
    read: `inputs` gives the present (keys, input_hash) and is asked at each attempt to commit."""

    def resolve(old: DataFrame, new: DataFrame) -> DataFrame:
        valid = new.join(inputs(), [*table.keys, "input_hash"], "left_semi")
        fields = [c for c in table.schema.names if c not in table.keys]
        return writes.diff_upsert(old, valid, table.keys, fields)

    return table.change(results, resolve, "commit unchanged")
